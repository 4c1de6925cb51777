"""Registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, html_extract, norm_search, packing, quality_rules, ranked_search, secret_scan, sentence_dedup, sharding, simhash_dedup, suffix_dedup, url_filter, warc_dedup
from weftline.llm._shared import shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_verdicts(_read(spark, sf_dir, "documents")).drop("removed", "text_hash")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_file(), keep_words=240_000)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_read(spark, sf_dir, "documents"))


def op10_warc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_dedup.archive_pages(_read(spark, sf_dir, "pages"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.without_repeats(_read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_read(spark, sf_dir, "documents"), shared_folder(spark, "shards"), target_bytes=64 << 20)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_read(spark, sf_dir, "documents"), with_rest=False).drop("kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_search.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_sharding": op8_sharding,
    "op9_sentence_dedup": op9_sentence_dedup,
    "op10_warc_dedup": op10_warc_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
}
#: Where SQL can state the result; the other operators are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": r"""
with texts as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents
), items as (
  select item_id, w, least(10, len(w)) as size from
    (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
     from benchmark)
  where len(w) > 0
), windows as (
  select distinct item_id, size, array_to_string(w[k:k + size - 1], ' ') as s from
    (select *, unnest(generate_series(1, len(w) - size + 1)) as k from items)
), runs as (
  select doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') as s from
    (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as k from texts, (select distinct size from windows))
), hits as (
  select doc_id, item_id, k, windows.size from runs join windows on windows.size = runs.size and windows.s = runs.s
), covered as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(k, k + size - 1)) as p from hits) group by 1
), found as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from
    (select distinct doc_id, cast(item_id as varchar) as id from hits) group by 1
)
select t.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from texts t left join covered using (doc_id) left join found using (doc_id)
""",
    "op5_quality_rules": r"""
with t as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select r, k, array_to_string(w[k:k + 7], ' ') as s from (select r, w, unnest(generate_series(1, len(w) - 7)) as k from t)
), again as (
  select r, s from windows group by 1, 2 having count(*) > 1
), covered as (
  select r, count(distinct p) as n from (select r, unnest(generate_series(k, k + 7)) as p from windows join again using (r, s)) group by 1
), lines as (
  select r, source, text, line, lower(trim(line, E' \t\r\x0b\x0c')) as norm from (select r, source, text, unnest(string_split(text, chr(10))) as line from t)
  where regexp_matches(line, '[^\x20\x09-\x0D]')
), frequent as (
  select source, norm from lines group by 1, 2 having count(distinct text) > 20
), of_lines as (
  select r, count(*) - count(distinct line) as n_dup, sum(length(line)) as chars, sum(length(line)) filter (f.norm is null) as kept
  from lines left join frequent f on f.source is not distinct from lines.source and f.norm = lines.norm group by 1
), m as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(chars, 0) as chars, coalesce(kept, 0) as kept_chars
  from t left join covered c using (r) left join of_lines using (r)
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, kept_chars < chars and kept_chars < 100 and kept_chars < 0.2 * chars as depleted from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not depleted as kept, (chars - kept_chars)::bigint as removed_chars from judged
""",
    "op9_sentence_dedup": r"""
with parts as (
  select doc_id, unnest(p) as part, generate_subscripts(p, 1) as place from
    (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?][\x20\x09-\x0D]|[\n\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(1), 'g'), chr(1)) as p from documents)
), full_parts as (
  select *, lower(trim(part, E' \t\n\r\x0b\x0c')) as s, row_number() over (partition by doc_id order by place) as pos, count(*) over (partition by doc_id) as n
  from parts where trim(part, E' \t\n\r\x0b\x0c') <> ''
), weighed as (
  select *, greatest(len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')), length(s) // 6) as w from full_parts
), places as (
  select doc_id, pos as first, pos + 1 as last from weighed where pos < n
  union select doc_id, pos, pos from weighed where n = 1 and w >= 12
), runs as (
  select p.doc_id, p.first, p.last, string_agg(f.s, ' ' order by f.pos) as run
  from places p join full_parts f on f.doc_id = p.doc_id and f.pos between p.first and p.last group by 1, 2, 3
), counted as (
  select *, row_number() over (partition by run order by doc_id, first) as k from runs
), removed as (
  select distinct doc_id, unnest(generate_series(first, last)) as pos from counted where k > 1
), kept as (
  select parts.doc_id, string_agg(parts.part, '' order by parts.place) as text from parts
  left join full_parts f on f.doc_id = parts.doc_id and f.place = parts.place
  where not exists (select 1 from removed r where r.doc_id = f.doc_id and r.pos = f.pos) group by 1
), sentences as (select doc_id, count(*) as n from full_parts group by 1), lost as (select doc_id, count(*) as n from removed group by 1)
select d.doc_id, coalesce(s.n, 0)::bigint as n_sentences, coalesce(l.n, 0)::bigint as n_removed, coalesce(k.text, '') as text,
  length(coalesce(k.text, ''))::bigint as kept_chars
from documents d left join sentences s using (doc_id) left join lost l using (doc_id) left join kept k using (doc_id)
""",
    "op10_warc_dedup": r"""
with hashed as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages
), digests as (
  select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((list_sum(list_transform(range(5), lambda j:
      (strpos('0123456789abcdef', substr(h, cast(1 + (i // 4) * 5 + j as int), 1)) - 1) * cast(16 ** (4 - j) as bigint)))
      // cast(32 ** (3 - i % 4) as bigint)) % 32)::int, 1)), '') as payload_digest from hashed
), firsts as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as original from digests)
select page_id, payload_bytes, payload_digest, case when page_id = original then 'response' else 'revisit' end as record_type,
  case when page_id <> original then original end as refers_to from firsts
""",
    "op11_ranked_search": r"""
with texts as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents
), docs as (
  select r, doc_id, w, len(w) as n from texts where len(w) > 0
), totals as (
  select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from docs
), asked as (
  select distinct q, item_id, term from (select q, item_id, unnest(w) as term from
    (select row_number() over () as q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
     from benchmark))
), counts as (
  select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from docs) where term in (select term from asked) group by 1, 2
), weights as (
  select term, floor(1000 * ln((2 * max(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from counts, totals group by 1
), impacts as (
  select r, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) as impact
  from counts join weights using (term) join docs using (r), totals
), scores as (
  select q, item_id, r, sum(impact)::bigint as score from asked join impacts using (term) group by 1, 2, 3 having sum(impact) > 0
), ranked as (
  select item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id)::int as rank from scores join docs using (r)
)
select item_id, rank, doc_id, score from ranked where rank <= 50
""",
    "op12_hard_negatives": r"""
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.r, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and b.vec_id is distinct from a.vec_id
), positives as (
  select r, anchor_id, id as positive_id, score as positive_score from
    (select *, row_number() over (partition by r order by score desc, id) as n from scored where same) where n <= 5
), negatives as (
  select p.anchor_id, positive_id, row_number() over (partition by p.r, positive_id, positive_score order by score desc, id)::int as rank,
    id as negative_id, positive_score, score as negative_score
  from positives p join scored s on s.r = p.r and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
)
select * from negatives where rank <= 5
""",
    "op13_url_filter": r"""
with rules(name, host, path, verdict) as (
  values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
    ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), urls as (
  select row_number() over () as r, page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), tokens as (
  select distinct r, page_id, unnest(list_concat(
    list_transform(regexp_extract_all(regexp_extract(low, '(?s)^(.*?)://', 1), '[a-z\x{80}-\x{10FFFF}]+'), lambda w: 's:' || w),
    list_transform(regexp_extract_all(regexp_extract(low, '(?s)^.*?://([^/?#]*)', 1), '[a-z\x{80}-\x{10FFFF}]+'), lambda w: 'h:' || w),
    list_transform(regexp_extract_all(regexp_extract(low, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[a-z\x{80}-\x{10FFFF}]+'), lambda w: 'p:' || w),
    list_transform(regexp_extract_all(regexp_extract(low, '(?s)^.*?://[^?#]*(.*)', 1), '[a-z\x{80}-\x{10FFFF}]+'), lambda w: 'q:' || w))) as token
  from urls
), told as (
  select doc_id, bool_or(coalesce(quality = 0, false) or coalesce(toxic = 1, false)) as bad from labels
  where doc_id is not null and (quality is not null or toxic is not null) group by 1
), labelled as (
  select r, bad from urls join told on doc_id = page_id
), needed as (
  select greatest(5, ceil(0.002 * count(*))) as least from labelled
), frequent as (
  select token from tokens join labelled using (r) where bad group by 1 having count(*) >= (select least from needed)
), held as (
  select r, list(token order by token) as items from tokens join frequent using (token) group by 1
), subsets as (
  select list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) as items from
    (select items, unnest(range(1, cast(1::bigint << len(items) as bigint))) as m from held join labelled using (r) where bad)
), sets as (
  select items, count(*) as n_bad from subsets group by 1 having count(*) >= (select least from needed)
), mined as (
  select s.items from sets s join (select items from held join labelled using (r)) h on list_has_all(h.items, s.items)
  group by s.items, n_bad having n_bad >= 0.6 * count(*)
), hits as (
  select distinct r from held join mined on list_has_all(held.items, mined.items)
), fit as (
  select r, name, verdict, row_number() over (partition by r order by length(name) desc) as k from urls join rules
  on (urls.host = rules.host or ends_with(urls.host, '.' || rules.host)) and starts_with(urls.path, rules.path)
)
select page_id, urls.host, urls.path, name as rule, coalesce(verdict, case when hits.r is null then 'allow' else 'block' end) as verdict
from urls left join fit on fit.r = urls.r and k = 1 left join hits on hits.r = urls.r
""",
}
