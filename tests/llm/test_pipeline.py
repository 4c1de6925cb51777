import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_decontaminate import plain as plain_hits
from test_packing import check, direct
from test_secret_scan import plain as plain_secrets
from test_simhash_dedup import plain_groups

from weftline.llm import secret_scan


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """What each stage keeps, by name; the first is the table itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, folder = {"documents": docs}, tmp_path_factory.mktemp("stages")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        out[name] = docs = spark.read.parquet(f"{folder}/{i}")
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_but_the_last_return_documents(kept):
    frames = list(kept.values())
    assert all(df.columns == frames[0].columns and dict(df.dtypes) == dict(frames[0].dtypes) for df in frames[:-1])
    assert all(df.where(F.col("n_chars") != F.length("text")).isEmpty() for df in frames[1:-1])


def test_quality_rules(kept):
    before, after = texts(kept["documents"]), texts(kept["quality rules"])
    short = {k for k, t in before.items() if len((t or "").split()) < 20}
    assert short and not short & set(after)
    assert len(after) > 0.8 * (len(before) - len(short))


def test_one_of_each_group_stays(kept):
    before, after = texts(kept["quality rules"]), texts(kept["near-duplicate removal"])
    assert set(after) == set(plain_groups(before).values()) < set(before)
    assert all(before[k] == t for k, t in after.items())


def test_no_benchmark_passage_is_left(spark, sf_dir, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = texts(kept["near-duplicate removal"]), texts(kept["benchmark decontamination"])
    hit = {k for k, t in before.items() if plain_hits(t, items)[1]}
    assert hit and all(before[k] == after[k] for k in set(before) - hit)
    assert not any(plain_hits(after[k], items)[1] for k in hit & set(after))


def test_no_secret_is_left(kept):
    before, after = texts(kept["benchmark decontamination"]), texts(kept["secret scan"])
    found = {k for k, t in before.items() if sum(plain_secrets(t)[:3])}
    assert set(before) == set(after) and all(before[k] == after[k] for k in set(before) - found if "[secret]" not in after[k])
    assert not any(sum(plain_secrets(t)[:3]) for t in after.values())
    assert secret_scan.secret_report(kept["secret scan"]).where("spans <> ''").isEmpty()


def test_pieces_are_those_of_the_texts(kept):
    own = texts(kept["secret scan"])
    ids = {k: d + b"\1\0\0\0" for k, d in zip(own, direct([t or "" for t in own.values()]))}
    check(kept["packing"].collect(), ids)


def test_run_equals_the_stages(spark, sf_dir, kept):
    total = lambda df: df.agg(F.sum("length"), F.count_distinct("doc_id")).first()
    assert total(corpus_pipeline.run(spark, sf_dir)) == total(kept["packing"])


def test_run_on_odd_tables(spark, tmp_path, documents):
    """Null ids and texts, empty and long texts, repeated rows, columns with the names that stages use; and empty tables."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(None, None), (None, words + " own"), (1, ""), (2, words), (2, words), (3, words + " more"), (4, "long " * 30_000), (5, "token=abcdefghijkl " + " ".join(f"v{k}" for k in range(60)))]
    extra = dict(v_id="1", v_hash="2", gone_id="3", n_same="4", s_text="5", c_text="6", c_row="7", own_hash="8", parts="9", label="10")
    bench = spark.createDataFrame([(1, None), (None, "an item of ten words that nobody here has used yet")], "item_id bigint, text string")
    for name, df, items in (("odd", documents(rows, **extra), bench), ("empty", documents([], **extra), bench.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{tmp_path}/odd").columns == docs.columns
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in out} == {None, 2, 5}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
