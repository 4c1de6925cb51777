import hashlib
import random

import pytest

from weftline.llm.queries import QUERIES
from weftline.llm.sharding import CommitConflict, Shard, ShardStore, sharded


@pytest.fixture
def store(spark, tmp_path):
    return ShardStore(spark, f"file://{tmp_path}/store", target_bytes=40_000, smallest_bytes=1000, fanout=3)


def test_query_is_an_exact_round_trip(spark, sf_dir, small):
    rows = QUERIES["op8_sharding"](spark, sf_dir).collect()
    expected = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in small.collect()}
    assert {r["doc_id"]: r["text_sha256"] for r in rows} == expected and len(rows) == len(expected)
    assert {r["version"] for r in rows} == {9}  # eight arrivals, one compaction


def test_tiers_merge_and_old_versions_stay(spark, store):
    for k in range(7):
        store.append(spark.range(k * 1000, (k + 1) * 1000).repartition(1))
    before = store.shards()
    assert store.version() == 7 and len(before) == 7
    version = store.compact()
    assert version > 7 and len(store.shards()) < 7 and not store.runs(store.shards())
    assert store.read().distinct().count() == 7000 and store.read(3).count() == 3000
    assert store.vacuum() == 0 and store.vacuum(min_age_seconds=0) > 0 and store.read().count() == 7000
    assert all(s.bytes <= 2 * store.target_bytes for s in store.shards())


def test_vacuum_spares_what_is_not_committed_yet(spark, store):
    store.append(spark.range(100))
    version = store.version()
    spark.range(100, 200).write.parquet(f"{store.root}/data/{'0' * 32}")
    draft = store._written(f"data/{'0' * 32}")
    assert store.vacuum() == 0
    store.commit(store.shards() + draft, version)
    assert store.read().count() == 200


def test_each_run_is_a_task_and_a_file_of_its_own(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store", target_bytes=8_000, smallest_bytes=1000, fanout=2)
    for k in range(16):
        store.append(spark.range(k * 1000, (k + 1) * 1000).repartition(1))
    runs = store.runs(store.shards())
    assert len(runs) > 2
    store.compact()
    assert len(store.shards(17)) == len(runs) + 16 - sum(map(len, runs))
    assert sorted(r["id"] for r in store.read().collect()) == list(range(16_000))


def plain_runs(sizes, target, smallest, fanout):
    """Runs by a plain reading of the rule: a tier is a power of the fanout, a run is closed once it reaches the target."""
    def tier(n):
        t = 0
        while n >= smallest * fanout**t:
            t += 1
        return t

    out = []
    for t in range(40):
        members = sorted(n for n in sizes if n < target / 2 and tier(n) == t)
        if len(members) >= fanout:
            while members:
                run = []
                while members and sum(run) < target:
                    run.append(members.pop(0))
                if len(run) > 1 or sum(run) >= target:
                    out.append(run)
    return out


def test_runs_equal_the_plain_rule(store):
    rng = random.Random(3)
    for _ in range(50):
        sizes = [int(10 ** rng.uniform(2, 5)) for _ in range(rng.randrange(0, 60))]
        runs = store.runs([Shard(f"s{i:03d}", n) for i, n in enumerate(sizes)])
        assert [[s.bytes for s in r] for r in runs] == plain_runs(sizes, store.target_bytes, store.smallest_bytes, store.fanout)


def test_only_similar_sizes_meet(store):
    sizes = [1500, 1600, 1700, 9000, 9500, 30_000, 45_000]
    runs = store.runs([Shard(f"s{i}", n) for i, n in enumerate(sizes)])
    assert [[s.bytes for s in r] for r in runs] == [[1500, 1600, 1700]]


def test_a_version_is_committed_once(store):
    store.commit([Shard("a", 1)], 0)
    with pytest.raises(CommitConflict):
        store.commit([Shard("b", 1)], 0)
    assert store.shards() == [Shard("a", 1)]


def test_edge_rows(documents, tmp_path):
    rows = [(None, None), (None, "x"), (1, ""), (2, "same"), (2, "same"), (3, "long " * 100_000)]
    df = documents(rows, shard="1", shard_run="2", version="3", shard_file="4")
    out = sharded(df, f"file://{tmp_path}/a", arrivals=3).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in out if r["doc_id"]) == [(1, 0), (2, 4), (2, 4), (3, 500_000)]
    assert len(out) == 6
    assert sharded(df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_files_of_one_name_in_two_folders_keep_their_rows_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = ShardStore(spark, root, target_bytes=1 << 20, smallest_bytes=1 << 16, fanout=2)
    shards = []
    for k, folder in enumerate(("a" * 32, "b" * 32)):
        spark.range(k * 1000, (k + 1) * 1000).coalesce(1).write.parquet(f"{root}/draft{k}")
        (file,) = (tmp_path / "store" / f"draft{k}").glob("part-*.parquet")
        (tmp_path / "store" / "data" / folder).mkdir(parents=True)
        file.rename(tmp_path / "store" / "data" / folder / "part-0.parquet")
        shards.append(Shard(f"data/{folder}/part-0.parquet", (tmp_path / "store" / "data" / folder / "part-0.parquet").stat().st_size))
    store.commit(shards, 0)
    assert len(store.runs(shards)) == 1
    store.compact()
    assert len(store.shards()) == 1 and sorted(r["id"] for r in store.read().collect()) == list(range(2000))
