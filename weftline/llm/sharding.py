"""A shard store with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable Parquet shards. Compaction merges runs of
shards of one size tier into files of about the target size, in one Spark job for
all runs. A manifest lists the live shards of a version; it's written beside and
moved into place, and the move fails where that version exists, so of two writers
one commits and the other begins anew. Readers see whole versions only. Only file
names and sizes pass through the driver; all file access is by Hadoop's file
systems. Several writers need a file system whose rename fails onto an existing
name in one step (HDFS, local and shared disks); on an object store without that,
let one writer commit.
"""

from __future__ import annotations

import itertools
import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files that one round of compaction reads; further runs wait for the next round.
MOST_FILES = 50_000


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    bytes: int


class ShardStore:
    def __init__(
        self, spark: SparkSession, root: str, *, target_bytes: int = 256 << 20, smallest_bytes: int = 1 << 20, fanout: int = 4
    ):
        """Tiers grow by the factor `fanout` from `smallest_bytes`; so many shards of a tier make a run."""
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.smallest_bytes, self.fanout = target_bytes, smallest_bytes, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # Manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:08d}.json"

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], after: int) -> int:
        """Make `shards` the version behind `after`; CommitConflict where that exists."""
        body = json.dumps({"version": after + 1, "shards": [asdict(s) for s in shards]})
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf) if draft.toUri().getScheme() else (
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        )
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = kind.getEnumConstants()[0]  # NONE: never onto a file that exists
        try:
            files.rename(draft, self._path(self._manifest(after + 1)), options)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise CommitConflict(f"version {after + 1} exists") from error
            raise
        return after + 1

    # Data

    def _listed(self, folder: str) -> list[tuple[Shard, int]]:
        """Data files below a folder, each with the time of its last change in milliseconds."""
        if not self._fs.exists(self._path(f"{self.root}/{folder}")):
            return []
        found, files = [], self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
        while files.hasNext():
            status = files.next()
            path = status.getPath().toString()
            if path.endswith(".parquet"):
                found.append((Shard(path[path.rindex(f"/{folder}/") + 1 :], status.getLen()), status.getModificationTime()))
        return found

    def _written(self, folder: str) -> list[Shard]:
        return sorted((s for s, _ in self._listed(folder)), key=lambda s: s.path)

    def _count(self, paths: list[str]) -> int:
        """Rows of these files, by their footers."""
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in paths)).count() if paths else 0

    def append(self, arrivals: DataFrame) -> int:
        """Write `arrivals`, a shard a partition, and commit; the new version.

        Rows are stored as they are: nulls, empty texts, ties and repeats stay, and
        columns keep their names. An empty table commits a version with the shards
        before it and files without rows, if Spark writes any.
        """
        folder = f"data/{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._add(self._written(folder))

    def append_each(self, rows: DataFrame, arrival: Column, n: int) -> int:
        """Write rows that came in `n` arrivals (`arrival`: 0 to n - 1) in one scan, and commit each as a version of its own."""
        folder = f"data/{(name := uuid.uuid4().hex)}"
        number = f"arrival_{name}"  # no column of the rows has this name
        rows.withColumn(number, arrival).write.option("compression", "zstd").partitionBy(number).parquet(f"{self.root}/{folder}")
        written = self._written(folder)
        for k in range(n):
            version = self._add([s for s in written if s.path.startswith(f"{folder}/{number}={k}/")])
        return version

    def _add(self, new: list[Shard]) -> int:
        while True:
            version = self.version()
            try:
                return self.commit(self.shards(version) + new, version)
            except CommitConflict:
                continue

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest_bytes, self.fanout)) + 1)

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """What to merge: shards of one tier below the target, in runs of about the target size.

        Of a tier with fewer than `fanout` shards nothing is merged yet.
        """
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes / 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        found = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fanout:
                continue
            run, size = [], 0
            for s in sorted(members, key=lambda s: (s.bytes, s.path)):
                run.append(s)
                size += s.bytes
                if size >= self.target_bytes:
                    found.append(run)
                    run, size = [], 0
            if len(run) > 1:
                found.append(run)
        most = itertools.takewhile(lambda x: x[0] <= MOST_FILES, zip(itertools.accumulate(map(len, found)), found))
        return [run for _, run in most] or [run[:MOST_FILES] for run in found[:1]]

    def compact(self) -> int:
        """Merge what `runs` names and commit, until no run is left; the version. A lost race begins anew.

        Rows keep their values and repeats; an empty store stays as it is.
        """
        while runs := self.runs(before := self.shards(version := self.version())):
            folder = f"data/{(name := uuid.uuid4().hex)}"
            file, number = f"file_{name}", f"run_{name}"  # no column of the rows has these names
            run_of = {s.path: k for k, run in enumerate(runs) for s in run}
            names = self.spark.createDataFrame(list(run_of.items()), f"{file} string, {number} int")
            rows = self.spark.read.parquet(*(f"{self.root}/{p}" for p in run_of))
            # Files of different runs may share a name, so the path below the store's folder tells them apart.
            rows = rows.select("*", F.regexp_extract("_metadata.file_path", "^.*/(data/[0-9a-f]{32}/.+)$", 1).alias(file))
            # Each run goes to a task of its own, which writes one file of about the target size.
            # The list that is broadcast has MOST_FILES names at most.
            merged = rows.join(F.broadcast(names), file).drop(file).repartitionById(len(runs), F.col(number))
            merged.write.option("compression", "zstd").partitionBy(number).parquet(f"{self.root}/{folder}")
            written = self._written(folder)
            if (had := self._count(list(run_of))) != (has := self._count([s.path for s in written])):
                raise RuntimeError(f"{had} rows became {has} in {folder}; nothing is committed")
            try:
                self.commit([s for s in before if s.path not in run_of] + written, version)
            except CommitConflict:
                continue
        return version

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with the hidden column `_metadata`; None where it has no shard."""
        shards = self.shards(version)
        return self.spark.read.parquet(*(f"{self.root}/{s.path}" for s in shards)) if shards else None

    def vacuum(self, keep: int = 1, min_age_seconds: float = 86_400) -> int:
        """Delete data that none of the last `keep` versions lists; the number of deleted files.

        Files younger than `min_age_seconds` stay: a writer may be about to commit
        them. Choose an age beyond the longest append or compaction. An empty store
        has nothing to delete.
        """
        before = (time.time() - min_age_seconds) * 1000
        old = [s for s, changed in self._listed("data") if changed <= before]  # listed before the versions are read
        version = self.version()
        live = {s.path for v in range(max(1, version - keep + 1), version + 1) for s in self.shards(v)}
        old = [s for s in old if s.path not in live] if version else []
        for s in old:
            self._fs.delete(self._path(f"{self.root}/{s.path}"), False)
        return len(old)


def sharded(docs: DataFrame, root: str, *, arrivals: int = 8, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Append `docs` in `arrivals` parts, compact, and read the last version back.

    (doc_id, n_chars, text_sha256, shard, shard_bytes, version) per row: the text as it was
    read back (null: null) and the file that holds the row. Ids deal the parts; null
    ids go to the first. Rows repeat as they came, and every column of `docs` is stored under its name. An
    empty table gives an empty table.
    """
    store = ShardStore(docs.sparkSession, root, **sizes)
    arrival = F.when(F.col(id_col).isNull(), 0).otherwise(F.pmod(F.xxhash64(id_col), F.lit(arrivals))).cast("int")
    store.append_each(docs, arrival, arrivals)
    version = store.compact()
    if (rows := store.read(version)) is None:
        rows = docs.limit(0).withColumn("_metadata", F.struct(F.lit("").alias("file_name"), F.lit(0).cast("long").alias("file_size")))
    return rows.select(
        F.col(id_col).alias("doc_id"),
        F.length(text_col).cast("long").alias("n_chars"),
        F.sha2(F.col(text_col).cast("binary"), 256).alias("text_sha256"),
        F.col("_metadata.file_name").alias("shard"),
        F.col("_metadata.file_size").alias("shard_bytes"),
        F.lit(version).cast("long").alias("version"),
    )
