"""Rules over streams: the lowered plan of a rule is the same for a stream of records.

Sources may be streaming or static; a stream joins static classes row by row.
Duplicate identifiers are dropped within a watermark, so state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.rules import Catalog, Rule, lower


def stream_targets(rule: Rule, catalog: Catalog, *, event_time: str | None = None, watermark: str = "1 hour", **strategies) -> DataFrame:
    """The target objects of a rule with a streaming source.

    With `event_time`, an attribute of the target, an identifier that comes again
    within `watermark` is dropped. The strategies are those of `lower`.
    """
    targets = lower(rule, catalog, **strategies).targets
    if not targets.isStreaming:
        raise ValueError(f"rule {rule.id} has no streaming source")
    if event_time:
        targets = targets.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["_output", "_class", "_oid"])
    return targets


def write_targets(targets: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append objects below `path` by class; `once` takes what is there and ends."""
    writer = targets.writeStream.format("parquet").partitionBy("_class").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
