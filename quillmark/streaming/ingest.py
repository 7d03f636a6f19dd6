"""Arriving documents compared with all that came before, in micro-batches.

Each batch is fingerprinted, joined with the stored fingerprints and with itself, and then added to the
store.  Batches write to a folder named by their number and replace it when they run again, so a
batch repeated after a failure leaves the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import VerbatimParams
from ..operators import verbatim as V


def watch(docs: DataFrame, root: str, checkpoint: str, params: VerbatimParams = VerbatimParams()) -> StreamingQuery:
    """Start comparing a stream of ``doc_id, text``; pairs go to ``root/pairs``, fingerprints to ``root/prints``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = V.usable(V.fingerprints(V.plain_streams(batch), params), params).select("doc_id", "h", "positions")
        new.write.mode("overwrite").parquet(f"{root}/prints/batch={number}")
        stored = spark.read.schema("doc_id long, h long, positions array<int>, batch long").option("basePath", f"{root}/prints").parquet(f"{root}/prints")
        fresh = stored.where(F.col("batch") == number).drop("batch")
        old = stored.where(F.col("batch") < number).drop("batch")
        pairs = V.shared_fingerprints(old, fresh).unionByName(V.shared_fingerprints(fresh, fresh, ordered=True))
        pairs.write.mode("overwrite").parquet(f"{root}/pairs/batch={number}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
