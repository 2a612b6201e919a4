"""Job status as a stream: the latest state of each job, progress, and stories that wait for their continuation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

ORDER = ("ts", "event_id")


def latest(updates: DataFrame) -> DataFrame:
    """Each job's last stage and progress (by ts, then event_id), and how many updates there were. Batch or stream in update mode."""
    at = F.struct(*ORDER)
    return updates.groupBy("job_id").agg(F.max_by("stage", at).alias("stage"), F.max_by("progress", at).alias("progress"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n_updates"))


def progress(updates: DataFrame) -> DataFrame:
    """How far each stage of a job ever came."""
    return updates.groupBy("job_id", "stage").agg(F.max("progress").alias("progress"), F.count(F.lit(1)).alias("n_events"))


def windows(updates: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by stage in tumbling windows; on a stream, later events than `late` are left out once their window is closed."""
    timed = updates.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if updates.isStreaming else timed
    return marked.groupBy(F.window("ts", size), "stage").agg(F.count(F.lit(1)).alias("n_events")).select(F.col("window.start").alias("start"), "stage", "n_events")


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


WAITING = "document_id long, source_id long, target_page long, status string"


def carry_over(pages: DataFrame) -> DataFrame:
    """Sources that wait for a page, on a stream of (document_id, page, source_id, target_page; source_id null: just a page).

    A source is RESOLVED when its target page comes, in this batch or a later one, and PENDING_EXTERNAL while it has not. State is what waits, by document.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = (set(state.get[0]), dict(zip(state.get[1], state.get[2], strict=True))) if state.exists else (set(), {})
        for f in frames:
            known |= {int(p) for p in f["page"].dropna()}
            for s, t in f[["source_id", "target_page"]].dropna().itertuples(index=False):
                waiting[int(s)] = int(t)
        done = {s: t for s, t in waiting.items() if t in known}
        left = {s: t for s, t in waiting.items() if t not in known}
        state.update((sorted(known), [*left], [*left.values()]))
        rows = [(key[0], s, t, "RESOLVED") for s, t in sorted(done.items())] + [(key[0], s, t, "PENDING_EXTERNAL") for s, t in sorted(left.items())]
        yield pd.DataFrame(rows, columns=["document_id", "source_id", "target_page", "status"])

    return pages.groupBy("document_id").applyInPandasWithState(step, WAITING, "known array<long>, sources array<long>, targets array<long>", "update", GroupStateTimeout.NoTimeout)


def carried(pages: DataFrame) -> DataFrame:
    """R02 on a whole table: the same states by a join."""
    sources = pages.filter("source_id IS NOT NULL AND target_page IS NOT NULL").select("document_id", "source_id", "target_page")
    known = pages.filter("page IS NOT NULL").select("document_id", F.col("page").alias("target_page")).distinct().withColumn("here", F.lit(True))
    return sources.join(known, ["document_id", "target_page"], "left").select("document_id", "source_id", "target_page", F.when(F.col("here"), "RESOLVED").otherwise("PENDING_EXTERNAL").alias("status"))
