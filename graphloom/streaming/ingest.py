"""Edges that keep coming: lines parsed as they arrive, and degrees kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.skew import edge_ends
from graphloom.sources.lines import parse_lines

EDGES = T.StructType([T.StructField("edge_id", T.LongType()), T.StructField("file_id", T.IntegerType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("noted_at", T.TimestampType()), T.StructField("loaded_at", T.TimestampType())])


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The edge records of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(EDGES).parquet(folder)


def running_entries(edges: DataFrame) -> DataFrame:
    """``(v, entries)``: of each vertex the rows of which it is an end, so far. State: one number per vertex."""
    return edge_ends(edges).groupBy("v").agg(F.count("*").alias("entries"))


def edges_per_window(edges: DataFrame, seconds: int = 86_400) -> DataFrame:
    """``(start, edges)``: records per window of ``noted_at``, so far; late ones count in their window, and those without a time under a null start, so the counts add up to all records. State: one number per window."""
    width = F.lit(seconds * 1_000_000)
    at = F.unix_micros("noted_at")
    start = F.timestamp_micros(at - F.pmod(at, width))
    return edges.groupBy(start.alias("start")).agg(F.count("*").alias("edges"))


def load_lines(raw: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Parses a stream of lines; valid records go to the folder ``good``, broken ones with their reason to ``bad``, each batch once."""

    def sink(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch, with_edits=True).persist()
        parsed.where(F.col("reason").isNull()).select("line_id", "begin", "end", "tag", "remark").write.mode("overwrite").parquet(f"{good}/batch={number}")
        parsed.where(F.col("reason").isNotNull()).select("line_id", "reason", "edits", "repaired").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        parsed.unpersist()

    return raw.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
