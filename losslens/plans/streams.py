"""Queries that run streams: verification with a restart, an append sink, a paged source that grows."""

from __future__ import annotations

from pyspark.sql import functions as F

from losslens.operators.evaluate import task_of
from losslens.plans.evaluation import VERIFIED_SQL
from losslens.plans.registry import query
from losslens.plans.samples import USAGE_SQL, daily_usage, usage_of
from losslens.sources import scans
from losslens.sources.appends import CommittedLines, append_lines, committed_lines
from losslens.sources.saved import fresh
from losslens.streaming.verification import run_verification, status_counts

ITEM = ["itemid", "ioid", "io_pred"]
OUTPUTS = "ord long, itemid long, ioid long, io_pred string, quality long, toxic long"


def judge(row: dict) -> str:
    """Good and clean is correct, toxic is no answer."""
    return "correct" if row["quality"] == 1 and row["toxic"] == 0 else "no answer" if row["toxic"] == 1 else "wrong"


@query("R1 R2 A4 A31", f"WITH {VERIFIED_SQL} SELECT itemid, ioid, io_pred, ord, status, count(*) OVER (PARTITION BY itemid, ioid, io_pred, status)::BIGINT AS n_status FROM verified", "labels")
def restarted_verification(labels):
    """Outputs verified as they arrive: a first run stops at the end of what is there, a second goes on from its checkpoint and skips what the first has seen."""
    spark, base = labels.sparkSession, fresh(labels.sparkSession, "verification")
    long = lambda c: F.col(c).cast("long")
    rows = labels.select(long("doc_id").alias("ord"), F.expr("CAST(doc_id div 16 AS LONG)").alias("itemid"), (long("doc_id") % 2).alias("ioid"), task_of(F.col("doc_id") % 4).alias("io_pred"), long("quality").alias("quality"), long("toxic").alias("toxic"))
    for name, left_out in (("early", 2), ("late", 0)):  # a third is in both
        rows.where(F.col("ord") % 3 != left_out).write.parquet(f"{base}/outputs/{name}")
        run_verification(spark, f"{base}/outputs", OUTPUTS, ITEM, "ord", judge, f"{base}/verified", f"{base}/checkpoint", chunk=1000)
    done = committed_lines(spark, f"{base}/verified", "itemid long, ioid long, io_pred string, part int, ord long, status string, so_far long")
    return done.join(status_counts(done, ITEM).withColumnRenamed("n", "n_status"), [*ITEM, "status"]).select(*ITEM, "ord", "status", "n_status")


@query("R3 K1", "SELECT item_id, sha256(text) AS text_sha256, 1 AS run FROM benchmark UNION ALL SELECT doc_id, sha256(text), 2 FROM documents", "benchmark", "documents")
def appended_lines(benchmark, documents):
    """Two runs append to one sink in chunks of lines."""
    spark, path = benchmark.sparkSession, fresh(benchmark.sparkSession, "appended")
    append_lines(benchmark.select("item_id", "text", F.lit(1).alias("run")), path)
    append_lines(documents.select(F.col("doc_id").alias("item_id"), "text", F.lit(2).alias("run")), path, chunk=500)
    return committed_lines(spark, path, "item_id long, text string, run int").select("item_id", F.sha2("text", 256).alias("text_sha256"), "run")


@query("S9 R3", USAGE_SQL, "documents")
def streamed_usage(documents):
    """A service's pages as a stream: the second run reads what was added to the last page and behind it."""
    spark, base = documents.sparkSession, fresh(documents.sparkSession, "usage")
    spark.dataSource.register(CommittedLines)
    buckets = daily_usage(documents)
    half = buckets.agg(F.percentile_approx("start_time", 0.5)).first()[0]
    for some in (buckets.where(F.col("start_time") < F.lit(half)), buckets):
        scans.write_pages(some, f"{base}/pages")
        stream = scans.stream_pages(spark, client="folder", path=f"{base}/pages")
        stream.writeStream.format("committed_lines").option("path", f"{base}/read").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return usage_of(committed_lines(spark, f"{base}/read", "start long, model string, requests long, input_tokens long, cached_tokens long, output_tokens long"))
