"""Verdict tables and their aggregates: pass@k, accuracy, comparison, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The prediction tasks in their canonical order.
TASKS = ["output_execution_prediction", "input_execution_prediction", "output_inversion_prediction", "input_inversion_prediction"]
# Prices in USD for a million tokens: prefix of the model's name,
# input, cached input, output; the first prefix that fits counts.
PRICES = [("gpt-4.1-mini", 0.40, 0.10, 1.60), ("gpt-4.1-nano", 0.10, 0.025, 0.40), ("gpt-4.1", 2.00, 0.50, 8.00), ("gpt-4o-mini", 0.15, 0.075, 0.60), ("gpt-4o", 2.50, 1.25, 10.00)]


def task_of(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TASKS)), (n + 1).cast("int"))


def pass_at_k(rows: DataFrame, k: int, keys: list[str], task: str = "io_pred", order: str = "ord", status: str = "status") -> DataFrame:
    """Percent of groups with a correct one among their first k statuses, for each task and over all.

    The window over few keys gets a WindowGroupLimit, so a hot group sends k
    rows from each task at most.
    """
    first = Window.partitionBy(*keys, task).orderBy(order)
    hit = rows.select(*keys, task, order, (F.lower(F.trim(status)) == "correct").cast("int").alias("hit")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    groups = hit.groupBy(*keys, task).agg(F.max("hit").alias("hit"))
    return groups.rollup(task).agg((F.avg("hit") * 100).alias("pass_at_k"), F.count("*").alias("n_groups")).select(F.coalesce(task, F.lit("OVERALL")).alias(task), F.round("pass_at_k", 4).alias("pass_at_k"), "n_groups")


def accuracy(rows: DataFrame, task: str = "io_pred", status: str = "status") -> DataFrame:
    """Share of correct rows for each task and over all."""
    hit = (F.lower(F.trim(status)) == "correct").cast("double")
    return rows.rollup(task).agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count("*").alias("n")).select(F.coalesce(task, F.lit("OVERALL")).alias(task), "accuracy", "n")


def compare(left: DataFrame, right: DataFrame, task: str = "io_pred") -> DataFrame:
    """Accuracies of two runs side by side and their difference; a task that one lacks has null there."""
    a, b = accuracy(left, task).select(task, F.col("accuracy").alias("base")), accuracy(right, task).select(task, F.col("accuracy").alias("other"))
    return a.join(b, task, "full").select(task, "base", "other", F.round(F.col("other") - F.col("base"), 6).alias("delta"))


def usage(results: DataFrame) -> DataFrame:
    """Requests, tokens and cost of each model, and a TOTAL row that sums the costs of priced models."""
    spark = results.sparkSession
    tokens = ["requests", "input_tokens", "cached_tokens", "output_tokens"]
    sums = results.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(*[F.sum(F.coalesce(t, F.lit(0))).cast("long").alias(t) for t in tokens])
    prices = F.broadcast(spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], "place int, prefix string, p_in double, p_cached double, p_out double"))
    fits = sums.join(prices, F.expr("startswith(model, prefix)"), "left")
    best = fits.groupBy("model", *tokens).agg(F.min_by(F.struct("p_in", "p_cached", "p_out"), "place").alias("p"))
    cost = (F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0)) * F.col("p.p_in") + F.col("cached_tokens") * F.col("p.p_cached") + F.col("output_tokens") * F.col("p.p_out")) / 1e6
    rows = best.withColumn("cost", cost)
    return rows.rollup("model").agg(*[F.sum(t).cast("long").alias(t) for t in tokens], F.round(F.sum("cost"), 6).alias("cost")).withColumn("model", F.coalesce("model", F.lit("TOTAL")))
