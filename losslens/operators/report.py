"""Reports of small result tables: flat and pivoted text tables, Markdown, JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from losslens.operators.evaluate import TASKS

#: The columns of the flat table.
FLAT = "%-12s %-{w}s %9s %10s"


def one_digit(score: Column) -> Column:
    """Rounded as the exact binary value says, ties to even; the JVM's format rounds what the shortest decimal says, ties up."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")

    return F.pandas_udf(run, StringType())(score)


def flat_lines(scores: DataFrame, k: int, width: int) -> DataFrame:
    """``line`` and its sorting columns ``algo`` and ``task``: one line a score, the algo shown on all but OVERALL lines."""
    shown = F.when(F.col("task") == "OVERALL", "").otherwise(F.col("algo"))
    line = F.format_string(FLAT.format(w=width), shown, F.col("task"), one_digit(F.col("score")), F.col("n").cast("string"))
    return scores.select("algo", "task", line.alias("line"))


def flat_header(k: int, width: int) -> list[str]:
    return [FLAT.format(w=width) % ("algo", "io_pred", f"pass@{k}(%)", "n_samples"), "-" * (12 + width + 22)]


def pivot(scores: DataFrame, tasks: list[str] = TASKS) -> DataFrame:
    """(model, algo, a column for each task, n): n of OVERALL, or the sum of the tasks' where that is missing."""
    one = lambda t: F.max(F.when(F.col("task") == t, F.col("score"))).alias(t)
    overall, parts = F.max(F.when(F.col("task") == "OVERALL", F.col("n"))), F.sum(F.when(F.col("task") != "OVERALL", F.col("n")))
    return scores.groupBy("model", "algo").agg(*[one(t) for t in tasks], F.coalesce(overall, parts).alias("n"))


def markdown(rows: DataFrame, most: int = 10_000) -> str:
    """A Markdown table of a result; a result of more than ``most`` rows raises, for that is no report."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *[[cell(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def stats_json(rows: DataFrame, most: int = 10_000) -> str:
    """The rows as a JSON array, with the bound of ``markdown``."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows")
    return json.dumps([r.asDict(True) for r in found], ensure_ascii=False, indent=2, default=str)
