"""Data-quality tests: every row-level test of a table in one pass, set-level tests as plans of their own."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Test:
    """A test with its number of failing rows: ``failing`` is a row-level condition, or ``failures`` a one-row frame with column ``failures``."""

    name: str
    column: str
    failing: Column | None = None
    failures: DataFrame | None = None
    severity: str = "error"


def not_null(column: str, severity: str = "error") -> Test:
    return Test("not_null", column, F.col(column).isNull(), severity=severity)


def accepted_values(column: str, values: list, severity: str = "error") -> Test:
    return Test("accepted_values", column, F.col(column).isNotNull() & ~F.col(column).isin(values), severity=severity)


def accepted_range(column: str, low=None, high=None, inclusive: bool = True, severity: str = "error") -> Test:
    if low is None and high is None:
        raise ValueError("a range needs a bound")
    bad = F.lit(False)
    if low is not None:
        bad = bad | ((F.col(column) < low) if inclusive else (F.col(column) <= low))
    if high is not None:
        bad = bad | ((F.col(column) > high) if inclusive else (F.col(column) >= high))
    return Test("accepted_range", column, F.coalesce(bad, F.lit(False)), severity=severity)


def not_null_where(column: str, condition: Column, severity: str = "error") -> Test:
    return Test("not_null_where", column, F.coalesce(condition, F.lit(False)) & F.col(column).isNull(), severity=severity)


def expression(condition: Column, column: str = "", severity: str = "error") -> Test:
    """Rows where the condition isn't true; null fails."""
    return Test("expression", column, ~F.coalesce(condition, F.lit(False)), severity=severity)


def unique(df: DataFrame, column: str, severity: str = "error") -> Test:
    """All rows of groups of equal values fail; nulls are ignored."""
    groups = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return Test("unique", column, failures=groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failures")), severity=severity)


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str, severity: str = "error") -> Test:
    """Child keys without a parent fail; null keys pass."""
    orphans = child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias("_p")), F.col(column) == F.col("_p"), "left_anti")
    return Test("relationships", column, failures=orphans.agg(F.count(F.lit(1)).alias("failures")), severity=severity)


def freshness(df: DataFrame, column: str, max_age_s: float, now: str, severity: str = "error") -> Test:
    """One failure if the newest time is over ``max_age_s`` before ``now``, or there is none."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(column).cast("timestamp"))
    return Test("freshness", column, failures=df.agg(F.when(age <= max_age_s, 0).otherwise(1).alias("failures")), severity=severity)


def run_suite(df: DataFrame, tests: list[Test]) -> DataFrame:
    """(test, column, severity, failures, passed) of every test; row-level ones share one scan of ``df``."""
    if bad := [t.severity for t in tests if t.severity not in ("error", "warn")]:
        raise ValueError(f"unknown severity {bad[0]}")
    plans = []
    if own := [t for t in tests if t.failing is not None]:
        counts = df.agg(*[F.count_if(t.failing).alias(f"t{i}") for i, t in enumerate(own)])
        rows = [F.struct(F.lit(t.name).alias("test"), F.lit(t.column).alias("column"), F.lit(t.severity).alias("severity"), F.col(f"t{i}").alias("failures")) for i, t in enumerate(own)]
        plans.append(counts.select(F.inline(F.array(*rows))))
    plans += [t.failures.select(F.lit(t.name).alias("test"), F.lit(t.column).alias("column"), F.lit(t.severity).alias("severity"), F.col("failures").cast("long").alias("failures")) for t in tests if t.failures is not None]
    return reduce(DataFrame.unionByName, plans).withColumn("passed", F.col("failures") == 0)


def suite_failed(summary: DataFrame) -> bool:
    return not summary.where((F.col("severity") == "error") & ~F.col("passed")).isEmpty()


def validate_in_order(df: DataFrame, rules: list[tuple[str, Column]], key: list[str], order: list[str]) -> DataFrame:
    """Rows with ``reject_reason``: the first rule that holds, else 'duplicate' for all but the first surviving row of a key, else null."""
    from pyspark.sql import Window

    reason = F.lit(None).cast("string")
    for name, failing in reversed(rules):
        reason = F.when(F.coalesce(failing, F.lit(False)), name).otherwise(reason)
    marked = df.withColumn("_r", reason)
    first = F.row_number().over(Window.partitionBy(*key, F.col("_r").isNull()).orderBy(*order))
    return marked.withColumn("_n", first).withColumn("reject_reason", F.when(F.col("_r").isNotNull(), F.col("_r")).when(F.col("_n") > 1, "duplicate")).drop("_r", "_n")


def validation_report(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("reject_reason", F.lit("clean")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
