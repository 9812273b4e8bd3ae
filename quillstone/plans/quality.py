"""Figures that tell whether a run over a vendor can be believed, and where another tool says otherwise.

Edge cases: a vendor without findings of a severity counts 0; findings without an operation touch
none; a vendor whose number of old operations is unknown is never called implausible; null operations
of the other tool match nothing; no rows, no figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.plans.drift import BREAKING, OPPORTUNITY, POTENTIAL

#: Fixed value: breaking findings for each operation touched from which a vendor is called dense.
DENSE = 10


def vendor_metrics(findings: DataFrame, operations: DataFrame) -> DataFrame:
    """vendor, old_ops, breaking, potentially, additions, breaking_ops_touched, breaking_per_op (to a tenth, halves to even) and flags, of findings (vendor, severity, method, path) and operations (vendor, old_ops)."""
    of = lambda s: F.count_if(F.col("severity") == s)
    touched = F.count_distinct(F.when((F.col("severity") == BREAKING) & F.col("path").isNotNull(), F.struct(F.coalesce("method", F.lit("")), "path")))
    counts = findings.groupBy("vendor").agg(of(BREAKING).alias("breaking"), of(POTENTIAL).alias("potentially"), of(OPPORTUNITY).alias("additions"), touched.alias("breaking_ops_touched"))
    every = operations.select("vendor", "old_ops").join(counts, "vendor", "full_outer").na.fill(0, ["breaking", "potentially", "additions", "breaking_ops_touched"])
    ops = F.col("breaking_ops_touched")
    every = every.withColumn("breaking_per_op", F.when(ops > 0, F.bround(F.col("breaking") / ops, 1)).otherwise(0.0))
    more = (F.col("old_ops") > 0) & (F.col("breaking") > F.col("old_ops"))
    flags = F.array_compact(F.array(
        F.when(more, F.concat(F.lit("implausible: "), "breaking", F.lit(" breaking of "), "old_ops", F.lit(" operations"))), F.when(F.col("breaking_per_op") >= DENSE, F.concat(F.lit("dense: "), "breaking_per_op", F.lit(" breaking an operation"))),
    ))
    return every.select("vendor", "old_ops", "breaking", "potentially", "additions", "breaking_ops_touched", "breaking_per_op", F.array_join(flags, "; ").alias("flags"))


def window_flag(observed_days: Column, requested_days: Column) -> Column:
    """What to say of a history shorter than what was asked for; '' if it is not."""
    return F.when(observed_days < requested_days, F.concat(F.lit("window: "), observed_days, F.lit(" of "), requested_days, F.lit(" days"))).otherwise("")


def only_theirs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows of theirs (vendor, op_key, ...) on operations of which ours (vendor, severity, op_key) holds nothing breaking."""
    known = ours.where(F.col("severity") == BREAKING).select("vendor", "op_key").distinct()
    return theirs.join(known, ["vendor", "op_key"], "left_anti")


def disagreement(ours: DataFrame, theirs: DataFrame, noisy: list[str] = ()) -> DataFrame:
    """vendor, rule, said (by the other tool), unmatched: for each of its rules but the noisy ones."""
    signal = theirs.where(~F.coalesce(F.col("rule").isin(list(noisy)), F.lit(False)))
    lone = only_theirs(ours, signal).groupBy("vendor", "rule").agg(F.count(F.lit(1)).alias("unmatched"))
    said = signal.groupBy("vendor", "rule").agg(F.count(F.lit(1)).alias("said"))
    same = said["vendor"].eqNullSafe(lone["vendor"]) & said["rule"].eqNullSafe(lone["rule"])
    return said.join(lone, same, "left").select(said["vendor"], said["rule"], "said", F.coalesce("unmatched", F.lit(0)).alias("unmatched"))


def with_prospects(findings: DataFrame, prospects: DataFrame) -> DataFrame:
    """Findings with the query, score and rank of the prospect of their vendor and root cause; null where there is none."""
    return findings.join(prospects.select("vendor", "root_cause", "query", "score", "rank"), ["vendor", "root_cause"], "left")
