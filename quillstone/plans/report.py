"""Findings and scans as JSON and as text to read. Only what is shown comes to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import names
from quillstone.operators.collapse import top_k
from quillstone.plans import drift
from quillstone.plans.scan import Scan

#: Findings shown of a vendor, and operations of a finding.
MOST, MOST_OPS = 12, 25
SEVERITIES = (drift.BREAKING, drift.POTENTIAL, drift.OPPORTUNITY)


def as_json(findings: DataFrame) -> DataFrame:
    """vendor and json: findings as one JSON object each, ready to be written; methods in capitals, operations cut."""
    shown = findings.withColumn("method", F.upper("method")).withColumn("label", names.label(F.col("kind"))).withColumn("affected_ops", F.slice("affected_ops", 1, MOST_OPS))
    return shown.select("vendor", F.to_json(F.struct(*[c for c in shown.columns if c != "vendor"])).alias("json"))


def by_vendor(findings: DataFrame) -> DataFrame:
    """vendor and document: one JSON document for each vendor, findings in the order of a report."""
    order = F.struct(drift.severity_rank(F.col("severity")).alias("s"), "spec_file", "path", "method", "kind", "subject")
    keyed = as_json(findings.withColumn("_order", order)).select("vendor", "json")
    held = keyed.groupBy("vendor").agg(F.array_sort(F.collect_list(F.struct(F.get_json_object("json", "$._order").alias("o"), "json"))).alias("f"))
    return held.select("vendor", F.concat(F.lit('{"vendor":"'), "vendor", F.lit('","findings":['), F.array_join(F.transform("f", lambda x: x["json"]), ","), F.lit("]}")).alias("document"))


def write_by_vendor(findings: DataFrame, path: str) -> None:
    """A file of JSON lines in a folder for each vendor."""
    as_json(findings).write.mode("overwrite").partitionBy("vendor").text(path)


def read_findings(spark, path: str) -> DataFrame:
    """What write_by_vendor wrote, as findings again."""
    lines = spark.read.text(path).select("vendor", F.from_json("value", _schema()).alias("f"))
    return lines.select("vendor", "f.*")


def _schema() -> str:
    kinds = {"occurrences": "bigint", "affected_op_count": "bigint", "direct_op_count": "bigint", "affected_ops": "array<string>", "leaf_fields": "array<string>", "in_request": "boolean", "in_response": "boolean"}
    return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in drift.FINDING if c != "vendor")


def to_markdown(findings: DataFrame, days: int) -> str:
    """A summary table, and of each vendor the first MOST findings with how many there are beyond."""
    counts = findings.groupBy("vendor").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]).orderBy("vendor").collect()
    order = [drift.severity_rank(F.col("severity")), F.desc("affected_op_count"), F.asc("kind"), F.asc("subject"), F.asc("op_key")]
    rows = top_k(findings.select("vendor", "severity", "kind", "subject", "detail", "op_key", "affected_op_count", names.label(F.col("kind")).alias("label")), "vendor", order, MOST).orderBy("vendor", "rank").collect()
    out = [f"# Changes of the last {days} days", "", "| Vendor | Breaking | Potentially breaking | New |", "|---|---:|---:|---:|"]
    out += [f"| {r.vendor} | {r[drift.BREAKING]} | {r[drift.POTENTIAL]} | {r[drift.OPPORTUNITY]} |" for r in counts]
    for c in counts:
        out += ["", f"## {c.vendor}", ""]
        mine = [r for r in rows if r.vendor == c.vendor]
        out += [f"- **{r.label}** `{r.subject}` ({r.severity}): {r.detail}" for r in mine]
        if mine and mine[0].dropped:
            out.append(f"- and {mine[0].dropped} more")
    return "\n".join(out) + "\n"


def lines_of(impacts: DataFrame) -> DataFrame:
    """text: an impact in a line, as path:line: severity, what, and why."""
    return impacts.select(F.concat("path", F.lit(":"), "line", F.lit(": "), "severity", F.lit(": "), names.label(F.col("kind")), F.lit(" `"), "subject", F.lit("` ("), "vendor", F.lit("): "), F.array_join("chain", "; ")).alias("text"))


def _sections(s: Scan, most: int) -> list[tuple[str, int, list[str]]]:
    """Title, number of lines and the first `most` lines of each section of a scan."""
    at = lambda *parts: F.concat(*parts).alias("text")
    rows = {
        "impacts": lines_of(s.impacts), "in tests and examples": lines_of(s.incidental),
        "not measured": s.unmeasured.orderBy("vendor", "language").select(at("vendor", F.lit(": "), "n", F.lit(" "), "language", F.lit(" files"))),
        "pinned": s.pinned.orderBy("repo", "vendor").select(at("vendor", F.lit(" at "), "declared", F.lit(" in "), "repo")),
        "opportunities": s.opportunities.select(at("vendor", F.lit(": "), names.label(F.col("kind")), F.lit(" `"), "subject", F.lit("`, near "), "path", F.lit(":"), "line")),
    }
    out = []
    for title, lines in rows.items():
        shown = [r.text for r in lines.limit(most + 1).collect()]
        n = len(shown) if len(shown) <= most else lines.count()
        out.append((title, n + s.dropped if title == "opportunities" else n, shown[:most]))
    return out


def scan_text(s: Scan, most: int = 1000) -> str:
    """A scan to read: impacts, what was met in tests only, what could not be measured, pinned vendors and opportunities. The first `most` lines of a section, and how many there are."""
    out = []
    for title, n, lines in _sections(s, most):
        out += [f"{title}: {n}", *(f"  {x}" for x in lines), *([f"  and {n - len(lines)} more"] if n > len(lines) else [])]
    return "\n".join(out) + "\n"


def scan_markdown(s: Scan, most: int = 1000) -> str:
    """The same as Markdown: a heading for each section, but for those that are empty, of which the impacts say so."""
    out = ["# Scan", ""]
    for title, n, lines in _sections(s, most):
        if n or title == "impacts":
            out += [f"## {title.capitalize()} ({n})", "", *(f"- {x}" for x in lines or ["none"]), *([f"- and {n - len(lines)} more"] if n > len(lines) else []), ""]
    return "\n".join(out)


def write_scan(s: Scan, form: str, path: str | None = None, exit_zero: bool = False) -> int:
    """Write a scan as text, markdown or json to a file, or print it; the exit status."""
    text = {"text": scan_text, "markdown": scan_markdown, "json": scan_json}[form](s)
    if path is None:
        print(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return s.exit_status(exit_zero)


def brief_lines(findings: DataFrame) -> DataFrame:
    """vendor, rank, text: the lines of each vendor's brief, of all its findings: a title, how many there are of each severity, and a line each.

    A null detail is left out. Ranks order lines, they are not numbers of lines; findings of equal
    severity go by kind, subject and operation. No findings, no lines.
    """
    order = F.struct(drift.severity_rank(F.col("severity")).cast("int").alias("s"), "kind", "subject", F.coalesce("op_key", F.lit("")).alias("op"))
    said = F.concat(F.lit("- **"), names.label(F.col("kind")), F.lit("** `"), "subject", F.lit("` ("), "severity", F.lit(")"), F.coalesce(F.concat(F.lit(": "), "detail"), F.lit("")))
    each = findings.select("vendor", order.alias("rank"), said.alias("text"))
    at = lambda n: F.struct(F.lit(n).alias("s"), F.lit("").alias("kind"), F.lit("").alias("subject"), F.lit("").alias("op"))
    counts = findings.groupBy("vendor").agg(F.concat_ws(", ", *[F.concat(F.count_if(F.col("severity") == v), F.lit(f" {v}")) for v in SEVERITIES]).alias("text"))
    heads = counts.select("vendor", at(-2).alias("rank"), F.concat(F.lit("# "), "vendor").alias("text")).unionByName(counts.select("vendor", at(-1).alias("rank"), "text"))
    return heads.unionByName(each)


def write_briefs(findings: DataFrame, path: str) -> None:
    """A folder of Markdown lines for each vendor, in the order of the names of its files: a vendor of many findings is split over several."""
    lines = brief_lines(findings).repartitionByRange("vendor", "rank").sortWithinPartitions("vendor", "rank")
    lines.select("vendor", "text").write.mode("overwrite").partitionBy("vendor").text(path)


def scan_json(s: Scan) -> str:
    """The same as one JSON document."""
    rows = lambda d: [r.asDict(True) for r in d.collect()]
    parts = {k: rows(getattr(s, k)) for k in ("impacts", "incidental", "opportunities", "unmeasured", "pinned", "vendors_detected", "additions_by_kind")}
    return json.dumps(parts | {"dropped": s.dropped}, default=str, sort_keys=True)
