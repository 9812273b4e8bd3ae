"""A scan of a checkout: which changes land on which line, and what could not be measured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.code.facts import facts as facts_of
from quillstone.plans import dependence, drift
from quillstone.sources import files
from quillstone.sources.scratch import cut

#: Opportunities shown, and their order by kind.
MOST_OPPORTUNITIES = 12
KIND_ORDER = ["spec_added", "endpoint_added", "schema_field_added", "response_field_added"]


@dataclass
class Scan:
    impacts: DataFrame
    incidental: DataFrame
    opportunities: DataFrame
    dropped: int
    unmeasured: DataFrame
    pinned: DataFrame
    vendors_detected: DataFrame
    additions_by_kind: DataFrame
    verdicts: DataFrame

    def exit_status(self, exit_zero: bool = False) -> int:
        """1 if a breaking change lands anywhere but in tests and examples."""
        return 0 if exit_zero else int(not self.impacts.where(F.col("severity") == drift.BREAKING).isEmpty())


def scan(checkout: DataFrame, findings: DataFrame, vendors: DataFrame) -> Scan:
    """A scan of files (repo, path, n_bytes, text) against annotated findings."""
    checkout = cut(checkout)
    base = F.element_at(F.split("path", "/"), -1)
    sources = checkout.where(files.is_candidate(F.col("path"), F.col("n_bytes")))
    detected = cut(files.detect_vendors(sources, vendors))
    speaking = sources.join(detected.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    facts = cut(facts_of(speaking))
    found = cut(dependence.identified(findings.join(detected.select("vendor").distinct(), "vendor", "left_semi")))
    breaks, additions = found.where(F.col("severity") != drift.OPPORTUNITY), found.where(F.col("severity") == drift.OPPORTUNITY)
    # for a vendor whose calls are pinned to a version, what changed since reaches only who moves it
    versioned = vendors.where("versioned").select(F.col("key").alias("vendor"))
    pins = facts.where("fact = 'pin'").join(detected.select("repo", "path", "vendor"), ["repo", "path"]).join(versioned, "vendor", "left_semi")
    pinned = files.pinned_versions(pins.select("repo", "path", "vendor").distinct(), files.declarations(checkout.where(base.isin(files.MANIFESTS)), vendors))
    judged = cut(dependence.verdicts(speaking, facts, breaks, detected, vendors))
    hits = judged.where(F.col("verdict") == dependence.CONFIRMED).withColumn("is_incidental", files.is_incidental(F.col("path")))
    order = ["vendor", "repo", "path", "line", "subject"]
    first = dependence.relevance(facts, additions, detected, vendors).join(additions.select("finding_id", "vendor", "kind", "subject", "blurb", "resource"), "finding_id")
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    n = first.count()
    return Scan(
        hits.where("not is_incidental").orderBy(*order), hits.where("is_incidental").orderBy(*order), first.orderBy(rank, "vendor", "subject").limit(MOST_OPPORTUNITIES), max(0, n - MOST_OPPORTUNITIES),
        files.unmeasured(sources, detected), pinned, detected.groupBy("vendor").agg(F.count(F.lit(1)).alias("n")), additions.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), judged,
    )
