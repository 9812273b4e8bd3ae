"""Which findings a file can depend on at all, told from its words before any proof.

An inverted index: every file is its distinct terms, every finding the terms one of which a proof
would need, and pairs come from a join of the two, so a file and a finding that share no term never
meet. A term is a run of letters, digits and _, without _ and case and in the singular, so it is
coarser than what proofs compare: a pair that is left out could not have been proven (names written
with escapes aside). Each pair is then held against a Bloom filter of the file's terms for all other
parts of the name that the proof needs.

Edge cases: a finding without terms (its name has no letters, or it is looked for by a single name's
beginning) meets every file of its vendor; a null text has no terms; repeated rows count once; empty
tables give no pairs.

Skew: a term that all files hold and many findings need gives the pairs that are there to prove; it
is joined with the distinct (vendor, term) of findings first, and AQE may split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import paths

#: Bits of a file's filter, and how many of them a term sets.
BITS, SETS = 1 << 15, 3
RUN = "[A-Za-z0-9_]+"
FILE = ["repo", "path"]


def term(run: Column) -> Column:
    """A run as a term: lower case, no _, no plural s."""
    return F.regexp_replace(F.lower(F.regexp_replace(run, "[^A-Za-z0-9]", "")), "s$", "")


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))


def longest(texts: Column) -> Column:
    """The longest run of some texts; null without one."""
    return F.get(F.sort_array(F.transform(texts, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), F.lit(0))["r"]


def file_terms(sources: DataFrame) -> DataFrame:
    """repo, path, term: each term of each file once."""
    return sources.select(*FILE, F.explode(F.array_distinct(F.transform(runs(F.col("text")), term))).alias("term")).where("term <> ''").distinct()


def _bit(t: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(t, F.lit(k)), F.lit(BITS)).cast("int")


def filters(terms: DataFrame) -> DataFrame:
    """repo, path, bloom: a bitmap of BITS bits of each file's terms."""
    bits = terms.select(*FILE, F.explode(F.array(*[_bit(F.col("term"), k) for k in range(SETS)])).alias("bit"))
    return bits.groupBy(*FILE).agg(F.bitmap_construct_agg("bit").alias("bloom"))


def holds(bloom: Column, needed: Column) -> Column:
    """Whether a filter may hold all needed terms."""

    def has(t: Column) -> Column:
        out = F.lit(True)
        for k in range(SETS):
            bit = _bit(t, k)
            byte = F.conv(F.hex(F.substring(bloom, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1)
        return out

    return F.forall(needed, has)


def finding_terms(proven: DataFrame, operations: DataFrame) -> DataFrame:
    """finding_id, vendor, term (null: any file) and needed (terms that must all be there), of findings as dependence.proves() gives them and their operations."""
    leaf_runs = F.transform(runs(F.col("leaf")), term)
    by_name = proven.where("by_read or by_send").select("finding_id", "vendor", term(longest(runs(F.col("leaf")))).alias("term"), F.filter(leaf_runs, lambda t: t != "").alias("needed"))
    none = F.array().cast("array<string>").alias("needed")
    arrivals = proven.where("by_call or by_absence")
    last = F.get(F.reverse(F.filter(paths.segments(F.col("op_path")), lambda s: ~paths.is_hole(s))), F.lit(0))
    routed = operations.join(arrivals.select("finding_id"), "finding_id", "left_semi").select("finding_id", "vendor", last.alias("last")).where("last IS NOT NULL")
    # a path names its segments, an SDK joins their words
    routed = routed.select("finding_id", "vendor", F.explode(F.array(term(longest(runs(F.col("last")))), term(F.col("last")))).alias("term"))
    # a chain of names begins with a name; those of an idiom before its last are whole, the last may go on
    idioms = arrivals.select("finding_id", "vendor", F.explode(F.filter("signatures", lambda s: (F.length(s) > 6) & s.rlike("^[A-Za-z_$]"))).alias("idiom"))
    names = F.split(F.regexp_replace("idiom", r"[.(]+$", ""), r"\.")
    whole = F.filter(F.transform(F.flatten(F.transform(F.slice(names, F.lit(1), F.size(names) - 1), runs)), term), lambda t: t != "")
    spoken = idioms.select("finding_id", "vendor", F.get(F.reverse(whole), F.lit(0)).alias("term"), whole.alias("needed"))
    some = by_name.unionByName(routed.select("*", none)).unionByName(spoken)
    none_at_all = proven.where("by_read or by_send or by_call or by_absence").select("finding_id", "vendor").join(some.select("finding_id"), "finding_id", "left_anti").select("*", F.lit(None).cast("string").alias("term"), none)
    some = some.withColumn("term", F.when(F.col("term") != "", F.col("term")))
    return some.unionByName(none_at_all).distinct()


def sharing(terms: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows of terms joined with rows of wanted that share a term (and the other columns of `on`)."""
    asked = wanted.select(*on).distinct()
    return terms.join(asked, on, "left_semi").join(wanted, on)


def pairs(sources: DataFrame, detected: DataFrame, proven: DataFrame, operations: DataFrame) -> DataFrame:
    """repo, path, finding_id: what is worth a proof."""
    terms = file_terms(sources)
    wanted = finding_terms(proven, operations)
    of_vendor = detected.select(*FILE, "vendor").distinct()
    met = sharing(terms.join(of_vendor, FILE), wanted.where("term IS NOT NULL"), ["vendor", "term"]).select(*FILE, "finding_id", "needed").distinct()
    sure = met.where("size(needed) < 2").select(*FILE, "finding_id")
    checked = met.where("size(needed) > 1").join(filters(terms), FILE).where(holds(F.col("bloom"), F.col("needed"))).select(*FILE, "finding_id")
    any_file = of_vendor.join(wanted.where("term IS NULL").select("finding_id", "vendor"), "vendor").select(*FILE, "finding_id")
    return sure.unionByName(checked).unionByName(any_file).distinct()
