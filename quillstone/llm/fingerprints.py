"""SimHash fingerprints in DataFrame functions only, and an exact Hamming search.

A text's terms are its pairs of neighbouring words, lower-cased and split at white space. Every
occurrence of a term votes on each bit of the fingerprint with the term's weight: 2, or 1 where
both words are short, for a set bit of the term's hash and against an unset one. A bit is set
where the votes for it are more than half.

Votes are counted several bits to a long. Over a run of 63 terms a counter fits 7 bits, so the
hash shifted by j and masked gives eight counters at once and 8 sums hold all 64: few enough for
the compiler. The runs' counters are then widened to 32 bits, two to a long, and added up.

Edge cases: a null text counts as empty; a text of one word votes with that word, an empty one
with the empty word, so every text has a fingerprint and equal texts have equal ones; a null
doc_id sorts as the lowest; repeated rows keep one result each, ordered by doc_id, then text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import partitions, range_bounds, range_bucket

#: Bytes of text in a range of doc_id, and the most ranges.
RANGE_BYTES, MOST_RANGES = 32 << 20, 8192
#: Longs in a fingerprint.
WORDS = 2
BITS = 64 * WORDS
EIGHT = 0x0101010101010101
TWO = 0x000000FF000000FF
#: Terms whose votes, at most 2 each, fit 7 bits: the top counter must not reach the sign.
RUN = 63


def split_words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def terms(words: Column) -> Column:
    """Hashes of the terms of a column of words; the two lowest bits are the weight.

    Neighbours are zipped: words read inside a lambda would be split anew for every word.
    """
    n = F.size(words)
    small = lambda w: F.octet_length(w) < 4
    pair = lambda v, w: F.xxhash64(v, w).bitwiseAND(F.lit(-4).cast("long")).bitwiseOR(F.when(small(v) & small(w), F.lit(1)).otherwise(F.lit(2)).cast("long"))
    single = F.array(F.xxhash64(F.get(words, F.lit(0))).bitwiseAND(F.lit(-4).cast("long")).bitwiseOR(F.lit(2).cast("long")))
    return F.when(n < 2, single).otherwise(F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), F.slice(words, 2, F.greatest(n - 1, F.lit(1))), pair))


def _run_votes(term: Column) -> list[Column]:
    weight = term.bitwiseAND(F.lit(3).cast("long"))
    out = [F.sum(weight).alias("_all")]
    for k in range(WORDS):
        h = F.xxhash64(term, F.lit(k))
        out += [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(EIGHT)) * weight).alias(f"_r{k}_{j}") for j in range(8)]
    return out


def _all_votes() -> list[Column]:
    """Counters of bits j + 8 i and j + 8 i + 32 from the runs' counters j."""
    out = [F.sum("_all").alias("_all")]
    for k in range(WORDS):
        out += [F.sum(F.shiftrightunsigned(F.col(f"_r{k}_{j}"), 8 * i).bitwiseAND(F.lit(TWO))).alias(f"_v{k}_{j + 8 * i}") for i in range(4) for j in range(8)]
    return out


def _bits(k: int) -> Column:
    """Long k of the fingerprint from the counters."""
    out = F.lit(0).cast("long")
    for j in range(32):
        v = F.col(f"_v{k}_{j}")
        for bit, ones in ((j, v.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(v, 32))):
            out = out.bitwiseOR(F.shiftleft((ones * 2 > F.col("_all")).cast("long"), bit))
    return out


def fingerprint(df: DataFrame, keys: list[str], hashes: Column) -> DataFrame:
    """One row per keys with fp, an array of longs, from an array of term hashes."""
    runs = df.select(*keys, F.posexplode(hashes).alias("_p", "_t")).groupBy(*keys, F.floor(F.col("_p") / RUN).alias("_run")).agg(*_run_votes(F.col("_t")))
    votes = runs.groupBy(*keys).agg(*_all_votes())
    return votes.select(*keys, F.array(*[_bits(k) for k in range(WORDS)]).alias("fp"))


def as_text(fp: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.get(fp, F.lit(k)))), 16, "0") for k in range(WORDS)])


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(WORDS)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its code points replaced by the first of the next document, in descending doc_id, the first document following the last.

    Texts are dealt once, into ranges of doc_id, and everything up to the result happens there.
    Each range also holds a copy of the row that follows it.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if not buckets:
        # ranges follow the bytes of the texts; their bounds are literals of the plan, so there are at most MOST_RANGES
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_RANGES, max(2 * partitions(docs.sparkSession), n_bytes // RANGE_BYTES))
    bounds = range_bounds(rows, "doc_id", buckets)
    bucket = range_bucket(F.col("doc_id"), bounds)
    # a range's highest id is the last value below the next bound; it follows the lowest id of the range above
    highs = rows.groupBy(bucket.alias("_b")).agg(F.max("doc_id").alias("hi")).collect()
    order = sorted((r["_b"], r["hi"]) for r in highs if r["hi"] is not None)
    nulls_only = not order
    present = [b for b, _ in order]
    first_bucket = min([r["_b"] for r in highs], default=0)
    follows = {hi: (present[k + 1] if k + 1 < len(present) else first_bucket) for k, (_, hi) in enumerate(order)}
    if nulls_only:
        copies = F.when(F.lit(True), F.array(F.struct(F.lit(first_bucket).alias("b"), F.lit(1).alias("copy"))))
    else:
        target = F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])
        is_high = F.col("doc_id").isin(list(follows)) if len(follows) <= 64 else F.array_contains(F.array(*map(F.lit, follows)), F.col("doc_id"))
        copies = F.when(is_high, F.array(F.struct(F.get(F.map_values(F.map_filter(target, lambda k, v: k == F.col("doc_id"))), F.lit(0)).alias("b"), F.lit(1).alias("copy"))))
    own = F.array(F.struct(bucket.alias("b"), F.lit(0).alias("copy")))
    dealt = rows.select("doc_id", "text", F.explode(F.concat(own, F.coalesce(copies, F.slice(own, 1, 0)))).alias("_x")).select("doc_id", "text", F.col("_x.b").alias("_b"), F.col("_x.copy").alias("_copy"))
    line = Window.partitionBy("_b").orderBy("_copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    dealt = dealt.repartition("_b")
    here = dealt.select("_b", "_copy", "doc_id", "text", F.row_number().over(line).alias("_n"), F.coalesce(F.lead("text").over(line), F.lit("")).alias("_next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    swapped = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    here = here.select("_b", "_copy", "doc_id", "_n", n.cast("long").alias("n_chars"), "text", swapped.alias("_edited"))
    here = here.select("_b", "_copy", "doc_id", "_n", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("text").alias("t")), F.struct(F.lit(1).alias("s"), F.col("_edited").alias("t")))).alias("_s"))
    keys = ["_b", "_n", "_copy", "doc_id", "n_chars", "edited_sha256", "_side"]
    sides = here.withColumns({"_side": F.col("_s.s"), "_words": split_words(F.col("_s.t"))}).drop("_s")
    prints = fingerprint(sides, keys, terms(F.col("_words")))
    keys.remove("_side")
    both = prints.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("_side") == 1, F.col("fp"))).alias("efp"))
    after = Window.partitionBy("_b").orderBy("_n")
    return both.withColumn("nfp", F.coalesce(F.lead("fp").over(after), F.col("fp"))).where("_copy = 0").select("doc_id", "n_chars", "edited_sha256", "fp", "efp", "nfp")


def neighbours(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 8) -> DataFrame:
    """All pairs (query_id, id, distance) of fingerprints within radius bits, exactly.

    Both inputs have id and fp. The bits are cut into blocks; two fingerprints within radius bits
    agree on at least blocks - radius of them, so for each choice of that many blocks a table keyed
    by those blocks (the permuted prefix) is probed. Equal fingerprints are joined as one: pairs
    of ids come from pairs of distinct fingerprints. A pair is kept in the first table it meets.
    """
    size = BITS // blocks
    if BITS % blocks or 64 % size or radius >= blocks:
        raise ValueError("blocks must cut a long evenly and be more than radius")
    per = 64 // size
    mask = (1 << size) - 1

    def block(fp: Column, b: int) -> Column:
        return F.shiftrightunsigned(F.get(fp, F.lit(b // per)), size * (b % per)).bitwiseAND(F.lit(mask if size < 64 else -1))

    choices = list(combinations(range(blocks), blocks - radius))
    tables = lambda df: df.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.xxhash64(*[block(F.col("fp"), b) for b in c]).alias("p")) for k, c in enumerate(choices)])).alias("x")).select("fp", "x.t", "x.p")
    q, i = tables(queries.select("fp").distinct()).withColumnRenamed("fp", "qfp"), tables(index.select("fp").distinct())
    near = q.join(i, ["t", "p"]).withColumn("distance", distance(F.col("qfp"), F.col("fp"))).where(F.col("distance") <= radius)
    near = near.select("qfp", "fp", "distance").distinct()
    return near.join(queries.select(F.col("id").alias("query_id"), F.col("fp").alias("qfp")), "qfp").join(index.select("id", "fp"), "fp").select("query_id", "id", "distance")
