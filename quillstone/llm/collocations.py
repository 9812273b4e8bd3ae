"""Phrases of a few words that stand together more often than their parts suggest.

Texts are cut into pieces; identical pieces of a language become one with a multiplicity. Tasks
turn blocks of pieces into distinct n-grams with weights and deal them out by the n-gram's hash, a
block of a bucket as one compressed message; duckdb sums each bucket out of core and hands on what
occurs often enough. Each frequent phrase then asks for the counts of its parts, and tells its two
longest parts its own count, by lookup requests that are shuffled to where the parts' counts lie.

Edge cases: a null text has no pieces, a null language is `und`; repeated rows count again; pieces
without words are left out; ties of rank go to the larger count, then the phrase in UTF-8 byte
order, ties between cuts to the shortest first part; an empty table gives no rows; other columns of
the input are ignored.

Scale: pieces are summed before they are moved; an n-gram is moved once per block of BLOCK_WORDS
words, so the commonest one costs no more than others. A bucket is one task; its memory is bounded
by duckdb's limit, beyond which duckdb uses the task's own scratch folder, which nothing else reads
and which goes with the task. Lookup requests for a common part are many rows of one key: requests
come from a table that is cut, and AQE splits that side of the join. Nothing is broadcast.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut, partitions
from quillstone.llm.shingles import mix, span_hashes

#: Words and bytes of pieces that a task counts at once, whichever is reached first.
BLOCK_WORDS, BLOCK_BYTES = 1 << 19, 4 << 20
#: Of duckdb in a task.
MEMORY = "300MB"
#: Rows of pieces in an Arrow batch; their bytes are bounded too.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 4 << 20
MESSAGE = "bucket int, block binary"
COUNTED = "lang string, phrase string, words int, n bigint"
IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
PACKED = pa.schema([("lang", pa.string()), ("words", pa.int8()), ("phrases", pa.string()), ("weights", pa.list_(pa.int64()))])
GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int8()), ("weight", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (its words, joined by blanks) and times, each distinct one once."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(low, "[.,;:!?\\x0A-\\x0D]+")).alias("piece"))
    out = out.select("lang", F.trim(F.regexp_replace("piece", "[ \\t]+", " ")).alias("piece")).where("piece <> ''")
    return out.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)


def grams(texts: pa.Array, times: np.ndarray, most: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """The distinct n-grams of some pieces of one language, for each n from 1 to most: n, phrases, weights and hashes."""
    split = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(split.flatten())
    ids, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    bounds = split.offsets.to_numpy().astype(np.int64)
    sizes = bounds[1:] - bounds[:-1]
    weights = np.repeat(times, sizes)
    # words to the end of the piece, this one included
    left = np.repeat(bounds[1:], sizes) - np.arange(len(ids))
    ends = np.frombuffer(names.buffers()[1], np.int32)[: len(names) + 1].astype(np.int64)
    hashes = span_hashes(np.frombuffer(names.buffers()[2], np.uint8)[: int(ends[-1])], ends[:-1], ends[1:])
    # an n-gram's key is the number of its first n - 1 words and its last word; at is where those stand that reach n words
    at, number, phrases, marks = np.arange(len(ids)), ids, names, hashes
    yield 1, names, summed(ids, weights)[1], mix(hashes)
    for n in range(2, most + 1):
        reach = left[at] >= n
        at = at[reach]
        keys = number[reach] * len(names) + ids[at + n - 1]
        distinct, sums = summed(keys, weights[at])
        head, last = np.divmod(distinct, len(names))
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(head)), names.take(pa.array(last)), " ")
        marks = mix(marks[head] * np.uint64(3) + hashes[last])
        number = np.searchsorted(distinct, keys)
        yield n, phrases, sums, mix(marks)


def messages(lang: pa.Array, texts: pa.Array, times: np.ndarray, most: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) for all n-grams of some pieces: one block for each bucket that has any."""
    codes = pc.dictionary_encode(lang)
    which = codes.indices.to_numpy(zero_copy_only=False)
    langs, phrases, words, weights, dealt_to = [], [], [], [], []
    for k, name in enumerate(codes.dictionary.to_pylist()):
        here = np.flatnonzero(which == k)
        salt = np.uint64(int.from_bytes(name.encode()[:8].ljust(8, b"\0"), "little"))
        for n, found, sums, marks in grams(texts.take(pa.array(here)), times[here], most):
            langs.append(np.full(len(found), k, np.int32))
            phrases.append(found)
            words.append(np.full(len(found), n, np.int8))
            weights.append(sums)
            dealt_to.append((mix(marks + salt) % np.uint64(buckets)).astype(np.int32))
    bucket = np.concatenate(dealt_to)
    order = np.argsort(bucket, kind="stable")
    bucket, lang_of, words_of = bucket[order], np.concatenate(langs)[order], np.concatenate(words)[order]
    # one row for each bucket, language and length: phrases without offsets take half the room
    new = (bucket[1:] != bucket[:-1]) | (lang_of[1:] != lang_of[:-1]) | (words_of[1:] != words_of[:-1])
    first = np.flatnonzero(np.append(True, new))
    bounds = pa.array(np.append(first, len(bucket)).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(bounds, pa.concat_arrays(phrases).take(pa.array(order))), "\n")
    weighed = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(weights)[order]))
    table = [codes.dictionary.take(pa.array(lang_of[first])), pa.array(words_of[first]), joined, weighed]
    bucket = bucket[first]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, PACKED, options=IPC) as out:
            out.write_batch(pa.record_batch([c[a:b] for c in table], schema=PACKED))
        yield int(bucket[a]), sink.getvalue().to_pybytes()


def unpacked(b: pa.RecordBatch) -> pa.RecordBatch:
    """A message's n-grams, one a row."""
    phrases = pc.split_pattern(b["phrases"], "\n")
    row = pa.array(np.repeat(np.arange(b.num_rows), pc.list_value_length(phrases).to_numpy(zero_copy_only=False)))
    return pa.record_batch([b["lang"].take(row), phrases.flatten(), b["words"].take(row), b["weights"].flatten()], schema=GRAMS)


def dealt(found: DataFrame, most: int, buckets: int) -> DataFrame:
    """Messages of the weighted n-grams of distinct pieces."""

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lang, texts = (table[c].chunk(0) for c in ("lang", "piece"))
        for bucket, message in messages(lang, texts, table["times"].to_numpy(), most, buckets):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([message], pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            words += pc.sum(pc.count_substring(batch.column(1), " ")).as_py() + batch.num_rows
            size += batch.column(1).nbytes
            if words >= BLOCK_WORDS or size >= BLOCK_BYTES:
                yield from block(held)
                held, words, size = [], 0, 0
        if held:
            yield from block(held)

    return found.select("lang", "piece", "times").mapInArrow(run, MESSAGE)


def scratch() -> str | None:
    """Where Spark lets this task spill; None for Python's default."""
    return (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None


def counted(dealt_out: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words and n of n-grams that occur at least so often, and for each language parts of its number of words (phrase null, words 0); all messages of a bucket lie in one partition."""
    out_schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}

        def incoming() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for message in batch.column(1):
                    for packed in pa.ipc.open_stream(message.as_buffer()):
                        b = unpacked(packed)
                        single = pa.Table.from_batches([b]).filter(pc.equal(b["words"], 1)).group_by("lang").aggregate([("weight", "sum")])
                        for lang, n in zip(single["lang"].to_pylist(), single["weight_sum"].to_pylist(), strict=True):
                            totals[lang] = totals.get(lang, 0) + n
                        yield b

        with tempfile.TemporaryDirectory(prefix="grams-", dir=scratch()) as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as db:
            db.register("incoming", pa.RecordBatchReader.from_batches(GRAMS, incoming()))
            got = db.sql(f"SELECT lang, phrase, CAST(words AS INTEGER) AS words, CAST(sum(weight) AS BIGINT) AS n FROM incoming GROUP BY lang, phrase, words HAVING sum(weight) >= {int(least)}")
            for b in got.to_arrow_reader(BATCH_ROWS):
                yield pa.Table.from_batches([b]).cast(out_schema).combine_chunks().to_batches()[0] if b.num_rows else b.slice(0, 0).cast(out_schema)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.nulls(len(totals), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array(list(totals.values()), pa.int64())], schema=out_schema)

    return dealt_out.mapInArrow(run, COUNTED)


def counts(docs: DataFrame, most: int = 3, least: int = 10) -> DataFrame:
    """What counted() says of all pieces of the texts, as a table of its own for drop()."""
    spark = docs.sparkSession
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    for k, v in zip(before, (BATCH_ROWS, BATCH_BYTES), strict=True):
        spark.conf.set(k, str(v))
    try:
        n = partitions(spark)
        return cut(counted(dealt(pieces(docs), most, n).repartitionById(n, F.col("bucket")), least))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def collocations(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a (occurrences), l and r (of the first and the second part of the lowest-scoring cut), n (all words of the language) and score = floor(1000000 a a / (l r)).

    Phrases of 2 to most words that occur at least `least` times, less those inside a longer one that
    has at least `share` per cent of their occurrences; the first `top` of each language.
    """
    found = counts(docs, most, least)
    grams_ = found.where("words > 0").select("lang", "phrase", F.col("n").alias("told"))
    w = F.split("phrase", " ")
    asked = []
    for k in range(1, most):
        part = {"l": F.slice(w, F.lit(1), F.lit(k)), "r": F.slice(w, F.lit(k + 1), F.greatest(F.col("words") - k, F.lit(0)))}
        asked += [F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.array_join(p, " ").alias("part"))) for side, p in part.items()]
    phrases = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.array_compact(F.array(*asked))).alias("q"))
    requests = cut(phrases.select("lang", "phrase", "words", "a", "q.*"))

    answers = requests.join(grams_.withColumnRenamed("phrase", "part"), ["lang", "part"])
    answer = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("told")))
    known = answers.groupBy("lang", "phrase", "words", "a").agg(*[answer(k, side).alias(f"{side}{k}") for k in range(1, most) for side in "lr"])
    # a phrase of which a longer one has a share is part of one that is longer by a word and has it too
    longest = F.col("k") == F.when(F.col("side") == "l", F.col("words") - 1).otherwise(F.lit(1))
    longer = requests.where((F.col("words") > 2) & longest).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    alone = known.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))

    def score(k: int) -> Column:
        # decimals without places: products are exact up to 38 digits, and an overflow is an error
        value = F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0)))")
        return F.when(F.col("words") > k, F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    scored = alone.select("lang", "phrase", "a", F.array_min(F.array(*[score(k) for k in range(1, most)])).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    # first the best of each share of a language, then the best of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
