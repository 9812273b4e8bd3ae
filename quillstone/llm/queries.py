"""The opN_ queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import chat, collocations, fingerprints, jaccard, leaks, licences, packing, passages, pseudonyms, repeats, resampling, runs, sharding
from quillstone.llm.common import table

SHARDS = 8
#: The session's setting with the key of the pseudonyms.
KEY = "spark.quillstone.pseudonym.key"


def pseudonym_key(spark: SparkSession) -> str:
    """The key that the session names. Where it names none, one is drawn and kept for the session: pseudonyms link within it, and nobody can reverse them from the source code."""
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints.edited(table(spark, sf_dir, "documents"))
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("fp")).alias("fingerprint"), fingerprints.as_text(F.col("efp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("efp")).alias("near_edited"), fingerprints.likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise_documents(table(spark, sf_dir, "documents"), pseudonym_key(spark)).select("doc_id", "n_values", "kinds", "text")


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.uniform_tree(SHARDS)
    placed = sharding.assign(table(spark, sf_dir, "documents"), tree, sharding.grow(tree))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"), length=400).drop("spans", "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), jaccard.Rule(k=4, num=85, den=100))


def op10_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ours = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    back = chat.read(chat.conversations(rows.unionByName(ours)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("said"), F.array_join("learned", "").alias("learned"), "n_chars")
    return back.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.col("n_chars").cast("long").alias("formatted_chars"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(table(spark, sf_dir, "documents"), change=runs.planted)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), runs.strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
