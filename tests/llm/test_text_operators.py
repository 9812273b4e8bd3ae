"""Each operator against brute force on the edge cases, and on an empty table."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import fingerprints, jaccard, leaks, licences, packing, passages, pseudonyms, repeats, resampling, sharding
from quillstone.llm.queries import tokenizer_path
from quillstone.llm.suffixes import Spool, sorted_to, suffix_array
from tests.llm.conftest import LABELS, rows, words


def low(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def test_licences_find_base_phrases_as_brute_force(docs, texts, none):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan_documents(docs).collect())
    want = Counter()
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        at = [(k, label) for p, label in licences.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == want
    assert licences.scan_documents(none).count() == 0


@pytest.mark.parametrize(("text", "postfix", "value"), [("MIT OR GPL-2.0", "mit gpl-2.0 or", 0.1), ("MIT and (GPL-2.0 or Apache-2.0)", "mit gpl-2.0 apache-2.0 or and", 0.15), ("GPL-2.0 WITH X AND MIT", "gpl-2.0 x with mit and", 0.7 * 0.75), ("(MIT", "", None), ("or MIT", "", None), ("MIT -->", "mit", 0.1)])
def test_expressions(text, postfix, value):
    got = licences.to_postfix(text)
    assert " ".join(got) == postfix
    assert value is None or licences.evaluate(got)[0] == pytest.approx(value)


def test_labels_of_tags(docs):
    r = licences.scan_documents(docs.where("doc_id = 13")).first()
    assert {"mit", "cc-by", "cc-by-nc", "cc-by-4.0", "gpl-2.0-only"} <= set(r.labels.split(","))
    assert 0 <= r.score <= 1


def test_licences_of_odd_tags_and_very_long_texts(spark, docs):
    machine = licences.automaton()
    for tag in ("---", "-->", "", "(", "and"):
        r = licences.scan(f"All rights reserved\nSPDX-License-Identifier: {tag}\nMIT", machine)
        assert (r["labels"], r["score"], r["expressions"]) == ("reserved", 1.0, "")
    assert licences.scan("SPDX license identifier MIT", machine)["labels"] == ""
    n = 300_000
    r = licences.scan("é! all Rights\tRESERVED " * n, machine)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (4 * n, n, 1, 4 * n - 3)


def test_edited_texts(docs, texts, none):
    got = fingerprints.edited(docs, buckets=3).collect()
    line = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = defaultdict(Counter)
    for k, (i, t) in enumerate(line):
        t, after = t or "", line[(k + 1) % len(line)][1] or ""
        h = len(t) // 2
        want[i][hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()] += 1
    have = defaultdict(Counter)
    for r in got:
        have[r.doc_id][r.edited_sha256] += 1
    del want[None], have[None]  # rows without an id are ordered among themselves by a hash
    assert have == want
    assert len(got) == len(texts)
    prints = {r.doc_id: tuple(r.fp) for r in got}
    assert prints[5] == prints[6]
    assert fingerprints.edited(none).count() == 0


def test_neighbours_are_exact(spark):
    r = Random(3)
    base = [r.getrandbits(128) for _ in range(6)]
    near = [b ^ sum(1 << x for x in r.sample(range(128), k)) for b in base for k in (0, 1, 2, 3, 4, 5)]
    split = lambda v: [int.from_bytes((v >> s & (1 << 64) - 1).to_bytes(8, "little"), "little", signed=True) for s in (0, 64)]
    df = spark.createDataFrame([(k, split(v)) for k, v in enumerate(near)], "id int, fp array<bigint>")
    got = {(x.query_id, x.id, x.distance) for x in fingerprints.neighbours(df.where("id % 5 = 0"), df, radius=3).collect()}
    assert got == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(near) for j, b in enumerate(near) if i % 5 == 0 and (a ^ b).bit_count() <= 3}


def test_pseudonyms(docs, texts, none):
    got = pseudonyms.pseudonymise_documents(docs, "k").collect()
    by = {r.doc_id: r for r in got}
    assert by[0].text is None and by[1].text == "" and by[5].text == dict(texts)[5]
    assert by[14].kinds == "card,date,email,ip,phone" and by[14].n_values == 5 and by[15].n_values == 2
    card = re.search(r"card (\d{16})", by[14].text)[1]
    assert card != "4785380592391139" and pseudonyms.luhn_digit(card[:-1]) == card[-1]
    assert re.search(r"card ([\d ]{19})", by[15].text)[1].replace(" ", "") == card
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[14].text)[0] in by[15].text
    assert "4785380592391138" in by[15].text
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)
    assert pseudonyms.pseudonymise_documents(none, "k").count() == 0


@pytest.mark.parametrize(
    ("text", "changed"),
    [
        ("card 4785 3805 9239 1139 12/26 end", "4785 3805 9239 1139"), ("in 12 4785 3805 9239 1139 5 12", "4785 3805 9239 1139"), ("x DE89 3704 0044 0532 0130 00 BIC COBADEFF y", "DE89 3704 0044 0532 0130 00"),
        ("an \u0438\u0432\u0430\u043d@\u043f\u043e\u0447\u0442\u0430.example.com", "\u0438\u0432\u0430\u043d@\u043f\u043e\u0447\u0442\u0430.example.com"), ("at 2001:db8:85a3::8a2e:370:7334, 12:30:45", "2001:db8:85a3::8a2e:370:7334"),
        ("key ghp_16C7e42F292c6912E7710c838347Ae178B4a.", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"), ("abc\n@mail.example.com", ""), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 std::vector", ""),
    ],
)
def test_values_within_other_text(text, changed):
    new, kinds = pseudonyms.pseudonymise(text, *pseudonyms.replacer(b"k"))
    before, _, after = text.partition(changed) if changed else (text, "", "")
    assert new.startswith(before) and new.endswith(after) and len(kinds) == bool(changed)
    middle = new[len(before) : len(new) - len(after)]
    assert changed == middle == "" or changed != middle and re.findall(r"[^\w:]", middle) == re.findall(r"[^\w:]", changed)
    if changed.startswith("\u0438"):
        assert not set(middle.split("@")[0]) & set("abcdefghijklmnopqrstuvwxyz")


def test_dates_of_either_order_keep_apart():
    import datetime

    _, memo = pseudonyms.replacer(b"k")
    days = [datetime.date(2010, 1, 1) + datetime.timedelta(k) for k in range(3000)]
    dates = {d.strftime(o) for d in days for o in ("%d/%m/%Y", "%m/%d/%Y")}
    assert len({memo("dotted", x) for x in dates}) == len(dates)


def test_the_key_is_the_session_s_and_drawn_where_there_is_none(spark):
    from quillstone.llm.queries import KEY, pseudonym_key

    was = spark.conf.get(KEY, None)
    try:
        spark.conf.set(KEY, "other")
        assert pseudonym_key(spark) == "other"
        drawn = []
        for _ in range(2):
            spark.conf.unset(KEY)
            drawn.append(pseudonym_key(spark))
            assert pseudonym_key(spark) == drawn[-1] and len(drawn[-1]) == 64
        assert drawn[0] != drawn[1]
    finally:
        spark.conf.set(KEY, was) if was else spark.conf.unset(KEY)


@pytest.mark.parametrize("n", [129, 4096])
def test_long_values_are_replaced_whole(n):
    """No length of a secret, a token or a mail name leaves a part of it in the text."""
    r = Random(n)
    secret, token, name = "".join(r.choices("0123456789abcdef", k=n)), "ghp_" + "".join(r.choices("ABCDEFghijkl0189", k=n)), "".join(r.choices("abcdefgh.1", k=n - 1)) + "x"
    f, memo = pseudonyms.replacer(b"k")
    text = f"a {secret} b {token} c {name}@mail.example.com d"
    parts = pseudonyms.pseudonymise(text, f, memo)[0].split(" ")
    assert [len(p) for p in parts] == [len(p) for p in text.split(" ")] and [parts[k] for k in (0, 2, 4, 6)] == ["a", "b", "c", "d"]
    for old, new in zip(text.split(" ")[1::2], parts[1::2], strict=True):
        assert old != new and old[8:40] not in new and old[-60:-20] not in new


def test_feistel_is_a_permutation():
    f = pseudonyms.Feistel(b"k")
    for n in (2, 3, 10, 97, 1000):
        assert sorted(f.permute(x, n, "t") for x in range(n)) == list(range(n))
    assert [f.permute(x, 97, "t") for x in range(97)] != [f.permute(x, 97, "u") for x in range(97)]


def test_shards_are_balanced_gapless_and_move_only_into_the_new_one(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = sharding.uniform_tree(8)
    got = sharding.assign(df, tree, sharding.grow(tree)).toPandas()
    assert got.groupby("shard").size().between(2200, 2800).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert set(got.grown_shard[got.grown_shard != got.shard]) == {8}
    assert 0.09 < (got.grown_shard == 8).mean() < 0.13


def test_weights_confine_movement(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = sharding.uniform_tree(8)
    more = [x if x.shard != 5 else sharding.Leaf(x.region, x.rack, 5, 2.0) for x in tree]
    got = sharding.assign(df, tree, more).toPandas()
    moved = got[got["shard"] != got.grown_shard]
    assert len(moved) and set(moved.grown_shard) <= {4, 5, 6, 7}


def test_sharding_edge_cases(docs, texts, none):
    got = sharding.assign(docs, sharding.uniform_tree(3)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.assign(none, sharding.uniform_tree(3)).count() == 0


def test_resampling_keeps_good_and_drops_bad(spark):
    good = [(i, " ".join(words(i, 80))) for i in range(400)]
    toxic = [(1000 + i, " ".join(words(5000 + i, 40) + ["vileword"] + words(9000 + i, 40))) for i in range(60)]
    junk = [(2000 + i, " ".join(w.upper() + "!!" for w in words(7000 + i, 80))) for i in range(60)]
    df = spark.createDataFrame(rows([*good, *toxic, *junk, (None, None), (3000, "")]), "doc_id bigint, text string, lang string, source string, n_chars bigint, weight string, row int, n int, node string, kept string, kinds string, seed int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000 + i, 1, 1) for i in range(40)] + [(2000 + i, 0, 0) for i in range(40)] + [(0, 1, None), (None, 0, 1), (7, None, None)], LABELS)
    kept = resampling.resample(df, labels)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) >= set(range(400)) and not [i for i in ids if i and 1000 <= i < 3000] and None in ids and 3000 in ids
    scored = resampling.score_documents(df, labels).collect()
    assert len(scored) == 522 and sum(r.kept for r in scored) == 402
    assert resampling.resample(df.limit(0), labels).count() == 0
    assert resampling.resample(df, labels.limit(0)).count() == 522


def test_inclusion_rates_follow_the_weights(spark):
    """Of texts of weight 0, -T and -2T one is drawn in 2,000 rounds: odds 1 to 1/e to 1/e^2."""
    t = resampling.TEMPERATURE
    df = spark.createDataFrame([(i, -t * i) for i in range(3)], "doc_id bigint, weight double").crossJoin(spark.range(2000).withColumnRenamed("id", "seed"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "seed"), 12).cast("double") + 0.5) / 2.0**52
    drawn = df.groupBy("seed").agg(F.max_by("doc_id", F.col("weight") / t - F.ln(-F.ln(u))).alias("i")).groupBy("i").count().collect()
    odds = np.exp(-np.arange(3))
    assert {r.i: r["count"] / 2000 for r in drawn} == pytest.approx(dict(enumerate(odds / odds.sum())), abs=0.035)
    same = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("weight"))
    noise = same.select((resampling.key_column("doc_id") - F.col("weight") / t).alias("g")).toPandas()["g"]
    assert noise.mean() == pytest.approx(0.5772, abs=0.03) and noise.std() == pytest.approx(np.pi / 6**0.5, abs=0.03)


def test_the_sample_is_no_threshold(spark):
    """Texts near the cutoff stay by chance, the more the heavier; the rest by weight."""
    weights = np.repeat([0.0, -0.9, -1.1, -1.6, -4.0], 2000)
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "doc_id bigint, weight double").withColumn("key", resampling.key_column("doc_id"))
    least = resampling.kth_largest(df, "key", 4000)
    rate = {r.weight: r.n / 2000 for r in df.where(F.col("key") >= least).groupBy("weight").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rate[0.0] == 1 and 0.5 < rate[-0.9] < 1 and 0 < rate[-1.6] < rate[-1.1] < rate[-0.9] and -4.0 not in rate


def test_features_are_words_shapes_and_pairs():
    f = resampling.Features()
    one, two = f.of("Good day, sir"), f.of("sir day, Good")
    assert len(np.setdiff1d(one, two)) and len(np.intersect1d(one, two)) >= 5 and not len(f.of(" ")) and not len(f.of(None))
    assert (one >= resampling.BUCKETS).sum() == 2 and f.of("x").max() < resampling.BUCKETS


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(0).normal(size=500).round(2)] + [5.0] * 20
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 3, 20, 21, 300, 520):
        assert resampling.kth_largest(df, "key", k, bins=16) == sorted(values, reverse=True)[k - 1]


def test_packing(docs, texts, none):
    from tokenizers import Tokenizer

    got = packing.pack_documents(docs, tokenizer_path(), capacity=256).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 256)):
            part = ids[s : s + 256]
            want[i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_packer_closes_the_fullest():
    p = packing.Packer(10, space=2)
    assert [p.place(n) for n in (6, 7, 8, 2, 4)] == [(0, 0), (1, 0), (2, 0), (2, 8), (0, 6)] or p.made
    q = packing.Packer(10, space=1)
    assert q.place(6) == (0, 0) and q.place(7) == (1, 0) and q.place(4) == (2, 0)


def test_token_tables_agree_with_the_tokenizer():
    ids = packing.Ids(tokenizer_path())
    odd = ["", " ", "á é", "İ ΣΑΣ", "x\x1cy", "a\xa0b\x85d", "it's we'll 12ab<|endoftext|>tail", "e ́x", "½ ² １", "don't!!'S x’s", "ẞß ﬁ ǅ", "日本語 ことば", "a.b.,c .,"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(odd)] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def edit_distance_anywhere(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[:], i
        for j, d in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def test_leaks_against_edit_distance(spark, docs, none):
    r = Random(5)
    item = " ".join(words(77, 30))
    texts = []
    for k in range(24):
        t = list(item)
        for _ in range(k):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice([[], ["z"], [t[at], "q"]])
        texts.append((k, " ".join(words(100 + k, 20)) + " " + "".join(t) + " " + " ".join(words(200 + k, 20))))
    df = spark.createDataFrame(rows(texts), docs.schema).unionByName(docs)
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "too short"), (4, item)], "item_id bigint, text string")
    got = Counter((x.doc_id, x.item_id, x.distance) for x in leaks.find_leaks(df, items).collect())
    e = len(leaks.normal(item)) // leaks.ERRORS
    want = {(i, d) for i, t in texts if (d := edit_distance_anywhere(leaks.normal(item), leaks.normal(t))) <= e}
    assert got == Counter((i, k, d) for i, d in want for k in (0, 4))
    assert any(d > 0 for _, d in want) and len(want) < len(texts)
    assert leaks.find_leaks(df, items, block_bytes=10).count() == 2 * len(want)
    kept = leaks.without_leaks(df, items)
    assert kept.columns == df.columns and kept.count() == df.count() - len(want)
    assert leaks.without_leaks(df, items, block_bytes=10).count() == kept.count()
    assert leaks.find_leaks(none, items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0


def test_leaks_of_short_items(spark, docs):
    texts = [(0, "So: What is 7 times 8? It is 56."), (1, "what is 7 times 80"), (2, "somewhat is 7 times 8"), (3, "what is 7 times 9"), (5, "what is 7 times 8")]
    items = spark.createDataFrame([(0, "What is 7 times 8?")], "item_id bigint, text string")
    df = spark.createDataFrame(rows(texts), docs.schema)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in leaks.find_leaks(df, items).collect()) == [(0, 0, 0), (5, 0, 0)]
    assert sorted(r.doc_id for r in leaks.without_leaks(df, items).collect()) == [1, 2, 3]


def test_suffix_array():
    r = Random(1)
    for _ in range(300):
        x = [r.randint(0, r.choice([1, 3, 200])) for _ in range(r.randint(0, 50))] * r.choice([1, 1, 3])
        assert list(suffix_array(np.array(x, np.uint8))) == sorted(range(len(x)), key=lambda i: x[i:])
        assert sorted_to(np.array(x, np.uint16), 1000).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        if x:
            got = sorted_to(np.array(x, np.uint16), 5).tolist()
            assert sorted(got) == list(range(len(x))) and all(x[a : a + 5] <= x[b : b + 5] for a, b in zip(got, got[1:], strict=False))


def test_suffix_array_on_disk(monkeypatch):
    for name, value in (("SPOOL", 7), ("RUN_BYTES", 300), ("SMALL", 0)):
        monkeypatch.setattr(f"quillstone.llm.suffixes.{name}", value)
    r = Random(2)
    x = [r.randint(0, 3) for _ in range(400)] * 2
    assert list(suffix_array(np.array(x, np.uint8))) == sorted(range(len(x)), key=lambda i: x[i:])
    s = Spool()
    for k in range(50):
        s.push(k)
    assert [s.pop() for _ in range(50)] == list(range(50)) and not s


def test_repeated_starts_in_memory_and_on_disk(monkeypatch):
    r = Random(6)
    contents = [bytes(r.choice(b"ab") for _ in range(r.randrange(12, 60))) for _ in range(30)]
    count = Counter(c[k : k + 12] for c in contents for k in range(len(c) - 11))
    want = [[k for k in range(len(c) - 11) if count[c[k : k + 12]] > 1] for c in contents]
    assert [x.tolist() for x in repeats.repeated_starts(contents, 12)] == want
    monkeypatch.setattr(repeats, "IN_MEMORY", 0)
    assert [x.tolist() for x in repeats.repeated_starts(contents, 12)] == want


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats_against_brute_force(docs, texts, none, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    data = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(b[k : k + 100] for _, b in data for k in range(len(b) - 99))
    want = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if count[b[k : k + 100]] > 1:
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.removed(docs, length=100)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert hot == 1 or repeats.removed(none).count() == 0


def test_repeats_of_400_bytes_against_brute_force(spark, docs):
    r = Random(8)
    passage = bytes(r.choice(b"abcdefgh ") for _ in range(900)).decode()
    filler = lambda n: "".join(r.choice("ijklmnop ") for _ in range(n))
    texts = [(k, filler(r.randrange(600)) + passage[a : a + n] + filler(r.randrange(600))) for k, (a, n) in enumerate([(0, 900), (0, 399), (0, 400), (100, 401), (450, 450), (450, 449), (0, 0), (200, 700)])]
    texts += [(20, filler(50) * 20), (21, "\u00e9" * 500), (22, "x" * 399), (23, None), (24, filler(300_000) + passage), (24, passage)]
    data = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    want = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.removed(spark.createDataFrame(rows(texts), docs.schema))
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()) == want


def test_fingerprints_against_brute_force(spark, docs, texts):
    """Votes of every term's hash, bit by bit, in Python; likeness as the share of equal bits."""
    line = sorted(((i, t or "") for i, t in texts if i is not None), key=lambda x: -x[0])
    one = {i: t for i, t in line if [j for j, _ in line].count(i) == 1}
    some = spark.createDataFrame(rows(list(one.items())), docs.schema)
    got = {r.doc_id: r for r in fingerprints.edited(some, buckets=2).collect()}
    terms = some.select("doc_id", fingerprints.terms(fingerprints.split_words(F.coalesce("text", F.lit("")))).alias("t"))
    hashes = terms.select("doc_id", F.transform("t", lambda x: F.struct(x.alias("t"), *[F.xxhash64(x, F.lit(k)).alias(f"h{k}") for k in range(2)])).alias("h")).collect()
    for r in hashes:
        want = []
        for k in range(2):
            votes = [sum((1 if x[f"h{k}"] >> b & 1 else -1) * (x["t"] & 3) for x in r.h) for b in range(64)]
            want.append(sum(1 << b for b, v in enumerate(votes) if v > 0))
        assert [x & (1 << 64) - 1 for x in got[r.doc_id].fp] == want
    order = sorted(one, reverse=True)
    for k, i in enumerate(order):
        assert list(got[i].nfp) == list(got[order[(k + 1) % len(order)]].fp)
    near = some.sparkSession.createDataFrame([([0, -1], [1, -2])], "a array<bigint>, b array<bigint>").select(fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).first().x
    assert near == 1 - 2 / 128


def each_class(texts, k, num, den):
    """(doc_id, set size, number of the class or None) of each text, comparing all pairs."""
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    find = lambda x: x if label[x] == x else find(label[x])
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    return [(i, len(s), find(a) if s else None) for a, ((i, _), s) in enumerate(zip(texts, sets, strict=True))]


def brute_classes(texts, k, num, den):
    found = each_class(texts, k, num, den)
    least = {}
    for i, _, c in found:
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return Counter((i, n, i if c is None else least.get(c)) for i, n, c in found)


def variants(seed, n):
    r = Random(seed)
    base, out = words(seed, 60), []
    for k in range(n):
        t = list(base)
        for _ in range(r.randrange(8)):
            t[r.randrange(len(t))] = f"v{r.randrange(10)}"
        out.append((100 * seed + k, " ".join(t + words(seed * 1000 + k, r.randrange(6)))))
    return out


def test_jaccard_against_brute_force(spark, docs, texts, none):
    more = [*texts, *variants(21, 60), *variants(22, 40)]
    df = spark.createDataFrame(rows(more), docs.schema)
    for k, num in ((4, 85), (5, 80)):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df, jaccard.Rule(k, num, 100)).collect())
        assert got == brute_classes(more, k, num, 100)
    assert jaccard.classes(none).count() == 0
    with pytest.raises(ValueError):
        jaccard.Rule(num=70)


def test_frequent_tokens_are_paired_and_links_stay(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 3)
    more = [*variants(31, 50), *variants(32, 50)]
    df = spark.createDataFrame(rows(more), docs.schema)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df).collect())
    assert got == brute_classes(more, 4, 85, 100)


def test_signatures_are_shared_by_all_that_link():
    r, rule = Random(9), jaccard.Rule()
    for _ in range(300):
        n = r.randrange(1, 80)
        x = np.array([r.getrandbits(63) for _ in range(n)], np.uint64)
        y = np.concatenate([x[r.randrange(0, 1 + n // 8) :], np.array([r.getrandbits(63) for _ in range(r.randrange(1 + n // 8))], np.uint64)])
        table = np.sort(np.array([t for t in {*x.tolist(), *y.tolist()} if r.random() < r.choice([0, 0.5, 1])], np.uint64))
        x, y = np.unique(x), np.unique(y)
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 85 * (len(x) + len(y) - shared) and x.tolist() != y.tolist():
            assert np.intersect1d(jaccard.signatures(x, rule, table)[0], jaccard.signatures(y, rule, table)[0]).size


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs, jaccard.Rule(5, 80, 100))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 2 and not {6, 7} & set(ids) and {0, 1, 8, 9} <= set(ids)


def test_one_of_each_tells_rows_apart(spark, docs):
    base, other, a, b = (" ".join(words(s, 120)) for s in (61, 62, 63, 64))
    near = base.replace(base.split()[60], "changed")
    texts = [(3, base), (7, base), (7, other), (9, a), (9, b), (9, b), (1, near), (None, near), (None, a), (4, ""), (4, ""), (4, None), (None, ""), (None, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows(texts), docs.schema), jaccard.Rule(5, 80, 100))
    want = [(1, near), (7, other), (9, a), (9, b), (4, ""), (4, None), (None, ""), (None, "")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)


def test_one_of_each_against_brute_force(spark, docs, texts):
    more = [(i and i % 150, t) for i, t in [*texts, *variants(41, 60), *variants(42, 60)]]
    label, least = {}, {}
    for (i, t), (_, _, c) in zip(more, each_class(more, 5, 80, 100), strict=True):
        label[i, t] = c
        if c is not None:
            least[c] = min(least.get(c, (i is None, i or 0, t)), (i is None, i or 0, t), key=lambda x: x[:2])
    keys = lambda c: {(i, t) for (i, t), d in label.items() if d == c and (i is None, i or 0) == least[c][:2]}
    got = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(rows(more), docs.schema), jaccard.Rule(5, 80, 100)).collect())
    for c in least:
        assert sum(got[k] for k in keys(c)) == 1 and not any(got[k] for k, d in label.items() if d == c and k not in keys(c))
    blank = Counter((i, t) for (i, t) in more if label[i, t] is None)
    assert Counter({k: n for k, n in got.items() if label[k] is None}) == Counter({k: n if k[0] is None else 1 for k, n in blank.items()})


def test_passages(docs, none):
    got = {r.doc_id: r for r in passages.repeated(docs).collect()}
    assert set(got) == {5, 6, 7, 9, 10} or set(got) == {5, 6, 7, 9, 10, 18}
    assert got[9].component_id == got[10].component_id == 9 and got[5].class_id == got[6].class_id == got[7].component_id == 5
    assert got[9].n_passages == got[10].n_passages == 1 and 120 <= got[10].n_words <= 123
    assert 38 <= got[9].first_word <= 40 and 160 <= got[9].end_word <= 162
    assert passages.repeated(none).count() == 0


def quoted_in_part(trials, others):
    """In each trial two texts share 60 words, of which others quote 40 in a row."""
    r, out = Random(11), []
    new = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    for _ in range(trials):
        passage = new(60)
        cuts = [passage, passage] + [passage[k : k + 40] for k in (r.randrange(21) for _ in range(others))]
        out += [new(20) + c + new(30) for c in cuts]
    return out


@pytest.mark.parametrize(("few", "hot"), [(16, 64), (3, 64), (3, 4)])
def test_passages_quoted_in_part_by_others(spark, docs, monkeypatch, few, hot):
    monkeypatch.setattr(passages, "FEW", few)
    monkeypatch.setattr(passages, "LEAST_HOT", hot)
    texts = quoted_in_part(30, 10)
    holders = {}
    for i, w in enumerate(texts):
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i for h in holders.values() if len(h) > 1 for i in h}
    df = spark.createDataFrame(rows([(i, " ".join(w)) for i, w in enumerate(texts)]), docs.schema)
    got = {r.doc_id: r for r in passages.repeated(df).collect()}
    assert set(got) == want and len(want) == 60
    assert all(18 <= r.first_word <= 20 and 80 <= r.end_word <= 82 for r in got.values())


def test_exact_passages_of_common_seeds_in_every_place(spark, docs, monkeypatch):
    """Passages of 50 words and a few more, and two words in turn at every place, whose seeds are all common, against brute force on strings of 50 words."""
    monkeypatch.setattr(passages, "FEW", 3)
    r, texts = Random(21), []
    new = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    for n in (50, 50, 51, 51, 52, 53):
        passage = new(n)
        parts = [passage[k : k + 9] for k in range(0, n - 8, 3)] * 4
        # who quotes a part stands before those that hold all of it, and holds no other part
        texts += [new(12) + c + new(12) for c in [*parts, passage, passage]]
    texts += [new(20) + ["ab", "cd"] * n + new(20) for n in (100, 130, 160)]
    holders = {}
    for i, w in enumerate(texts):
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    want = {}
    for h in holders.values():
        for i, k in h if len({i for i, _ in h}) > 1 else ():
            want.setdefault(i, set()).update(range(k, k + 50))
    df = spark.createDataFrame(rows([(i, " ".join(w)) for i, w in enumerate(texts)]), docs.schema).coalesce(1)
    got = {x.doc_id: x for x in passages.repeated(df).collect()}
    assert set(got) == set(want) and len(want) == 15
    assert {i: x.n_words for i, x in got.items()} == {i: len(w) for i, w in want.items()}
    assert {i: (x.first_word, x.end_word, x.n_passages) for i, x in got.items()} == {i: (min(w), max(w) + 1, 1) for i, w in want.items()}


def test_passages_with_words_replaced(spark, docs):
    r, texts = Random(12), []
    new = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    edits = [lambda k: k % 7 == 6, lambda k: k % 5 == 4, lambda k: 3 < k < 57 and r.random() < 0.1]
    for edit in edits * 10:
        passage = new(60)
        texts += [new(40) + passage + new(20), new(10) + [f"x{r.randrange(10**7)}" if edit(k) else w for k, w in enumerate(passage)] + new(50)]
    df = spark.createDataFrame(rows([(i, " ".join(w)) for i, w in enumerate(texts)]), docs.schema)
    assert {r.doc_id for r in passages.repeated(df).collect()} == set(range(len(texts)))


def test_chains_against_quadratic():
    r = Random(4)
    for _ in range(200):
        m = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 25))})
        best = {}
        for p, h in m:
            best[p, h] = 6 + max([0.0, *(v - 0.1 * (p - a + h - b) for (a, b), v in best.items() if a < p and b < h)])
        first = passages.chains(m)[0]
        score = 6.0
        for (a, b), (p, h) in zip(first, first[1:], strict=False):
            assert a < p and b < h
            score += 6 - 0.1 * (p - a + h - b)
        assert score == pytest.approx(max(best.values()))


def test_results_are_plain(docs):
    assert json.dumps([r.asDict() for r in licences.scan_documents(docs.where("doc_id = 12")).collect()])
