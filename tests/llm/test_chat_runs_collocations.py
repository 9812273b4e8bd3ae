"""Chat formatting, periodic runs and collocations against brute force on the edge cases, and on empty tables."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from random import Random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import chat, collocations, queries, runs
from quillstone.llm.common import drop, map_arrow
from quillstone.llm.oracle import oracle_sql
from tests.llm.conftest import SCHEMA, rows, words

TURNS = "conv_id bigint, turn bigint, role string, text string, parts string, segment string, loss int, place int"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST] [\\\\/INST]", "<|image|> <|part|> <|other|>", "[ROLE]x[TEXT]y[/ROLE]", "<s", "/s>", "[", "INST]", "\\", "<<s>>[[INST]]", "$1 \\1", "é \n\r\t \U0001f600", "", None]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turn_rows():
    r, out = Random(5), []
    for c in range(30):
        for t in range(r.randrange(1, 7)):
            out.append((c, t, r.choice(["user", "assistant", "assistant", "system", "tool", "[ROLE]", "<s>", None]), "".join(x or "" for x in r.choices(NASTY, k=r.randrange(4))) if r.random() < 0.9 else None))
    # ties and repeated rows, null numbers and a null conversation, a long text and a long conversation
    out += [(50, 1, "user", "a"), (50, 1, "user", "a"), (50, 1, "assistant", "b"), (50, None, "user", "c"), (None, 0, "assistant", "x"), (None, None, None, None), (51, 0, "assistant", "</s> é " * 60_000)]
    out += [(52, t, "assistant" if t % 2 else "user", f"<s>{t}") for t in range(400)]
    return [(*x, "p", "s", 1, 2) for x in out]


def ordered(turns):
    by = defaultdict(list)
    for c, t, role, text, *_ in turns:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(x)] for c, x in by.items()}


def test_chat_is_read_back(spark):
    turns = turn_rows()
    formatted = chat.conversations(spark.createDataFrame(turns, TURNS).repartition(3))
    got = {r.conv_id: r for r in chat.read(formatted).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    want = ordered(turns)
    assert set(got) == set(want)
    for c, expected in want.items():
        # rows that tie by number come by role, then text
        assert Counter((t.role, t.text) for t in got[c].turns) == Counter(expected)
        assert [t.role for t in got[c].turns] == [role for role, _ in expected]
        assert list(got[c].learned) == [t.text for t in got[c].turns if t.role == "assistant"]
        assert got[c].n_chars == len(texts[c].formatted)
        said = [texts[c].formatted[m.start : m.start + m.length] for m in texts[c].loss if m]
        assert [re.sub(chat.ESCAPED, r"\1\2\3", s) for s in said] == [t.text for t in got[c].turns if t.role == "assistant"]
        # no text holds a control string: what is found are the marks of the turns
        marks = 4 * sum(role not in ("user", "assistant") for role, _ in expected) - sum(role not in ("user", "assistant") for role, _ in expected) + 2 * sum(role in ("user", "assistant") for role, _ in expected)
        assert sum(not m[1] for m in re.findall(chat.CONTROL, texts[c].formatted)) == marks
    assert chat.read(chat.conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_parts_become_placeholders_in_order(spark):
    doc = {"type": "document", "uri": "d1", "pages": 3, "children": [{"type": "text", "text": "page <|image|>"}, {"type": "image", "uri": "i2", "width": 57, "height": 28}, None]}
    content = [{"type": "text", "text": "see </s"}, {"type": "text", "text": "> and"}, {"type": "image", "uri": "i1", "width": 56, "height": 29}, doc, {"type": "audio", "uri": "a1", "seconds": 1.01}, {"type": "film", "uri": "f1"}, {"type": None}, {"type": "text", "text": None}]
    rows_ = [(1, 0, "user", None, json.dumps(content)), (1, 1, "assistant", "[no list", "[no list"), (1, 2, "assistant", None, None), (2, 0, "user", None, "[]")]
    turns = spark.createDataFrame(rows_, "conv_id bigint, turn bigint, role string, text string, content string")
    out = {r.conv_id: r for r in chat.conversations(turns, chat.parts_of_json(F.col("content"))).collect()}
    assert out[1].formatted == "[INST] see </s<|part|>> and<|image|><|document|>page <\\|image|><|image|><|audio|><|other|><|other|> [/INST]<s>[no list</s><s></s>"
    assert [(a.turn, a.kind, a.uri, a.place, a.tokens) for a in out[1].attachments] == [(0, "image", "i1", 0, 4), (0, "document", "d1", 1, 768), (0, "image", "i2", 2, 3), (0, "audio", "a1", 3, 13), (0, "other", "f1", 4, 0), (0, "other", None, 5, 0)]
    assert (out[1].tokens, out[2].formatted, out[2].tokens) == (788, "[INST]  [/INST]", 0)
    kinds = chat.conversations(turns, chat.parts_of_json(F.col("content"))).select("conv_id", chat.placeholders(F.col("formatted")).alias("k")).where("conv_id = 1").first().k
    assert kinds == [a.kind for a in out[1].attachments]
    back = {r.conv_id: r for r in chat.read(chat.conversations(turns, chat.parts_of_json(F.col("content")))).collect()}
    assert [t.text for t in back[1].turns] == ["see </s> andpage <|image|>", "[no list", ""]


def test_chat_query_stays_in_the_jvm_and_equals_its_sql(spark, tmp_path):
    turns = [x[:4] for x in turn_rows() if x[0] not in (None, 50)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_chat_format(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(oracle_sql()["op11_chat_format"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    ours = next(r for r in got.collect() if r.conv_id == -1)
    assert (ours.n_turns, ours.loss_chars, ours.loss_sha256) == (2, 21, sha(NASTY[0]))
    assert ours.turns_sha256 == sha(f"user\n{NASTY[0]}\nassistant\n{NASTY[0]}\n")


def brute_runs(w, least):
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic(r, n, kinds):
    w = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randrange(4)):
        a, p = r.randrange(n), r.randrange(1, 20)
        for i in range(a + p, min(n, a + r.randrange(10, 120))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_runs_against_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    r = Random(pairs)
    for _ in range(400):
        w = periodic(r, r.randrange(1, 180), r.choice([1, 2, 2, 3, 5, 50]))
        least = r.choice([3, 6, 9, 24, 24])
        assert [tuple(x) for x in runs.find(np.array(w, np.int64), least).tolist()] == brute_runs(w, least)


def test_hashes_that_err_do_no_harm(monkeypatch):
    """Equal words keep equal hashes, but others get the same ones."""
    monkeypatch.setattr(runs, "mix", lambda x: x & np.uint64(1))
    r = Random(3)
    for _ in range(150):
        w = periodic(r, r.randrange(1, 150), r.choice([3, 6, 9]))
        got, want = [tuple(x) for x in runs.find(np.array(w, np.int64)).tolist()], brute_runs(w, 24)
        assert got == want


def expected_runs(doc_id, text, change):
    w = (text or "").encode().split()
    if change and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = brute_runs(w, 24)
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    return len(found), best, sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())


def test_runs_of_documents(spark, docs, texts, none, tmp_path):
    extra = [(100 + k, " ".join(map(str, periodic(Random(k), 150, 4)))) for k in range(40)] + [(200, "a b  a\tb " * 20 + "x y " * 30)]
    table = docs.unionByName(spark.createDataFrame(rows(extra), SCHEMA))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    changed = 0
    want = Counter()
    for i, t in [*texts, *extra]:
        n, best, lines, left = expected_runs(i, t, True)
        changed += expected_runs(i, t, False) != (n, best, lines, left)
        want[i, n, *(best or (None,) * 3), best and 1000 * best[1] // best[2], lines, left] += 1
    assert Counter(tuple(r) for r in got) == want
    assert changed > 2
    plain = runs.find_runs(docs).where("doc_id = 18").first()
    assert [tuple(r) for r in plain.runs] == [(0, 180, 3)] and plain.collapsed == "same words here"
    assert runs.find_runs(none).count() == 0


def test_runs_of_a_very_long_text(spark):
    text = " ".join(words(9, 30_000)) + " tick tock" * 200_000
    got = runs.find_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in got.runs] == [(30_000, 400_000, 2)] and got.n_words == 430_000
    assert got.collapsed == text[: text.index(" tick") + len(" tick tock")]


def brute_collocations(rows_, most, least, share, top):
    n, f = Counter(), Counter()
    for lang, text in rows_:
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    inside = defaultdict(int)
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for (lang, w), a in cand.items():
        if 100 * inside[lang, w] >= share * a:
            continue
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def collocation_rows():
    r = Random(4)
    vocabulary = ["the", "The", "of", "new", "york", "city", "è", "日本", "a b", "x1", "ab", "\U0001f600"] + [f"w{k}" for k in range(12)]
    out = []
    for k in range(260):
        w = []
        for _ in range(r.randrange(0, 30)):
            w += r.choice([["New", "York", "City"], ["new", "york"], [r.choice(vocabulary)], ["of", "the"]])
        out.append((r.choice(["en", "en", "en", "de", None]), "".join(x + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ;: "]) for x in w)))
    return out + [("en", None), ("en", ""), (None, " \t. "), ("fr", "copy of this line\n" * 500), ("en", "one two " * 3000)] + [("de", "the same text again, the same text")] * 40


@pytest.mark.parametrize(("most", "least", "share", "top", "block"), [(3, 10, 50, 2000, 1 << 20), (3, 10, 50, 3, 40), (4, 3, 80, 2000, 200), (2, 1, 50, 20, 1000)])
def test_collocations_against_brute_force(spark, monkeypatch, most, least, share, top, block):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    found = [(k, t, lang, 1, "y") for k, (lang, t) in enumerate(collocation_rows())]
    docs = spark.createDataFrame(found, "doc_id bigint, text string, lang string, n int, phrase string").repartition(3)
    got = collocations.collocations(docs, most, least, share, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_collocations([(lang, t) for _, t, lang, _, _ in found], most, least, share, top)


def test_collocations_of_no_rows_and_of_one_very_long_piece(spark):
    schema = "doc_id bigint, text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], schema)).count() == 0
    text = "left right " * 600_000
    got = collocations.collocations(spark.createDataFrame([(1, text, "en")], schema)).collect()
    assert [tuple(r) for r in got] == brute_collocations([("en", text)], 3, 10, 50, 2000)


def test_scores_beyond_64_bits(spark, monkeypatch):
    found = [("en", "a b", 2, 10**12 - 1), ("en", "a", 1, 10**12 + 7), ("en", "b", 1, 10**12 + 11), ("en", None, 0, 3 * 10**12)]
    monkeypatch.setattr(collocations, "counts", lambda *_: spark.createDataFrame(found, "lang string, phrase string, words int, n bigint"))
    r = collocations.collocations(spark.createDataFrame([], "text string, lang string")).first()
    assert (r.score, r.n) == (10**6 * (10**12 - 1) ** 2 // ((10**12 + 7) * (10**12 + 11)), 3 * 10**12)


def test_counts_spill_and_leave_nothing_behind(spark, monkeypatch, tmp_path):
    """A bucket of more distinct phrases than duckdb's memory holds is summed on disk."""
    n = 400_000

    def make():
        def work(batch):
            import os

            os.environ["SPARK_LOCAL_DIRS"] = str(tmp_path)
            for part in range(2):
                phrases = "\n".join(f"{'long words ' * 12}{k % n}" for k in range(part * n // 2, n + part * n // 2))
                block = pa.record_batch([["en"], pa.array([3], pa.int8()), [phrases], [np.ones(n, np.int64)]], schema=collocations.PACKED)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, collocations.PACKED, options=collocations.IPC) as out:
                    out.write_batch(block)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "block"])

        return work

    monkeypatch.setattr(collocations, "MEMORY", "64MB")
    blocks = map_arrow(spark.range(1).coalesce(1), make, collocations.MESSAGE)
    got = collocations.counted(blocks, 2)
    assert got.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first()[:] == (n, 2, 2)
    assert not list(tmp_path.iterdir())
    drop()
