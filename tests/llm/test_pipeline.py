"""The pipeline on small tables with every edge case; each stage's rows against plain Python over what the stage before kept."""

from collections import Counter, defaultdict

import corpus_pipeline
from quillstone.llm import leaks, packing, pseudonyms, resampling
from quillstone.llm.common import cut
from quillstone.llm.queries import pseudonym_key, tokenizer_path
from tests.llm.conftest import LABELS, SCHEMA, make_texts, rows, words
from tests.llm.test_text_operators import each_class


def run_stages(spark, path):
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, str(path)))
        kept[name] = out.collect()
        assert name == "packing" or out.columns == docs.columns
        docs = out
    return kept


def test_stages(spark, tmp_path):
    item = " ".join(words(77, 30))
    texts = make_texts() + [(200 + i, " ".join(words(900 + i, 60))) for i in range(60)] + [(400 + i, " ".join(words(3000 + i, 30) + ["vileword"] + words(4000 + i, 30))) for i in range(40)]
    texts += [(500, " ".join(words(8000, 20)) + " " + item + " " + " ".join(words(8001, 20))), (9, " ".join(words(8002, 80))), (None, " ".join(words(900, 60))), (7, ""), (7, ""), (7, None)]
    frame = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    frame(rows(texts), SCHEMA, "documents")
    frame([(200 + i, 1, 0) for i in range(50)] + [(400 + i, 1, 1) for i in range(30)], LABELS, "labels")
    frame([(0, item)], "item_id bigint, text string", "benchmark")
    kept = run_stages(spark, tmp_path)
    pairs = lambda name: [(r.doc_id, r.text) for r in kept[name]]

    ids = {i for i, _ in pairs("quality")}
    assert {200 + i for i in range(60)} <= ids and not {400 + i for i in range(40)} & ids and None in ids
    before, left = pairs("quality"), Counter(pairs("near_duplicates"))
    by_class = defaultdict(list)
    for row, (_, _, c) in zip(before, each_class(before, 5, 80, 100), strict=True):
        by_class[c].append(row)
    blank = Counter(by_class.pop(None))
    assert Counter({k: n for k, n in left.items() if k in blank}) == Counter({k: n if k[0] is None else 1 for k, n in blank.items()})
    rank = lambda x: (x[0] is None, x[0] or 0)
    for members in by_class.values():
        stays = [m for m in set(members) if left[m]]
        assert len(stays) == 1 and left[stays[0]] == 1 and rank(stays[0]) == min(map(rank, members))
    matcher = leaks.Matcher([(0, item)])
    assert Counter(pairs("decontamination")) == Counter((i, t) for i, t in pairs("near_duplicates") if not matcher.find(t)) and 500 not in dict(pairs("decontamination"))
    f, memo = pseudonyms.replacer(pseudonym_key(spark).encode())
    assert Counter(pairs("pii")) == Counter((i, None if t is None else pseudonyms.pseudonymise(t, f, memo)[0]) for i, t in pairs("decontamination"))
    tokens = packing.Ids(tokenizer_path())
    want = Counter()
    for i, t in pairs("pii"):
        want[i] += len(tokens.of([t or ""])[0]) // 4 + 1
    got, bins = Counter(), defaultdict(int)
    for r in kept["packing"]:
        got[r.doc_id] += r.length
        bins[r.sequence_id] += r.length
    assert got == want and max(bins.values()) <= packing.CAPACITY
    assert resampling.MAX_LABELS == 20_000


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", LABELS), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert not any(run_stages(spark, tmp_path).values()) and corpus_pipeline.run(spark, str(tmp_path)).count() == 0
