import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, weight string, row int, n int, node string, kept string, kinds string, seed int"
LABELS = "doc_id bigint, quality int, toxic int"


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice(["n", "st", "r", "ly", "tion"]) + str(r.randrange(40)) * (r.random() < 0.1) for _ in range(n)]


def rows(texts):
    """Rows of documents with columns whose names the operators use themselves."""
    return [(i, t, "en", "s", len(t) if t is not None else None, "x", 1, 2, "y", "z", "k", 3) for i, t in texts]


def make_texts():
    base, passage = words(1, 300), words(2, 120)
    near = list(base)
    near[150] = "changed"
    far = [w if k % 4 else "other" for k, w in enumerate(base)]
    return [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "Only three words"), (5, " ".join(base)), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(far)),
        (9, " ".join(words(3, 40) + passage + words(4, 30))), (10, " ".join(words(5, 90) + passage[:60] + ["odd"] + passage[60:] + words(6, 10))), (11, "É " * 700 + " ".join(words(7, 3000))),
        (12, "Released under the MIT License. All Rights Reserved; all rights reserved"), (13, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND CC-BY-4.0\nLicensed under CC BY-NC 4.0"),
        (14, "Call +1 (988) 555-2485, card 4785380592391139, ip 152.143.123.131, mail hein.19@mail5.example.com on 2024-02-29."), (15, "card 4785 3805 9239 1139 and again +1 (988) 555-2485; not a card 4785380592391138"),
        (5, " ".join(base)), (5, " ".join(base)), (None, " ".join(words(8, 200))), (None, None), (16, "ab" * 900), (17, "x" + "ab" * 900), (18, "same words here " * 60),
    ]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
