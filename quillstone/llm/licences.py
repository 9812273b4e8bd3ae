"""Licence scans: Aho-Corasick finds tags and notice phrases, a shunting-yard parser evaluates expressions.

Words are runs of ASCII letters and digits and of any non-ASCII characters, lower-cased in A-Z
only. All phrases are in one automaton over the words joined by single spaces, so one pass finds
every place of every phrase, overlapping ones too. The rest of the line after an identifier tag's colon is
read from the raw text as a licence expression of names, "and", "or", "with" and brackets; the parser
turns it into postfix and evaluates the least restriction that satisfies it.

Score: how restrictive the reading of the document's licences is, from 0 (none found, or public
domain) to 1 (all rights reserved). "or" takes the lesser, "and" the greater of its sides,
"with" an exception relieves its side by a quarter; a document takes the greatest of its findings.

Edge cases: a null text is an empty one, with no words, no labels and score 0; texts are scanned
whole, however long, in linear time; ties do not arise, as places are extremes and labels a set; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import map_arrow

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases beyond the base ones, as words, and their labels.
NOTICES = {
    "apache license": "apache", "mit license": "mit", "bsd license": "bsd", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "creative commons attribution": "cc-by", "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain", "unlicense": "unlicense", "isc license": "isc", "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "proprietary and confidential": "proprietary",
}
#: Words of an identifier tag; the expression follows them on the same line.
TAGS = ("spdx license identifier", "license expression")
TAG_REST = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")
RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Restriction of a label or a licence name, by its beginning; the longest beginning counts.
RESTRICTION = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "bsl": 0.1, "apache": 0.15, "cc-by": 0.2, "cc-by-sa": 0.5, "cc-by-nc": 0.7, "cc-by-nd": 0.7,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "gpl": 0.7, "agpl": 0.8, "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN = 0.6
POWER = {"or": 1, "and": 2, "with": 3}

NOT_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")


def spaced(text: str) -> str:
    """The words of a text, each between single spaces, as Latin-1 characters of their UTF-8 bytes."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(NOT_WORD).split()
    return (" " + b" ".join(words).decode("latin-1") + " ") if words else " "


def automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((kind, label))
    machine = ahocorasick.Automaton()
    for phrase, uses in found.items():
        machine.add_word(phrase, (len(phrase), uses))
    machine.make_automaton()
    return machine


def to_postfix(text: str) -> list[str]:
    """Shunting-yard: names, and/or/with and brackets to postfix; [] if the text is no expression. It ends where no expression can go on."""
    out: list[str] = []
    held: list[str] = []
    wants_name = True
    for m in TOKEN.finditer(text):
        token = m.group()
        low = token.lower()
        if token == "(":
            if not wants_name:
                break
            held.append(token)
        elif token == ")":
            if wants_name or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif low in POWER:
            if wants_name:
                return []
            while held and held[-1] != "(" and POWER[held[-1]] >= POWER[low]:
                out.append(held.pop())
            held.append(low)
            wants_name = True
        else:
            if not wants_name:
                break
            name = low.rstrip(".:-")
            if not name:
                break
            out.append(name)
            wants_name = False
    if wants_name or "(" in held:
        return []
    return out + held[::-1]


def restriction(name: str) -> float:
    best = max((k for k in RESTRICTION if name.startswith(k)), key=len, default=None)
    return UNKNOWN if best is None else RESTRICTION[best]


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """Restriction of an expression and the names of the licences in it (exceptions are no licences)."""
    stack: list[tuple[float, list[str]]] = []
    for token in postfix:
        if token not in POWER:
            stack.append((restriction(token), [token]))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a * 0.75, left))
        else:
            stack.append(((min if token == "or" else max)(a, b), left + right))
    return stack[0]


def after_tags(raw: str, last_words: list[int]) -> list[str]:
    """What follows the colon after each of the words of the given numbers, up to the end of the line."""
    data = raw.encode("utf-8", "surrogatepass")
    ends = [m.end() for m in RAW_WORD.finditer(data)]
    found = [TAG_REST.match(data, ends[k]) for k in last_words]
    return [m[1].decode("utf-8", "replace") for m in found if m]


def scan(text: str | None, machine: ahocorasick.Automaton) -> dict:
    raw = text or ""
    words = spaced(raw)
    base, labels, starts, tags = set(), set(), [], []
    for end, (length, uses) in machine.iter(words):
        for kind, label in uses:
            if kind == "tag":
                tags.append(end)
                continue
            labels.add(label)
            if kind == "base":
                base.add(label)
                starts.append(end - length + 1)
    # the number of a word is that of the spaces before it
    spaces = np.flatnonzero(np.frombuffer(words.encode("latin-1"), np.uint8) == 0x20) if starts or tags else None
    places = np.searchsorted(spaces, starts).tolist() if starts else []
    score = max((restriction(x) for x in labels), default=0.0)
    expressions = []
    for rest in after_tags(raw, (np.searchsorted(spaces, tags) - 1).tolist()) if tags else ():
        if postfix := to_postfix(rest):
            value, names = evaluate(postfix)
            score = max(score, value)
            labels.update(names)
            expressions.append(" ".join(postfix))
    return {
        "n_words": words.count(" ") - 1, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "expressions": "; ".join(expressions),
    }


RESULT = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double", "expressions": "string"}
ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and what scan() finds in its text."""

    def make():
        machine = automaton()

        def work(batch: pa.RecordBatch):
            rows = [scan(t, machine) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([r[k] for r in rows], ARROW[t]) for k, t in RESULT.items())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *RESULT])

        return work

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, make, f"doc_id {kind}, " + ", ".join(f"{k} {t}" for k, t in RESULT.items()))
