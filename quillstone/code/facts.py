"""Source files as rows of facts, of one schema for all languages that can be read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quillstone.code import javascript_facts, python_facts
from quillstone.sources import files

FACTS = (
    "repo string, path string, language string, fact string, line int, text string, chain string, target string, module string, keys array<string>, strings array<string>, methods array<string>, position array<string>, "
    "origins array<string>, registers boolean"
)
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def read(path: str, text: str | None) -> list[dict]:
    """Facts of a file; one of kind "unreadable", with the reason as its text, if it cannot be read."""
    suffix = path[path.rfind(".") :].lower()
    try:
        return (python_facts if suffix == ".py" else javascript_facts).facts(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"fact": "unreadable", "line": 0, "text": f"{type(e).__name__}: {e}"[:160]}]


def facts(sources: DataFrame) -> DataFrame:
    """Rows of FACTS of files (repo, path, text) in languages that can be read; a file is one task's work, whatever its size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                out = pd.DataFrame(read(f.path, f.text), columns=COLUMNS).astype(object)
                suffix = f.path[f.path.rfind(".") :].lower()
                out[["repo", "path", "language"]] = f.repo, f.path, files.PROVABLE[suffix]
                yield out.where(out.notna(), None)

    return sources.where(files.is_provable(sources["path"])).select("repo", "path", "text").mapInPandas(run, FACTS)
