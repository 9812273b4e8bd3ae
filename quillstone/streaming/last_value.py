"""The last digest of each source, kept between micro-batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


class LastDigest(StatefulProcessor):
    """Tells rows that differ from the last of their source from those that repeat it.

    Days and digests are not null; the first row of a source is stored. Rows of a micro-batch are
    compared with each other by day, then digest, the first of them with the row of the greatest day
    seen before (of equal days, of the greater digest). A row of an earlier day than that is marked
    late, is compared all the same, and does not become the last.
    """

    OUT = "source string, taken_on date, digest string, status string, late boolean"

    def init(self, handle):
        self.last = handle.getValueState("last", "taken_on date, digest string")

    def handleInputRows(self, key, rows, timerValues):
        (source,) = key
        newest = self.last.get() if self.last.exists() else None
        before, out = newest and newest[1], []
        # a day's rows of one source in one micro-batch: few
        batch = pd.concat(rows).sort_values(["taken_on", "digest"], kind="stable")
        for day, digest in zip(batch["taken_on"], batch["digest"], strict=True):
            same = bool(newest) and digest == before
            out.append((source, day, digest, "unchanged" if same else "stored", bool(newest) and day < newest[0]))
            newest, before = max(newest or (day, digest), (day, digest)), digest
        self.last.update(tuple(newest))
        yield pd.DataFrame(out, columns=["source", "taken_on", "digest", "status", "late"])

    def close(self):
        pass
