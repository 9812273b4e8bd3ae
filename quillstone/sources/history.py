"""Descriptions published in a git repository, as tables: its commits, its tree at a commit, and pairs of files between two dates.

Commits and trees are read where the clone lies, by git; bodies are read by the tasks, so the clone
must be in a folder that all executors see.
"""

from __future__ import annotations

import fnmatch
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import compare

COMMITS = "ref string, at date, position bigint"
#: What came of asking for two versions.
OK, TOO_SHORT, UNCHANGED, NO_MATCH = "ok", "history_too_short", "no_new_commit", "no_match"


def git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()[:300]}")
    return done.stdout


def clone(url: str, folder: str, fetch: bool = False) -> str:
    """A clone without bodies, made if there is none; brought up to date if fetch is set. Returns the folder."""
    if not (Path(folder) / ".git").is_dir():
        Path(folder).parent.mkdir(parents=True, exist_ok=True)
        subprocess.run(["git", "clone", "--quiet", "--filter=blob:none", url, folder], check=True, capture_output=True)
    elif fetch:
        git(folder, "fetch", "--quiet", "origin")
        git(folder, "reset", "--quiet", "--hard", "origin/HEAD")
    return folder


def commits(spark: SparkSession, repo: str) -> DataFrame:
    """ref, at and position (0 is the head) of the commits of a clone."""
    import datetime

    lines = git(repo, "log", "--format=%H %cs").decode().split("\n")
    rows = [(line[:40], datetime.date.fromisoformat(line[41:]), k) for k, line in enumerate(filter(None, lines))]
    return spark.createDataFrame(rows, COMMITS)


def as_of(rows: DataFrame, bound: str) -> DataFrame:
    """One row: the latest commit before a date (null: the history is too short), the head, the first commit's date and how many days are there to see."""
    before = F.col("at") < F.lit(bound).cast("date")
    newest = F.struct("at", -F.col("position"))
    found = rows.agg(F.max_by(F.when(before, F.col("ref")), F.when(before, newest)).alias("old_ref"), F.min_by("ref", "position").alias("new_ref"), F.min("at").alias("first_day"), F.max("at").alias("last_day"))
    return found.select("old_ref", "new_ref", "first_day", F.datediff("last_day", "first_day").alias("observable_days"), F.when(F.col("old_ref").isNull(), TOO_SHORT).when(F.col("old_ref") == F.col("new_ref"), UNCHANGED).otherwise(OK).alias("status"))


def glob_pattern(glob: str) -> str:
    """A pattern for rlike of a file name pattern, whose * crosses folders."""
    return "^" + fnmatch.translate(glob).replace("\\Z", "").replace("\\z", "") + "$"


def tree(spark: SparkSession, repo: str, ref: str, glob: str = "*") -> DataFrame:
    """path and blob of the files of a commit whose path matches."""
    out = git(repo, "ls-tree", "-r", "-z", ref).decode("utf-8", "surrogateescape")
    rows = [(path, head.split(" ")[2]) for head, _, path in (line.partition("\t") for line in out.split("\0") if line)]
    return spark.createDataFrame(rows, "path string, blob string").where(F.col("path").rlike(glob_pattern(glob)))


def bodies(files: DataFrame, repo: str) -> DataFrame:
    """Adds body to files with a blob."""
    names = files.columns
    at = names.index("blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if x is None else git(repo, "cat-file", "blob", x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*names, "body"])

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", body binary")


def pairs(spark: SparkSession, vendor: str, repo: str, glob: str, since: str) -> tuple[DataFrame, dict]:
    """Documents (vendor, spec_file, side, body) of files that differ between the last commit before a date and the head, and what came of it: status, refs, and numbers of files matched and changed."""
    found = as_of(commits(spark, repo), since).first().asDict()
    none = spark.createDataFrame([], "vendor string, spec_file string, side string, body string")
    if found["status"] != OK:
        return none, found
    old, new = (tree(spark, repo, found[r], glob) for r in ("old_ref", "new_ref"))
    matched = old.select("path").union(new.select("path")).distinct().count()
    changed = compare.changed_pairs(old, new, ["path"], "blob")
    n = changed.count()
    found |= {"matched": matched, "changed": n, "status": OK if matched else NO_MATCH}
    side = lambda name, c: changed.where(F.col(c).isNotNull()).select(F.lit(vendor).alias("vendor"), F.col("path").alias("spec_file"), F.lit(name).alias("side"), F.col(c).alias("blob"))
    docs = bodies(side("old", "old_digest").unionByName(side("new", "new_digest")), repo)
    return docs.select("vendor", "spec_file", "side", F.col("body").cast("string").alias("body")), found


def dump(spark: SparkSession, repo: str, glob: str, bound: str) -> DataFrame:
    """spec_file and body of the files that match as they were before a date; none if the history is too short."""
    found = as_of(commits(spark, repo), bound).first()
    if found["old_ref"] is None:
        return spark.createDataFrame([], "spec_file string, body binary")
    return bodies(tree(spark, repo, found["old_ref"], glob), repo).select(F.col("path").alias("spec_file"), "body")


def probe(spark: SparkSession, repo: str, glob: str, since: str) -> str:
    """Whether a vendor's repository can be swept: ok, or why not."""
    return pairs(spark, "probe", repo, glob, since)[1]["status"]
