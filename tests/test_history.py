"""Versions of files in a small git repository."""

import json
import os
import subprocess

from quillstone.plans import drift
from quillstone.sources import contracts, history


def test_pairs_of_two_dates(spark, tmp_path):
    repo = tmp_path / "specs"

    def run(*args, day="2024-01-01"):
        at = f"{day}T12:00:00+0000"
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@example.com", *args], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at})

    def commit(day, **files):
        for name, doc in files.items():
            path = repo / f"{name.replace('__', '/')}.json"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps({"openapi": "3.0.0", "paths": {p: {"get": {"responses": {}}} for p in doc}}))
        run("add", "-A", day=day)
        run("commit", "-qm", "x", day=day)

    repo.mkdir()
    run("init", "-q")
    commit("2024-01-01", v1__sky=["/a", "/b"], v1__same=["/s"], notes=["/n"])
    commit("2024-02-01", v1__sky=["/a", "/c"], v1__deep__new=["/d"])
    rows = history.commits(spark, str(repo))
    assert rows.count() == 2
    docs, said = history.pairs(spark, "sky", str(repo), "v1/*.json", "2024-01-15")
    assert (said["status"], said["matched"], said["changed"], said["observable_days"]) == ("ok", 3, 2, 31)
    found = {(r.kind, r.subject) for r in drift.findings(contracts.facts(docs)).collect()}
    assert found == {("endpoint_removed", "/b"), ("endpoint_added", "/c"), ("spec_added", "v1/deep/new.json")}
    assert history.probe(spark, str(repo), "v1/*.json", "2023-01-01") == "history_too_short" and history.probe(spark, str(repo), "v1/*.json", "2025-01-01") == "no_new_commit" and history.probe(spark, str(repo), "v2/*", "2024-01-15") == "no_match"
    assert sorted(r.spec_file for r in history.dump(spark, str(repo), "*.json", "2024-01-15").collect()) == ["notes.json", "v1/same.json", "v1/sky.json"]
    copy = history.clone(f"file://{repo}", str(tmp_path / "copy"))
    assert history.git(copy, "rev-parse", "HEAD") == history.git(str(repo), "rev-parse", "HEAD")
    commit("2024-03-01", v1__sky=["/a"])
    history.clone(f"file://{repo}", copy, fetch=True)
    assert history.commits(spark, copy).count() == 3
