"""Checked paths, whole writes, hooks, the extraction cache, system events, refreshed manifests."""

import os
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.extract import cache
from weftgraph.operators import analyse, communities
from weftgraph.services import environment
from weftgraph.sources import files
from weftgraph.streaming.events import Events


def test_checked_paths(tmp_path):
    (tmp_path / "in").mkdir()
    good = tmp_path / "in/graph.json"
    good.write_text("{}")
    (tmp_path / "other.json").write_text("{}")
    assert environment.checked_path(str(good), str(tmp_path / "in")) == good.resolve()
    for path in (tmp_path / "in/none.json", tmp_path / "in", tmp_path / "in/../other.json"):
        with pytest.raises(ValueError):
            environment.checked_path(str(path), str(tmp_path / "in"))
    assert environment.checked_path(str(tmp_path / "other.json"))


def test_whole_writes(tmp_path):
    at = tmp_path / "a"
    environment.write_whole(at, "one")
    environment.write_whole(at, "two", 0o755)
    assert at.read_text() == "two" and at.stat().st_mode & 0o777 == 0o755 and os.listdir(tmp_path) == ["a"]


def test_hooks_keep_what_others_wrote(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    own = tmp_path / ".git/hooks/post-commit"
    own.parent.mkdir(exist_ok=True)
    own.write_text("#!/bin/sh\necho mine\n")
    for _ in range(2):
        assert environment.hook("install", str(tmp_path), str(tmp_path / "out")) == {"post-commit": True, "post-checkout": True}
    text = own.read_text()
    assert text.count(environment.BEGIN) == 1 and "echo mine" in text and "--update" in text and os.access(own, os.X_OK)
    assert subprocess.run(["sh", "-n", str(own)]).returncode == 0
    assert environment.hook("uninstall", str(tmp_path), "out") == {"post-commit": False, "post-checkout": False}
    assert own.read_text() == "#!/bin/sh\necho mine\n" and not (own.parent / "post-checkout").exists()
    environment.merge_driver(str(tmp_path))
    environment.merge_driver(str(tmp_path))
    assert (tmp_path / ".gitattributes").read_text() == "graph.json merge=weftgraph\n"
    with pytest.raises(ValueError):
        environment.hook("install", "/", "out")


def test_files_seen_before_are_not_extracted_again(spark, tmp_path, monkeypatch):
    def tree(*rows):
        return spark.createDataFrame([(f"/p/{n}.cls", "apex_class", f"public class {n} extends {b} {{ }}".encode()) for n, b in rows], "path string, kind string, content binary")

    seen = []
    monkeypatch.setattr(cache, "extract", lambda df, real=cache.extract: seen.append(sorted(r.path for r in df.collect())) or real(df))
    at = str(tmp_path / "cache")
    facts = lambda got: (sorted(r.id for r in got.nodes.collect()), sorted((r.source, r.target) for r in got.edges.collect()))
    first = facts(cache.extract_cached(tree(("A1", "X1"), ("B1", "X1")), at))
    again = facts(cache.extract_cached(tree(("A1", "X1"), ("B1", "X2"), ("C1", "X1")), at))
    assert first == (["apex_a1", "apex_b1"], [("apex_a1", "apex_x1"), ("apex_b1", "apex_x1")])
    assert again == (["apex_a1", "apex_b1", "apex_c1"], [("apex_a1", "apex_x1"), ("apex_b1", "apex_x2"), ("apex_c1", "apex_x1")])
    assert seen == [["/p/A1.cls", "/p/B1.cls"], ["/p/B1.cls", "/p/C1.cls"]]
    assert cache.clear(spark, at) == 4 and cache.keys(spark, at).isEmpty()


def test_events_of_new_folders_and_files(tmp_path):
    (tmp_path / "node_modules").mkdir()
    told = Events(str(tmp_path), files.watched, files.SKIP)

    def write():
        (tmp_path / "sub").mkdir()
        (tmp_path / "sub/a.cls").write_text("x")
        (tmp_path / "node_modules/b.cls").write_text("x")
        (tmp_path / "c.bin").write_text("x")
        (tmp_path / "d.cls").write_text("x")

    threading.Timer(0.1, write).start()
    got, until = set(), time.monotonic() + 5
    while time.monotonic() < until and len(got) < 2:
        got |= told.changed(0.2)
    told.close()
    assert {os.path.relpath(p, tmp_path) for p in got} == {"sub/a.cls", "d.cls"}


def test_refreshed_manifest_reads_new_times_only(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.cls").write_text(name)
        os.utime(tmp_path / f"{name}.cls", (1_700_000_000, 1_700_000_000))
    stored = files.manifest(files.detect(spark, str(tmp_path))[0])
    stored = spark.createDataFrame([(r.path, r.mtime, "kept" if r.path.endswith("a.cls") else r.hash) for r in stored.collect()], stored.schema)
    (tmp_path / "b.cls").write_text("changed")
    (tmp_path / "d.cls").write_text("new")
    (tmp_path / "c.cls").unlink()
    now = {r.path.rsplit("/", 1)[-1]: r.hash for r in files.refreshed(spark, str(tmp_path), stored).collect()}
    assert now.keys() == {"a.cls", "b.cls", "d.cls"} and now["a.cls"] == "kept" and now["b.cls"] == "8977dfac2f8e04cb96e66882235f5aba"
    (tmp_path / ".sfgraphignore").write_text("a.cls\n")
    assert {(r.skip_reason, r.n) for r in files.detect(spark, str(tmp_path))[1].collect()} == {(".sfgraphignore", 1)}


def test_edges_on_many_paths_stand_for_communities(spark):
    pairs = [("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f")]
    nodes = spark.createDataFrame([(x, x, "T", "apex", "one.cls") for x in "abcdef"], "id string, label string, sf_type string, file_type string, source_file string")
    edges = spark.createDataFrame([(s, t, "calls", "EXTRACTED", k) for k, (s, t) in enumerate(pairs)], "source string, target string, relation string, confidence string, ord long")
    got = {(r.source, r.target): r.betweenness for r in communities.edge_betweenness(nodes, edges).collect()}
    # paths over an edge: sources before it (itself in) times targets after it
    want = {("a", "c"): 4, ("b", "c"): 4, ("c", "d"): 9, ("d", "e"): 4, ("d", "f"): 4}
    assert got == {k: round(v / 30, 9) for k, v in want.items()}
    top = analyse.surprising(nodes, edges, spark.createDataFrame([], "id string, community int"), 1).first()
    assert (top.source, top.target, top.why) == ("c", "d", "lies on many paths (0.300)")
    assert communities.edge_betweenness(nodes, edges, most_nodes=5).isEmpty() and edges.where(F.col("ord") < 0).isEmpty()
