"""Updates, merges, stores, exports, the service and the command line over the built project."""

import io
import json
import zipfile

import pytest
from conftest import write_tree

from weftgraph import cli
from weftgraph.plans import pipeline
from weftgraph.services import rpc, semantic
from weftgraph.sinks import jsongraph, lines, pages

EDGE_KEYS = ["source", "target", "relation", "operation", "confidence", "source_file"]


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_update_of_an_unchanged_tree_changes_nothing_and_edits_replace(spark, tmp_path):
    root = tmp_path / "p"
    for name in ("classes/A.cls", "classes/B.cls"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / "classes/A.cls").write_text("public class A { public void go() { B.run(); } }")
    (root / "classes/B.cls").write_text("public class B { public static void run() { } }")
    out = str(tmp_path / "o")
    first = pipeline.run(spark, str(root), out)
    before = rows(first.nodes, "id", "label"), rows(first.edges, *EDGE_KEYS)
    assert cli.main(["check-update", str(root), "--out", out], spark) == 0
    again = pipeline.run(spark, str(root), out, update=True)
    assert (rows(again.nodes, "id", "label"), rows(again.edges, *EDGE_KEYS)) == before
    (root / "classes/B.cls").unlink()
    (root / "classes/C.cls").write_text("public class C { }")
    assert cli.main(["check-update", str(root), "--out", out], spark) == 1
    last = pipeline.run(spark, str(root), out, update=True)
    assert {r.id for r in last.nodes.where("source_file is not null").collect()} == {"apex_a", "method_a_go", "apex_c"}
    with pytest.raises(ValueError):
        pipeline.run(spark, str(tmp_path / "o"), str(tmp_path / "x"))


def test_json_round_trip_and_guard(spark, built, tmp_path):
    g, _ = built
    path = str(tmp_path / "graph.json")
    assert jsongraph.write(g, path, "abc")
    doc = json.loads(open(path).read())
    assert len(doc["nodes"]) == g.nodes.count() and len(doc["links"]) == g.edges.count() and doc["built_at_commit"] == "abc"
    assert all(e["confidence_score"] is not None for e in doc["links"]) and {"community", "norm_label"} <= doc["nodes"][0].keys()
    nodes, edges = jsongraph.read(spark, path)
    assert rows(nodes, "id", "label") == rows(g.nodes, "id", "label") and rows(edges, "source", "target", "relation") == rows(g.edges, "source", "target", "relation")
    small = pipeline.Graph(g.nodes.limit(2), g.edges.limit(0), g.members, g.labels)
    assert not jsongraph.write(small, path) and jsongraph.write(small, path, force=True)
    (tmp_path / "bad.json").write_text("{")
    assert jsongraph.read(spark, str(tmp_path / "bad.json"))[0].isEmpty() and jsongraph.read(spark, str(tmp_path / "none.json"))[1].isEmpty()


def test_merge_is_idempotent(spark, built):
    g, _ = built
    one = (g.nodes, g.edges.drop("key"))
    m = pipeline.merge(spark, [one, one])
    assert rows(m.nodes, "id") == rows(g.nodes, "id") and m.edges.count() == g.edges.drop("key", "source_file", "ord").distinct().count()
    with pytest.raises(ValueError):
        pipeline.merge(spark, [one])


def test_exports(built, tmp_path):
    g, _ = built
    n = g.nodes.count()
    assert lines.cypher(g.nodes, g.edges).count() == n + g.edges.count()
    pages.write_graphml(g, str(tmp_path / "g.graphml"))
    from xml.etree import ElementTree

    doc = ElementTree.parse(tmp_path / "g.graphml").getroot()
    assert sum(e.tag.endswith("}node") for e in doc.iter()) == n
    assert pages.svg(g, str(tmp_path / "g.svg")) == n and len(list(ElementTree.parse(tmp_path / "g.svg").getroot())) >= n
    assert pages.interactive(g, str(tmp_path / "g.html")) is False and pages.interactive(g, str(tmp_path / "c.html"), 5) is True
    assert pages.callflow(g, str(tmp_path / "f.html"), 10) == 10
    assert pages.tree(g, str(tmp_path / "t.html")) == n
    communities = g.members.select("community").distinct().count()
    assert pages.obsidian(g, str(tmp_path / "vault")) == n + communities and len(list((tmp_path / "vault").glob("*.md"))) == n + communities
    assert pages.wiki(g, str(tmp_path / "wiki")) == communities + 1 and (tmp_path / "wiki/index.md").exists()
    text = pages.report(g, "here", 60, "abcdef012345")
    assert all(f"## {h}" in text for h in ("Summary", "Coverage", "God Nodes", "Surprising Connections", "Communities", "Suggested Questions")) and "abcdef01" in text


def test_service(spark, built):
    s = rpc.Service(spark, built[1])

    def call(name, **args):
        return json.loads(rpc.handle(s, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})["result"]["content"][0]["text"])

    assert call("graph_stats")["nodes"] == built[0].nodes.count()
    assert call("get_node", label="OrderService")["id"] == "apex_orderservice"
    assert {r["relation"] for r in call("get_neighbors", label="OrderService", relation_filter="DML")["neighbors"]} == {"dml"}
    path = call("shortest_path", source="OrderTrigger", target="Account")
    assert path["found"] and path["path"][0]["from"] == "trigger_ordertrigger" and path["hop_count"] == len(path["path"])
    hit = call("bfs_impact", node="Order__c", direction="reverse", max_depth=2, include_inferred=True)
    assert {"trigger_ordertrigger", "apex_orderservice"} <= {r["id"] for r in hit["nodes"]} and hit["total_impacted"] == len(hit["nodes"])
    assert call("query", question="orderservice")["start_node"] == "apex_orderservice" and call("query", question="orderservice", mode="dfs")["nodes"][0]["id"] == "apex_orderservice"
    assert call("query", question="zzzz")["found"] is False
    c = call("list_communities")["communities"]
    assert call("get_community", community_id=0)["total_members"] == c[0]["member_count"] and call("get_community", label=c[0]["label"])["found"]
    assert call("god_nodes", limit=3)["god_nodes"][0]["degree"] >= 3
    for name in rpc.RESOURCES:
        assert rpc.handle(s, {"id": 2, "method": "resources/read", "params": {"uri": f"weftgraph://{name}"}})["result"]["contents"][0]["text"]
    out = []
    rpc.serve(s, ["\n", "{", '{"method": "ping"}', '{"id": 3, "method": "nope"}', '{"id": 4, "method": "ping"}', '{"id": 5, "method": "tools/list"}'], out.append)
    codes = [json.loads(x).get("error", {}).get("code") for x in out]
    assert codes == [-32700, -32601, None, None] and len(json.loads(out[3])["result"]["tools"]) == 9


def test_command_line(spark, tmp_path, capsys):
    root, out = write_tree(tmp_path / "p"), str(tmp_path / "o")
    assert cli.main(["stats", "--out", out], spark) == 1
    assert cli.main(["build", str(tmp_path / "none"), "--out", out], spark) == 1
    assert cli.main(["build", str(root), "--out", out], spark) == 0
    assert all((tmp_path / "o" / f).exists() for f in ("graph.json", "REPORT.md", "graph.html"))
    assert cli.main(["explain", "OrderService", "--out", out], spark) == 0 and "dml" in capsys.readouterr().out
    assert cli.main(["path", "OrderTrigger", "nowhere at all", "--out", out], spark) == 1
    assert cli.main(["export", "callflow", "--out", out], spark) == 0
    assert cli.main(["merge-graphs", f"{out}/graph.json", out, "--out", str(tmp_path / "m"), "--no-viz"], spark) == 0
    assert cli.main(["merge-graphs", out, "--out", out], spark) == 1


def test_semantic_layer_retries_and_bisects(spark):
    waits = []

    def call(prompt: str) -> semantic.Reply:
        if not waits:
            raise semantic.RateLimited(7)
        n = prompt.count("\n=== ")
        if n > 1:
            raise semantic.TooLong
        name = prompt.split("=== ")[1].split("\n")[0]
        return semantic.Reply('```json\n{"nodes": [{"id": "%s"}], "edges": []}\n```' % name, 10, 2)

    got = semantic.ask([("a", "x"), ("b", "y"), ("c", "z")], call, sleep=waits.append)
    assert [g["nodes"][0]["id"] for g, _ in got] == ["a", "b", "c"] and waits == [7]
    assert semantic.parse("no") is None and semantic.retry_after("retry-after: 12") == 12 and semantic.retry_after("please try again in 3.5s") == 3.5
    assert semantic.detect_backend({"OPENAI_API_KEY": "k"}) == "openai" and semantic.cost("openai", 10**6, 0) == 0.4

    def fake(prompt: str) -> semantic.Reply:
        if "boom" in prompt:
            raise RuntimeError("boom")
        return semantic.Reply(json.dumps({"nodes": [{"id": "n1", "label": "N"}], "edges": [{"source": "n1", "target": "n2", "relation": "uses", "confidence": "odd"}]}), 5, 1)

    files = spark.createDataFrame([("d/one.cls", "text"), ("e/two.cls", "boom")], "path string, text string")
    r = semantic.replies(files, fake)
    assert sorted((x.input_tokens, x.error) for x in r.collect()) == [(0, "RuntimeError: boom"), (5, None)]
    f = semantic.fragments(r)
    assert f.nodes.first().id == "n1" and f.edges.first().confidence == "INFERRED"


def test_push_sends_batches(built, tmp_path):
    from contextlib import contextmanager

    from weftgraph.services.neo4j import push

    log = str(tmp_path / "log")

    @contextmanager
    def opener():
        with open(log, "a") as f:
            yield lambda statement, rows: f.write(f"{len(rows)}\n")

    assert push(built[0], opener, 7) == (built[0].nodes.count(), built[0].edges.count())
    sent = [int(x) for x in open(log)]
    assert max(sent) <= 7


def office(parts: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_office_files(spark):
    from weftgraph.extract import documents
    from weftgraph.extract.office import docx_markdown, pdf_text, xlsx_markdown

    w = 'xmlns:w="http://w"'
    doc = office({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="ListBullet"/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert docx_markdown(doc) == "# Top\n- item\n| a |\n| --- |" and docx_markdown(b"x") == ""
    book = office(
        {
            "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>",
            "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Age</t></is></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>',
            "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships><Relationship Id="t" Target="../tables/table1.xml"/></Relationships>',
            "xl/tables/table1.xml": '<table displayName="People" ref="A1:B2"/>',
        }
    )
    assert xlsx_markdown(book) == "## Sheet: S1\n| Name | Age |\n| --- | --- |\n|  | 5 |" and xlsx_markdown(b"x") == ""
    assert pdf_text(b"stream\nBT (Hello \\(x\\)) Tj ET\nendstream") == "Hello (x)" and pdf_text(b"x") == ""
    files = spark.createDataFrame([("/d/b.xlsx", "document", bytearray(book)), ("/d/c.docx", "document", bytearray(doc))], "path string, kind string, content binary")
    got = documents.extract(files)
    assert {r.label for r in got.nodes.collect()} == {"b.xlsx", "c.docx", "S1 (sheet)", "People", "Name", "Age", "Top", "Sheet: S1"}
    assert got.edges.count() == 6


def test_registered_extractor(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftgraph import extract as x
    from weftgraph.extract.fragments import Fragments
    from weftgraph.sources import files

    (tmp_path / "a.toy").write_text("hello")
    before = files.SUFFIXES
    try:
        x.register_extractor("toy", (".toy",), lambda f: Fragments.of(f.sparkSession, f.select(F.lit("toy_a").alias("id"), F.col("text").alias("label"), F.col("path").alias("source_file"))))
        found, _ = files.detect(spark, str(tmp_path))
        assert [(r.id, r.label) for r in x.extract(found).nodes.collect()] == [("toy_a", "hello")]
    finally:
        files.SUFFIXES = before
        x.EXTRACTORS.pop("toy", None)
