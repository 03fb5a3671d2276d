"""The command line: build, ask, compare, merge, export, watch and serve graphs."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import functions as F

from weftgraph.extract import cache
from weftgraph.operators import measure
from weftgraph.plans import pipeline
from weftgraph.services import environment
from weftgraph.services.rpc import Service, serve
from weftgraph.session import exists, session
from weftgraph.sinks import jsongraph, pages
from weftgraph.sinks.lines import cypher
from weftgraph.sources import files as tree
from weftgraph.streaming import watch as watching

OUT = "weftgraph-out"
FORMATS = ("json", "cypher", "graphml", "html", "viz", "svg", "callflow", "callflow-html", "tree", "obsidian", "wiki", "neo4j")


def dotenv(path: str = ".env") -> dict[str, str]:
    """Keys of a file that the environment doesn't have."""
    out = {}
    if os.path.isfile(path):
        for line in Path(path).read_text(errors="ignore").splitlines():
            key, sep, value = line.strip().removeprefix("export ").partition("=")
            if sep and key.strip() and not key.startswith("#") and key.strip() not in os.environ:
                out[key.strip()] = value.strip().strip("'\"")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *where: str, **more):
        s = sub.add_parser(name)
        for w in where:
            s.add_argument(w, **more.get(w, {}))
        s.add_argument("--out", default=OUT)
        return s

    b = add("build", "path")
    for flag in ("--update", "--no-viz", "--force", "--verbose", "--include-ignored"):
        b.add_argument(flag, action="store_true")
    b.add_argument("--backend")
    b.add_argument("--token-budget", type=int, default=40_000)
    b.add_argument("--max-workers", type=int, default=4)
    q = add("query", "question")
    q.add_argument("--dfs", action="store_true")
    q.add_argument("--budget", type=int, default=2000)
    add("path", "source", "target")
    add("explain", "label").add_argument("--relation")
    add("stats")
    add("cluster-only").add_argument("--no-viz", action="store_true")
    add("check-update", "path")
    m = add("merge-graphs", "graphs", graphs={"nargs": "+"})
    m.add_argument("--no-viz", action="store_true")
    add("merge-driver", "base", "ours", "theirs")
    e = add("export", "format", format={"choices": FORMATS})
    e.add_argument("--to")
    for k, v in (("--uri", "bolt://localhost:7687"), ("--user", "neo4j"), ("--password", ""), ("--database", "neo4j")):
        e.add_argument(k, default=v)
    add("hook", "action", "path", action={"choices": ("install", "uninstall", "status")})
    add("merge-driver-setup", "path")
    add("clear-cache", "folder")
    w = add("watch", "path")
    w.add_argument("--nice", type=int, default=0)
    w.add_argument("--memory-mb", type=int)
    w.add_argument("--poll", type=float, default=5.0)
    w.add_argument("--no-events", action="store_true")
    w.add_argument("--debounce", type=float, default=3.0)
    w.add_argument("--rounds", type=int)
    add("serve")
    return p


def read(spark, path: str):
    """(nodes, edges) of a stored graph or of a JSON document."""
    if path.endswith(".json"):
        return jsongraph.read(spark, path)
    g = pipeline.load(spark, path)
    return g.nodes, g.edges.drop("key")


def outputs(graph, root: str, out: str, viz: bool, force: bool, files: int | None = None) -> None:
    """Documents for people and other tools, written on the driver's machine."""
    os.makedirs(out, exist_ok=True)
    commit = pipeline.git_head(root)
    Path(out, "REPORT.md").write_text(pages.report(graph, root, files, commit), encoding="utf-8")
    jsongraph.write(graph, f"{out}/graph.json", commit, force)
    if viz:
        pages.interactive(graph, f"{out}/graph.html")
    else:
        Path(out, "graph.html").unlink(missing_ok=True)
    if Path(out, "callflow.html").exists():
        pages.callflow(graph, f"{out}/callflow.html")


def export(spark, args) -> None:
    g = pipeline.load(spark, args.out)
    kind = args.format
    to = args.to or f"{args.out}/{ {'json': 'graph.json', 'cypher': 'cypher', 'graphml': 'graph.graphml', 'svg': 'graph.svg', 'tree': 'tree.html', 'obsidian': 'vault', 'wiki': 'wiki'}.get(kind, 'callflow.html' if kind.startswith('callflow') else 'graph.html')}"
    if kind == "json":
        jsongraph.write(g, to, force=True)
    elif kind == "cypher":
        cypher(g.nodes, g.edges).write.mode("overwrite").text(to)
    elif kind == "neo4j":
        push_neo4j(g, args)
    else:
        {"graphml": pages.write_graphml, "html": pages.interactive, "viz": pages.interactive, "svg": pages.svg, "tree": pages.tree, "obsidian": pages.obsidian, "wiki": pages.wiki}.get(kind, pages.callflow)(g, to)
    print(to)


def push_neo4j(g, args) -> None:
    from contextlib import contextmanager

    from weftgraph.services.neo4j import push

    uri, user, password, database = args.uri, args.user, args.password or os.environ.get("NEO4J_PASSWORD", ""), args.database

    @contextmanager
    def opener():
        import neo4j  # optional: only where the database's own driver is installed

        with neo4j.GraphDatabase.driver(uri, auth=(user, password)) as driver, driver.session(database=database) as s:
            yield lambda statement, rows: s.run(statement, rows=rows).consume()

    print(push(g, opener))


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    os.environ.update(dotenv())
    spark = spark or session(os.environ.get("WEFTGRAPH_MASTER", "local[*]"))
    out = args.out
    if args.command in ("query", "path", "explain", "stats", "cluster-only", "export", "serve") and not exists(spark, f"{out}/nodes.parquet"):
        print(f"no graph in {out}", file=sys.stderr)
        return 1
    match args.command:
        case "build":
            return build(spark, args)
        case "query":
            got = Service(spark, out).query({"question": args.question, "budget": args.budget, "mode": "dfs" if args.dfs else "bfs"})
            for n in got["nodes"]:
                print(f"{'  ' * n['depth']}{n['label']} ({n['sf_type']}) {n['source_file'] or ''}")
            if not got["found"]:
                print("nothing matches")
        case "path":
            service = Service(spark, out)
            if not service.find(args.source) or not service.find(args.target):
                print("no such node", file=sys.stderr)
                return 1
            got = service.shortest_path({"source": args.source, "target": args.target})
            print("\n".join(f"{h['from']} --{h['relation']}--> {h['to']}" for h in got["path"]) if got["found"] else "no path")
        case "explain":
            service = Service(spark, out)
            n = service.get_node({"label": args.label})
            print("nothing matches" if not n["found"] else f"{n['label']} ({n['sf_type']}), {n['degree']} edges, {n['source_file'] or ''}")
            for r in service.get_neighbors({"label": args.label, "relation_filter": args.relation})["neighbors"] if n["found"] else []:
                print(f"  --{r['relation']}--> {r['label']} [{r['confidence']}]")
        case "stats":
            g = pipeline.load(spark, out)
            measure.stats(g.nodes, g.edges).show(truncate=False)
            for df, c, missing in ((g.nodes, "sf_type", "unknown"), (g.nodes, "file_type", "unknown"), (g.edges, "relation", "unknown"), (g.edges, "confidence", "EXTRACTED")):
                measure.distribution(df, c, missing).orderBy(F.desc("n"), c).show(50, truncate=False)
            measure.degrees(g.nodes, g.edges).orderBy(F.desc("degree"), "id").show(10, truncate=False)
        case "cluster-only":
            g = pipeline.load(spark, out)
            pipeline.store(pipeline.clustered(g.nodes, g.edges), None, out)
            outputs(pipeline.load(spark, out), out, out, not args.no_viz, True)
        case "check-update":
            old = pipeline.stored_manifest(spark, out)
            if old is None:
                print("no manifest")
                return 1
            changed = tree.compare(old, tree.refreshed(spark, args.path, old)).where("change <> 'same'").groupBy("change").count().collect()
            print(", ".join(f"{r['count']} {r.change}" for r in changed) or "up to date")
            return int(bool(changed))
        case "merge-graphs":
            if len(args.graphs) < 2:
                print("two graphs at least", file=sys.stderr)
                return 1
            os.makedirs(out, exist_ok=True)
            pipeline.store(pipeline.merge(spark, [read(spark, p) for p in args.graphs]), None, out)
            outputs(pipeline.load(spark, out), out, out, not args.no_viz, True)
        case "merge-driver":
            g = pipeline.merge(spark, [read(spark, p) for p in (args.ours, args.theirs, args.base)])
            jsongraph.write(g, args.ours, force=True)
        case "export":
            export(spark, args)
        case "hook":
            for name, there in environment.hook(args.action, args.path, out).items():
                print(f"{name}: {'installed' if there else 'not installed'}")
        case "merge-driver-setup":
            environment.merge_driver(args.path)
        case "clear-cache":
            print(f"{cache.clear(spark, args.folder)} files forgotten")
        case "watch":
            if args.nice or args.memory_mb:
                environment.limit(args.nice, args.memory_mb)

            def rebuild(_: list[str]) -> None:
                graph = pipeline.run(spark, args.path, out, update=True)
                outputs(graph, args.path, out, False, True)

            if not exists(spark, f"{out}/nodes.parquet"):
                rebuild([])
            watching.watch(spark, args.path, rebuild, args.debounce, args.poll, args.rounds, f"{out}/.lock", not args.no_events)
        case "serve":
            serve(Service(spark, out))
    return 0


def build(spark, args) -> int:
    if not Path(args.path).exists():
        print(f"no such path: {args.path}", file=sys.stderr)
        return 1
    semantic = None
    if args.backend:
        from weftgraph.services import semantic as llm

        call = llm.caller(args.backend)

        def semantic(files):
            texts = files.where(~F.col("kind").isin("image", "paper")).select("path", F.decode("content", "UTF-8").alias("text"))
            got = llm.replies(texts, call, args.token_budget, args.max_workers)
            for r in got.where("error is not null").limit(20).collect():
                print(f"a chunk failed: {r.source_file}: {r.error}", file=sys.stderr)
            return llm.fragments(got)

    _, skipped = tree.detect(spark, args.path, not args.include_ignored)
    for r in skipped.collect():
        print(f"{r.n} files skipped: {r.skip_reason}")
    try:
        told = (lambda counts: print(", ".join(f"{k} {v}" for k, v in counts.items()))) if args.verbose else None
        graph = pipeline.run(spark, args.path, args.out, args.update, not args.include_ignored, args.force, semantic, told)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    outputs(graph, args.path, args.out, not args.no_viz, args.force or args.update, pipeline.stored_manifest(spark, args.out).count())
    s = measure.stats(graph.nodes, graph.edges).first()
    print(f"{s.nodes} nodes, {s.edges} edges in {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
