"""Documents for people: report, wiki, vault, HTML views, SVG.

What grows with the graph is formed as text by Spark, a row a file; single-page views take a bounded number of nodes by
degree (the bound is a parameter), or the graph of communities beyond it.
"""

from __future__ import annotations

import html
import json
import math
import os
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import file_name, slug
from weftgraph.operators import analyse, communities, measure
from weftgraph.plans.pipeline import Graph
from weftgraph.sinks.lines import graphml, mermaid_id

NODE_LIMIT = 5000
RELATIONS = ("calls", "invokes", "triggers", "queries", "dml", "references", "contains", "extends", "implements", "publishes", "subscribes", "makes_callout")


def named(graph: Graph) -> DataFrame:
    """Nodes with degree, community and its label."""
    name = F.coalesce("community_label", F.concat(F.lit("Community "), F.col("community").cast("string")))
    labels = graph.labels.select("community", F.col("label").alias("community_label"))
    return graph.nodes.join(measure.degrees(graph.nodes, graph.edges), "id").join(graph.members, "id", "left").join(labels, "community", "left").withColumn("community_label", name)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write ``rows(name, text)`` as files, each task its own; returns how many."""
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                aside = f"{folder}/.{name}.{os.getpid()}"
                with open(aside, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(aside, f"{folder}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def unique_names(df: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """``name``: the label as a file name, numbered where several share it whatever their case."""
    base = df.withColumn("_base", F.substring(file_name(F.coalesce(label, key)), 1, 120))
    k = F.row_number().over(Window.partitionBy(F.lower("_base")).orderBy(key)) - 1
    return base.withColumn("_k", k).withColumn("name", F.when(F.col("_k") > 0, F.concat_ws("_", "_base", "_k")).otherwise(F.col("_base"))).drop("_base", "_k")


def yaml(c) -> F.Column:
    return F.regexp_replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "[\\x00-\\x1f\\x7f]", " ")


def obsidian(graph: Graph, folder: str) -> int:
    """A note a node with links to its successors, a note a community, and colours by community."""
    info = unique_names(named(graph)).join(measure.dominant_confidence(graph.edges).select(F.col("source").alias("id"), F.col("confidence").alias("dominant")), "id", "left")
    to = info.select(F.col("id").alias("target"), F.col("name").alias("to_name"))
    line = F.concat(F.lit("- [["), "to_name", F.lit("]] - `"), "relation", F.lit("` ["), F.coalesce("confidence", F.lit("EXTRACTED")), F.lit("]"))
    links = graph.edges.join(to, "target").groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("to_name", line.alias("l")))), lambda s: s["l"]), "\n").alias("links"))
    tags = F.array(F.concat(F.lit("meta/"), F.coalesce("file_type", F.lit("unknown"))), F.concat(F.lit("meta/"), F.coalesce("dominant", F.lit("EXTRACTED"))), F.concat(F.lit("community/"), slug("community_label")))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit('source_file: "'), yaml(F.col("source_file")), F.lit('"')), F.concat(F.lit('sf_type: "'), yaml(F.col("sf_type")), F.lit('"')), F.concat(F.lit('file_type: "'), yaml(F.col("file_type")), F.lit('"')), F.concat(F.lit('community: "'), yaml(F.col("community_label")), F.lit('"')), F.concat(F.lit("location: L"), F.col("line").cast("string")), F.lit("tags:"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t)), "\n"), F.lit("---\n"), F.concat(F.lit("# "), F.coalesce("label", "id")), F.lit(""))
    notes = info.join(links, "id", "left").select(F.concat("name", F.lit(".md")).alias("name"), F.concat_ws("\n", head, F.concat(F.lit("## Connections\n"), "links", F.lit("\n")), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")).alias("text"))
    between = measure.community_edges(graph.edges, graph.members)
    both = between.select(F.col("a").alias("community"), F.col("b").alias("other"), "n").unionAll(between.select("b", "a", "n"))
    names = info.select("community", "community_label").distinct()
    near = both.join(names.select(F.col("community").alias("other"), F.col("community_label").alias("o")), "other").groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(F.concat("o", F.lit(": "), F.col("n").cast("string"), F.lit(" edges")))), "\n- ").alias("near"))
    members = info.groupBy("community", "community_label").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "name", F.lit("]]")))), "\n").alias("members"), F.count("*").alias("n"))
    overview = members.join(near, "community", "left").select(F.concat(F.lit("_COMMUNITY_"), slug("community_label"), F.lit("_"), F.col("community").cast("string"), F.lit(".md")).alias("name"), F.concat_ws("\n", F.concat(F.lit("# "), "community_label"), F.concat(F.col("n").cast("string"), F.lit(" nodes\n")), "members", F.concat(F.lit("\n## Connected\n- "), "near")).alias("text"))
    settings = Path(folder, ".obsidian")
    settings.mkdir(parents=True, exist_ok=True)
    groups = [{"query": f"tag:#community/{r.s}", "color": {"a": 1, "rgb": int(hue(k)[1:], 16)}} for k, r in enumerate(names.select(slug("community_label").alias("s")).distinct().orderBy("s").limit(64).collect())]
    (settings / "graph.json").write_text(json.dumps({"colorGroups": groups}, indent=1))
    return write_files(notes.unionAll(overview), folder)


def wiki(graph: Graph, folder: str) -> int:
    """A page a community, its nodes by type, each with up to eight neighbours, other communities' first; and an index."""
    info = named(graph)
    small = info.select("id", "label", "degree", "community", "community_label")
    s, t = (small.select(*[F.col(c).alias(f"{p}_{c}") for c in small.columns]) for p in "st")
    pairs = graph.edges.groupBy("source", "target").agg(F.min_by(F.struct("relation", "confidence"), "key").alias("e")).join(s, F.col("source") == F.col("s_id")).join(t, F.col("target") == F.col("t_id"))
    away = ~F.col("t_community").eqNullSafe(F.col("s_community"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(away.cast("int")), F.desc("t_degree"), "target"))
    line = F.concat(F.lit("- **"), "e.relation", F.lit("**"), F.coalesce(F.concat(F.lit(" `"), "e.confidence", F.lit("`")), F.lit("")), F.lit(" → "), "t_label", F.when(away, F.concat(F.lit(" *(in "), "t_community_label", F.lit(")*"))).otherwise(F.lit("")))
    near = pairs.withColumn("_r", rank).where("_r <= 8").groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x["l"]), "\n").alias("near"))
    entry = F.concat_ws("\n", F.concat(F.lit("### "), F.coalesce("label", "id"), F.coalesce(F.concat(F.lit(" — `"), "source_file", F.lit("`"), F.coalesce(F.concat(F.lit(" L"), F.col("line").cast("string")), F.lit(""))), F.lit(""))), F.lit(""), F.concat("near", F.lit("\n")))
    kinds = info.join(near, "id", "left").groupBy("community", "community_label", F.coalesce("sf_type", F.lit("Other")).alias("sf_type")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("label").alias("l"), "id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"), F.count("*").alias("n"))
    pages = kinds.groupBy("community", "community_label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sf_type", F.concat(F.lit("## "), "sf_type", F.lit("\n\n"), "body").alias("b")))), lambda x: x["b"]), "\n").alias("body"), F.sum("n").alias("n"))
    file = F.concat(slug("community_label"), F.lit("-"), F.col("community").cast("string"), F.lit(".md"))
    n = write_files(pages.select(file.alias("name"), F.concat(F.lit("# "), "community_label", F.lit("\n\n"), "body").alias("text")), folder)
    rows = pages.select(file.alias("f"), "community_label", "n").orderBy("community")
    with open(f"{folder}/index.md", "w", encoding="utf-8") as f:
        f.write(f"# Wiki\n\n**{graph.nodes.count()} nodes · {graph.edges.count()} edges · {n} communities**\n\n## Communities\n\n")
        f.writelines(f"- [{r.community_label}]({r.f}) — {r.n} nodes\n" for r in rows.toLocalIterator())
    return n + 1


def hue(k: int) -> str:
    """Colours far apart for numbers close together."""
    h = (k * 0.618034) % 1
    f = lambda n: round(255 * (0.55 - 0.3 * max(-1, min((n + h * 12) % 12 - 3, 9 - (n + h * 12) % 12, 1))))
    return f"#{f(0):02x}{f(8):02x}{f(4):02x}"


def view(graph: Graph, limit: int) -> tuple[list[dict], list[dict], bool]:
    """Nodes and edges to draw: the graph, or beyond ``limit`` nodes that of its communities."""
    if graph.nodes.limit(limit + 1).count() <= limit:
        nodes = [r.asDict() for r in named(graph).select("id", "label", "sf_type", "source_file", "degree", F.coalesce("community", F.lit(-1)).alias("community"), "community_label").orderBy("id").collect()]
        edges = [r.asDict() for r in graph.edges.select("source", "target", "relation", "confidence").orderBy("source", "target", "relation").collect()]
        return nodes, edges, False
    size = graph.members.groupBy("community").agg(F.count("*").alias("degree")).join(graph.labels, "community", "left").orderBy(F.desc("degree"), "community").limit(limit)
    nodes = [{"id": f"c{r.community}", "label": f"{r.label or r.community} ({r.degree})", "sf_type": "Community", "source_file": None, "degree": r.degree, "community": r.community, "community_label": r.label} for r in size.collect()]
    there = {n["id"] for n in nodes}
    rows = measure.community_edges(graph.edges, graph.members).orderBy(F.desc("n"), "a", "b").limit(20 * limit).collect()
    return nodes, [{"source": f"c{r.a}", "target": f"c{r.b}", "relation": f"{r.n} edges", "confidence": "AGGREGATED"} for r in rows if {f"c{r.a}", f"c{r.b}"} <= there], True


def script_json(obj) -> str:
    return json.dumps(obj, ensure_ascii=False).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def page(title: str, body: str, script: str = "") -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;margin:0}}#side{{position:fixed;right:0;top:0;width:320px;height:100%;overflow:auto;background:#fff;border-left:1px solid #ccc;padding:8px;box-sizing:border-box}}svg{{width:calc(100% - 320px);height:100vh}}li{{cursor:pointer}}</style></head><body>{body}<script>{script}</script></body></html>'


VIEWER = """
const byId=new Map(G.nodes.map(n=>[n.id,n])),near=new Map(G.nodes.map(n=>[n.id,[]])),hidden=new Set(),$=q=>document.querySelector(q);
G.edges.forEach(e=>{near.get(e.source)?.push([e.target,e.relation,'→']);near.get(e.target)?.push([e.source,e.relation,'←'])});
function draw(){const on=n=>!hidden.has(n.community);let s='';G.edges.forEach(e=>{const a=byId.get(e.source),b=byId.get(e.target);if(a&&b&&on(a)&&on(b))s+=`<line x1="${a.x}" y1="${a.y}" x2="${b.x}" y2="${b.y}" stroke="#bbb" ${e.confidence=='EXTRACTED'?'':'stroke-dasharray="4"'}/>`});
G.nodes.forEach((n,i)=>{if(on(n))s+=`<circle data-i="${i}" cx="${n.x}" cy="${n.y}" r="${4+Math.sqrt(n.degree)}" fill="${n.color}"/>`});$('#g').innerHTML=s}
function text(tag,t){const e=document.createElement(tag);e.textContent=t;return e}
function show(n){const d=$('#info');d.replaceChildren(text('h3',n.label),text('p',`${n.sf_type||''} · ${n.degree} edges · ${n.source_file||''}`));const u=document.createElement('ul');near.get(n.id).forEach(([o,r,w])=>{const m=byId.get(o);if(m){const l=text('li',`${w} ${r} ${m.label}`);l.onclick=()=>show(m);u.append(l)}});d.append(u)}
$('#g').onclick=e=>{const i=e.target.dataset.i;if(i!=null)show(G.nodes[i])};
$('#q').oninput=e=>{const v=e.target.value.toLowerCase(),u=$('#hits');u.replaceChildren();if(v)G.nodes.filter(n=>(n.label||'').toLowerCase().includes(v)).slice(0,20).forEach(n=>{const l=text('li',n.label);l.onclick=()=>show(n);u.append(l)})};
const boxes=new Map();[...new Map(G.nodes.map(n=>[n.community,n])).values()].forEach(n=>{const l=text('label',` ${n.community_label||n.community}`),b=document.createElement('input');b.type='checkbox';b.checked=true;b.onchange=()=>{b.checked?hidden.delete(n.community):hidden.add(n.community);draw()};boxes.set(n.community,b);l.prepend(b);$('#legend').append(l,document.createElement('br'))});
$('#all').onchange=e=>{boxes.forEach((b,c)=>{b.checked=e.target.checked;e.target.checked?hidden.delete(c):hidden.add(c)});draw()};draw();
"""


def place(nodes: list[dict], size: float = 1000.0) -> None:
    """Positions by community on a ring, members on a spiral around its centre."""
    groups: dict = {}
    for n in nodes:
        groups.setdefault(n["community"], []).append(n)
    ring = sorted(groups, key=lambda c: (-len(groups[c]), c))
    for k, c in enumerate(ring):
        angle, far = 2 * math.pi * k / max(1, len(ring)), 0.0 if len(ring) == 1 else 0.36 * size
        for j, n in enumerate(sorted(groups[c], key=lambda n: (-n["degree"], n["id"]))):
            r, a = 9 * math.sqrt(j), 2.39996 * j
            n["x"], n["y"] = round(size / 2 + far * math.cos(angle) + r * math.cos(a), 1), round(size / 2 + far * math.sin(angle) + r * math.sin(a), 1)
            n["color"] = hue(k)


def interactive(graph: Graph, path: str, limit: int | None = None) -> bool:
    """The searchable view; whether it shows communities in place of nodes."""
    nodes, edges, merged = view(graph, limit or int(os.environ.get("WEFTGRAPH_VIZ_NODE_LIMIT", NODE_LIMIT)))
    place(nodes)
    body = '<svg id="g" viewBox="0 0 1000 1000"></svg><div id="side"><input id="q" placeholder="search"><ul id="hits"></ul><div id="info"></div><label><input type="checkbox" id="all" checked> all communities</label><div id="legend"></div></div>'
    Path(path).write_text(page("Graph", body, f"const G={script_json({'nodes': nodes, 'edges': edges})};{VIEWER}"), encoding="utf-8")
    return merged


def svg(graph: Graph, path: str, limit: int = 1000) -> int:
    """A still picture."""
    nodes, edges, _ = view(graph, limit)
    place(nodes)
    at = {n["id"]: n for n in nodes}
    out = ['<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000">']
    out += [f'<line x1="{at[e["source"]]["x"]}" y1="{at[e["source"]]["y"]}" x2="{at[e["target"]]["x"]}" y2="{at[e["target"]]["y"]}" stroke="#bbb"/>' for e in edges if e["source"] in at and e["target"] in at]
    out += [f'<circle cx="{n["x"]}" cy="{n["y"]}" r="{4 + math.sqrt(n["degree"]):.1f}" fill="{n["color"]}"><title>{html.escape(n["label"] or n["id"])}</title></circle>' for n in nodes]
    Path(path).write_text("\n".join([*out, "</svg>"]), encoding="utf-8")
    return len(nodes)


def callflow(graph: Graph, path: str, max_nodes: int = 60, max_edges: int = 120) -> int:
    """A Mermaid flow chart of the typed nodes of highest degree and the edges of behaviour between them."""
    typed = F.coalesce(F.col("sf_type") != "", F.lit(False))
    top = named(graph).orderBy(F.desc(typed), F.desc("degree"), "id").limit(max_nodes).select("id", "label", "sf_type", mermaid_id("id").alias("m"))
    ids = top.select(F.col("id").alias("i"))
    rows = graph.edges.where(F.col("relation").isin(*RELATIONS)).join(ids, F.col("source") == F.col("i"), "left_semi").join(ids, F.col("target") == F.col("i"), "left_semi").orderBy("source", "target", "key").limit(max_edges)
    nodes, edges = top.collect(), rows.select("source", "target", "relation", "confidence", mermaid_id("source").alias("a"), mermaid_id("target").alias("b")).collect()
    lines = ["flowchart LR"]
    for kind in sorted({n.sf_type or "Other" for n in nodes}):
        lines.append(f'  subgraph {kind}["{kind}"]')
        for n in nodes:
            if (n.sf_type or "Other") == kind:
                label = (n.label or n.id).replace('"', "'")
                lines.append(f'    {n.m}["{label[:28] + ".." if len(label) > 30 else label}"]')
        lines.append("  end")
    solid = {"triggers": "==>", "dml": "==>", "contains": "---"}
    lines += [f"  {e.a} {solid.get(e.relation, '-->') if e.confidence == 'EXTRACTED' else '-.->'}|{e.relation}| {e.b}" for e in edges]
    Path(path).write_text(page("Call flow", f'<pre class="mermaid">\n{html.escape(chr(10).join(lines))}\n</pre>'), encoding="utf-8")
    return len(nodes)


def tree(graph: Graph, path: str, limit: int = NODE_LIMIT) -> int:
    """Communities, their types and nodes as nested lists that fold."""
    rows = named(graph).orderBy("community", "sf_type", "label", "id").limit(limit).select("community", "community_label", "sf_type", "label", "id").collect()
    out, last = ["<ul>"], (None, None)
    for r in rows:
        if r.community != last[0]:
            out.append(("</ul></details></ul></details>" if last[0] is not None else "") + f"<details open><summary>{html.escape(str(r.community_label))}</summary><ul>")
            last = (r.community, None)
        if (r.sf_type or "Other") != last[1]:
            out.append(("</ul></details>" if last[1] is not None else "") + f"<details><summary>{html.escape(r.sf_type or 'Other')}</summary><ul>")
            last = (r.community, r.sf_type or "Other")
        out.append(f"<li>{html.escape(r.label or r.id)}</li>")
    Path(path).write_text(page("Tree", "\n".join([*out, "</ul></details></ul></details></ul>" if rows else "</ul>"])), encoding="utf-8")
    return len(rows)


def write_graphml(graph: Graph, path: str) -> None:
    keys = ("label", "sf_type", "file_type", "source_file"), ("relation", "confidence")
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.writelines(f'<key id="{k}" for="{what}" attr.name="{k}" attr.type="string"/>\n' for what, names in zip(("node", "edge"), keys, strict=True) for k in names)
        f.write('<graph edgedefault="directed">\n')
        f.writelines(r.line + "\n" for r in graphml(graph.nodes, graph.edges).orderBy("part", "line").toLocalIterator())
        f.write("</graph>\n</graphml>\n")


def report(graph: Graph, root: str, files: int | None = None, commit: str | None = None, cost: dict | None = None, thin: int = 3, top: int = 50) -> str:
    """The Markdown report; ``top`` bounds its lists of communities and doubtful edges."""
    g = graph
    s = measure.stats(g.nodes, g.edges).first()
    audit = {r.confidence: r for r in measure.audit(g.edges).collect()}
    percent = " · ".join(f"{int(audit[c].percent) if c in audit else 0}% {c}" for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS"))
    inferred = f" · INFERRED: {audit['INFERRED'].n} edges (avg confidence: {audit['INFERRED'].mean_score})" if "INFERRED" in audit else ""
    info = named(g)
    shown = info.where(~measure.noise())
    place = F.row_number().over(Window.partitionBy("community").orderBy("label", "id"))
    first = shown.select("community", "label", place.alias("_n")).where("_n <= 8").groupBy("community").agg(F.array_sort(F.collect_list("label")).alias("some"))  # eight at most
    groups = shown.groupBy("community", "community_label").agg(F.count("*").alias("n")).join(first, "community")
    count = g.members.select("community").distinct().count()
    n_thin = groups.where(F.col("n") < thin).count()
    big = groups.where(F.col("n") >= thin).join(measure.cohesion(g.edges, g.members).select("community", "cohesion"), "community").orderBy("community").limit(top).collect()
    out = [f"# Graph report - {root}  ({date.today().isoformat()})", "", "## Corpus Check", f"- {files if files is not None else s.nodes} files scanned", "", "## Summary", f"- {s.nodes} nodes · {s.edges} edges · {count} communities" + (f" ({count - n_thin} shown, {n_thin} thin omitted)" if n_thin else ""), f"- Extraction: {percent}{inferred}"]
    if cost:
        out.append(f"- Tokens: {cost.get('input', 0)} in · {cost.get('output', 0)} out")
    out += ["", "## Coverage", *[f"- **{r.file_type}**: {r.n} nodes" for r in measure.distribution(g.nodes, "file_type").orderBy(F.desc("n"), "file_type").collect()]]
    if commit:
        out += ["", "## Freshness", f"- Built from commit: `{commit[:8]}`"]
    out += ["", "## Community Hubs", *[f"- [[_COMMUNITY_{b.community_label}|{b.community_label}]]" for b in big]]
    out += ["", "## God Nodes", *[f"{k}. `{r.label}` ({r.sf_type}) - {r.degree} edges" for k, r in enumerate(analyse.hubs(g.nodes, g.edges).collect(), 1)]]
    rows = analyse.surprising(g.nodes, g.edges, g.members).collect()
    out += ["", "## Surprising Connections", *([f"- `{r.source}` --{r.relation}--> `{r.target}`  [{r.confidence}]  _{r.why}_" for r in rows] or ["- None detected"])]
    out += ["", f"## Communities ({count} total, {n_thin} thin omitted)"]
    for b in big:
        more = f" (+{b.n - 8} more)" if b.n > 8 else ""
        out += ["", f'### Community {b.community} - "{b.community_label}"', f"Cohesion: {b.cohesion}", f"Nodes ({b.n}): {', '.join(x or '' for x in b.some)}{more}"]
    doubt = g.edges.where("confidence = 'AMBIGUOUS'").orderBy("source", "target", "relation").limit(top).collect()
    if doubt:
        out += ["", "## Ambiguous Edges", *[f"- `{r.source}` → `{r.target}`  [AMBIGUOUS] {r.relation}" for r in doubt]]
    alone = shown.where((F.col("degree") <= 1) & ~measure.concept()).select("id", "label")
    n_lone, some = alone.count(), [r.label for r in alone.orderBy("label", "id").limit(5).collect()]
    if n_lone or n_thin:
        out += ["", "## Knowledge Gaps", f"- Nodes with one edge or none: {n_lone}" + (f", among them {', '.join(f'`{x}`' for x in some)}" if some else ""), f"- **{n_thin} thin communities (<{thin} nodes) omitted**"]
    out += ["", "## Suggested Questions", *[f"- **{r.question}**" for r in analyse.questions(g.nodes, g.edges, g.members, communities.betweenness(g.nodes, g.edges)).collect()]]
    return "\n".join(out) + "\n"
