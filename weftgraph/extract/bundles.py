"""Web bundles and pages: sibling files joined by folder, read by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.extract.fragments import Fragments, both, each, edge, explode_edges, explode_nodes, ident, node
from weftgraph.functions.text import kebab_to_camel, make_id, stem

IMPORTED = "import\\s+(?:[\\w$*]+|\\{[^}]*\\})(?:\\s+as\\s+\\w+)?\\s+from\\s+[\"']([^\"']+)[\"']"
QUOTED = "\\s*=\\s*[\"']([^\"']+)[\"']"


def found(text: Column, pattern: str) -> Column:
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)), F.array().cast("array<string>"))


def first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def fragments(df: DataFrame) -> Fragments:
    return Fragments.of(df.sparkSession, explode_nodes(df), explode_edges(df))


def siblings(files: DataFrame, parts: dict[str, str]) -> DataFrame:
    """A row a bundle folder: its name and the text and path of each part, by the file's ending after the bundle's name."""
    own = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), "path", "text").withColumn("name", F.element_at(F.split("folder", "/"), -1))
    picks = [F.max(F.when(F.col("file") == F.concat("name", F.lit(end)), F.col(c))).alias(f"{part}_{c}") for part, end in parts.items() for c in ("text", "path")]
    return own.groupBy("folder", "name").agg(*picks)


def lwc(files: DataFrame) -> Fragments:
    df = siblings(files, {"js": ".js", "html": ".html"}).where("js_path is not null")
    me, js, name = make_id(F.lit("lwc"), "name"), F.col("js_text"), F.col("name")

    def imported(m: Column) -> Column:
        # the lambda's own variable can't be matched again inside; each form is told by its start
        apex, schema = m.startswith("@salesforce/apex/"), m.startswith("@salesforce/schema/")
        rest = F.regexp_extract(m, "^@salesforce/[A-Za-z]+/(?:c\\.)?([A-Za-z0-9_]+)", 1)
        more = F.regexp_extract(m, "^@salesforce/(?:apex|schema)/[A-Za-z0-9_]+\\.([A-Za-z0-9_]+)", 1)
        dotted = more != ""
        target = (
            F.when(apex & dotted, ident("method", rest, more))
            .when(apex, ident("apex", rest))
            .when(schema & dotted, ident("field", rest, more))
            .when(schema, ident("object", rest))
            .when(m.startswith("@salesforce/label/c."), ident("label", rest))
            .when(m.startswith("@salesforce/resourceUrl/"), ident("staticresource", rest))
            .when(m.startswith("c/"), ident("lwc", F.substr(m, F.lit(3))))
        )
        return edge(me, target, F.when(apex | m.startswith("c/"), "calls").when(schema, "references").otherwise("uses"))

    wires = F.filter(found(js, "@wire\\(\\s*([A-Za-z0-9_]+)"), lambda w: ~w.isin("LightningElement", "NavigationMixin", "Wire", "api", "wire", "track"))
    methods = F.filter(found(js, "(?m)^\\s{2,4}(?:async\\s+)?([A-Za-z][A-Za-z0-9_]*)\\s*\\([^)]*\\)\\s*\\{"), lambda m: ~m.isin("constructor", "if", "for", "while", "switch", "catch", "function", "return"))
    children = found(F.col("html_text"), "<c-([a-z0-9_-]+)")
    it = lambda m: ident("lwcmethod", name, m)
    nodes = both(F.array(node(me, name, "LWCComponent", "lwc")), each(methods, lambda m: node(it(m), F.concat(name, F.lit("."), m, F.lit("()")), "LWCMethod", "lwc")))
    edges = both(
        each(found(js, IMPORTED), imported),
        each(wires, lambda w: edge(me, ident("wireadapter", w), "uses", "INFERRED", 0.5)),
        each(methods, lambda m: edge(me, it(m), "contains")),
        each(children, lambda c: edge(me, ident("lwc", kebab_to_camel(c)), "uses")),
    )
    return fragments(df.select(F.col("js_path").alias("source_file"), nodes.alias("nodes"), edges.alias("edges")))


def aura(files: DataFrame) -> Fragments:
    df = siblings(files, {"cmp": ".cmp", "ctl": "Controller.js", "hlp": "Helper.js"}).where("cmp_path is not null")
    me, name, markup = make_id(F.lit("aura"), "name"), F.col("name"), F.col("cmp_text")
    server = first(markup, f"(?i)(?<![A-Za-z])controller{QUOTED}")
    parents = F.filter(found(markup, f"(?i)(?<![A-Za-z])extends{QUOTED}"), lambda p: p.contains(":"))
    nodes, edges = [F.array(node(me, name, "AuraComponent", "aura"))], [F.array(edge(me, ident("apex", server), "references")), each(parents, lambda p: edge(me, ident("aura", F.split_part(p, F.lit(":"), F.lit(2))), "extends", "INFERRED", 0.8)), each(found(markup, "<c:\\s*([A-Za-z0-9_-]+)"), lambda c: edge(me, ident("aura", c), "uses"))]
    for part, prefix, sf_type, tail in (("ctl", "auramethod", "AuraControllerMethod", ""), ("hlp", "aurahelper", "AuraHelperMethod", "Helper")):
        text = F.col(f"{part}_text")
        methods = found(text, "(?m)^\\s*([A-Za-z][A-Za-z0-9_]*)\\s*:\\s*function\\s*\\(")
        nodes.append(each(methods, lambda m, p=prefix, k=sf_type, t=tail: node(ident(p, name, m), F.concat(name, F.lit(f"{t}."), m, F.lit("()")), k, "aura")))
        edges.append(each(methods, lambda m, p=prefix: edge(me, ident(p, name, m), "contains")))
        edges.append(each(found(text, "(?i)\\.get\\s*\\(\\s*[\"']c\\.([A-Za-z0-9_]+)[\"']"), lambda m: edge(me, F.when(server.isNotNull(), ident("method", server, m)), "calls", "INFERRED", 0.7)))
    return fragments(df.select(F.col("cmp_path").alias("source_file"), both(*nodes).alias("nodes"), both(*edges).alias("edges")))


def visualforce(files: DataFrame) -> Fragments:
    """Pages and components."""
    page, text, name = F.col("kind") == "vf_page", F.col("text"), stem("path")
    me = F.when(page, make_id(F.lit("page"), name)).otherwise(make_id(F.lit("vfcomponent"), name))
    own = node(me, name, F.when(page, "ApexPage").otherwise("ApexComponent"), "visualforce")
    extensions = F.split(first(text, f"(?i)(?<![A-Za-z])extensions{QUOTED}"), ",")
    edges = both(
        F.array(edge(me, ident("apex", first(text, f"(?i)(?<![A-Za-z])controller{QUOTED}")), "references")),
        each(F.when(page, extensions), lambda x: edge(me, ident("apex", x), "references")),
        F.array(edge(me, F.when(page, ident("object", first(text, f"(?i)(?<![A-Za-z])standardController{QUOTED}"))), "references")),
        each(F.when(page, found(text, "(?i)<c:([A-Za-z0-9_]+)")), lambda c: edge(me, ident("vfcomponent", c), "uses")),
    )
    return fragments(files.select(F.col("path").alias("source_file"), F.array(own).alias("nodes"), edges.alias("edges")))
