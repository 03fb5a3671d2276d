"""Scalar functions, text extraction and incremental operators over the tables' texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.extract import markdown, web
from weftgraph.functions import text as X
from weftgraph.operators import resolve, traverse
from weftgraph.sources import files
from weftgraph.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, trim(lower(regexp_replace('field_' || trim(p_brand, '_. ') || '_' || trim(p_type, '_. '), '[^a-zA-Z0-9_]+', '_', 'g')), '_') AS id FROM part")
def node_id_build(spark, d):
    return T.read(spark, d, "part").select("p_partkey", X.make_id(F.lit("field"), "p_brand", "p_type").alias("id"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' ') AS label FROM documents")
def label_normalise(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.norm_label("text").alias("label"))


@query(r"SELECT doc_id, substring(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), 1, 256) AS label FROM documents")
def label_sanitise(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.sanitise_label("text").alias("label"))


@query("SELECT doc_id, lower(strip_accents(text)) AS norm_label FROM documents")
def norm_label_ascii(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.lower(X.strip_accents("text")).alias("norm_label"))


@query("WITH l AS (SELECT c_custkey AS k, replace(c_name, '#', '__') AS label FROM customer UNION ALL SELECT -s_suppkey, 'pkg__' || s_name FROM supplier) SELECT k, label, nullif(regexp_extract(label, '^([A-Za-z][A-Za-z0-9]*)__', 1), '') AS namespace FROM l")
def namespace_tag(spark, d):
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.replace("c_name", F.lit("#"), F.lit("__")).alias("label"))
    s = T.read(spark, d, "supplier").select((-F.col("s_suppkey")).alias("k"), F.concat(F.lit("pkg__"), "s_name").alias("label"))
    return resolve.tag_namespaces(c.unionAll(s))


@query("SELECT page_id, lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1), '')) AS host FROM pages")
def url_host(spark, d):
    return T.read(spark, d, "pages").select("page_id", X.url_host("url").alias("host"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, d):
    return T.read(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT doc_id, CAST(floor((least(length(text), 20000) + 80) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.token_estimate(F.length("text")).alias("tokens"))


@query("SELECT event_id, least(greatest(coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS INTEGER), 20), 10), 60) AS k FROM events")
def clamped_int(spark, d):
    return T.read(spark, d, "events").select("event_id", X.clamp_int(F.regexp_extract("props", "([0-9]+)", 1), 20, 10, 60).alias("k"))


@query("SELECT p_partkey, lower(split_part(p, '-', 1)) || coalesce(array_to_string(list_transform(list_slice(string_split(p, '-'), 2, 99), lambda w: upper(w[1:1]) || lower(w[2:])), ''), '') AS camel FROM (SELECT p_partkey, lower(replace(replace(p_type, ' ', '-'), '#', '')) AS p FROM part)")
def kebab_to_camel(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", F.lower(F.replace(F.replace("p_type", F.lit(" "), F.lit("-")), F.lit("#"), F.lit(""))).alias("p"))
    return p.select("p_partkey", X.kebab_to_camel("p").alias("camel"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, substring(sha256(text), 1, 8) AS short FROM documents")
def content_hashes(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2("text", 256).alias("sha256"), F.substring(F.sha2("text", 256), 1, 8).alias("short"))


@query("WITH r AS (SELECT doc_id, length(text) AS cost, sum(length(text)) OVER (ORDER BY lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM documents) SELECT doc_id, CAST(cost AS BIGINT) AS cost FROM r WHERE coalesce(ahead, 0) < 400000")
def budget_prefix(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    return traverse.within_budget(docs, F.col("n"), ["lang", "doc_id"], 400_000).select("doc_id", "cost")


@query(
    "SELECT skip_reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN source IN ('src1', 'src2') THEN '.sfgraphignore' WHEN lang = 'de' AND doc_id % 10 <> 7 THEN '.gitignore' WHEN source = 'src3' OR (doc_id % 100 BETWEEN 10 AND 19 AND doc_id >= 10) THEN '.forceignore' END AS skip_reason FROM documents) WHERE skip_reason IS NOT NULL GROUP BY 1"
)
def skip_counts(spark, d):
    """Documents as paths ``source/lang/doc_id.md``, skipped by the rules of three ignore files."""
    listed = T.read(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("rel"))
    sources = [(".sfgraphignore", files.ignore_rules("# own\nsrc1/\n/src2/**\n")), (".gitignore", files.ignore_rules("**/de/*.md\n!*7.md\n")), (".forceignore", files.ignore_rules("src3\n*1[0-9].md\n"))]
    return files.skip_counts(listed.withColumn("skip_reason", files.skip_reason("rel", sources)))


@query(
    r"WITH a AS (SELECT 'doc_' || doc_id AS path, md5(text) AS hash FROM documents UNION ALL SELECT 'page_' || page_id, md5(html) FROM pages), b AS (SELECT 'doc_' || doc_id AS path, md5(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS hash FROM documents UNION ALL SELECT 'item_' || item_id, md5(text) FROM benchmark) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.path = b.path"
)
def manifest_diff(spark, d):
    """From documents and pages to documents with single spaces and benchmark items."""
    docs, pages, items = (T.read(spark, d, n) for n in ("documents", "pages", "benchmark"))

    def listed(df, prefix, key, text, mtime):
        return df.select(F.concat(F.lit(prefix), F.col(key)).alias("path"), F.lit(mtime).alias("mtime"), F.md5(text.cast("binary")).alias("hash"))

    old = listed(docs, "doc_", "doc_id", F.col("text"), 1.0).unionAll(listed(pages, "page_", "page_id", F.col("html"), 1.0))
    new = listed(docs, "doc_", "doc_id", F.regexp_replace("text", "[ \\t\\n\\r]+", " "), 2.0).unionAll(listed(items, "item_", "item_id", F.col("text"), 2.0))
    return files.compare(old, new)


LINES = r"SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM documents)"


@query(f"SELECT doc_id, CAST(line AS INTEGER) AS line, text FROM ({LINES}) WHERE regexp_matches(text, '^[A-Z][a-z]+ [A-Za-z]+\\.?$')")
def line_numbers(spark, d):
    return markdown.lines(T.read(spark, d, "documents")).where(F.col("text").rlike("^[A-Z][a-z]+ [A-Za-z]+\\.?$"))


HEAD = r"SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split(CASE WHEN lang = 'en' THEN '# ' ELSE '### ' END || text, chr(10)) AS ls FROM documents)"


@query(f"SELECT doc_id, line, CAST(length(regexp_extract(t, '^(#+)', 1)) AS INTEGER) AS level, trim(regexp_extract(t, '^#{{1,3}}[ \\t]+(.+)$', 1), ' ') AS heading FROM ({HEAD}) WHERE regexp_matches(t, '^#{{1,3}}[ \\t]+[^ \\t]')")
def headings(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("lang") == "en", "# ").otherwise("### "), "text").alias("text"))
    return markdown.headings(docs)


WORDS = r"WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_\x{80}-\x{10FFFF}])([A-Z][a-z]+[A-Za-z0-9_]*)', 1))) AS name FROM documents)"


@query(f"{WORDS} SELECT doc_id, name FROM w WHERE length(name) >= 3 AND name NOT IN ('The', 'That', 'This', 'And', 'For', 'With', 'From', 'Are', 'Was')")
def mention_names(spark, d):
    return markdown.names(T.read(spark, d, "documents")).select("doc_id", "name")


DENIED = ", ".join(f"'{w}'" for w in (*markdown.DENY, *markdown.MORE_DENY))


@query(
    rf"WITH t AS (SELECT doc_id, regexp_extract(text, '^[A-Za-z0-9_]+', 0) AS head, text FROM documents), w AS (SELECT doc_id, 0.6 AS score, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_\x{{80}}-\x{{10FFFF}}])([A-Z][a-z]+[A-Za-z0-9_]*)', 1)) AS name FROM t UNION ALL SELECT doc_id, 0.75, regexp_extract(head, '^[A-Z][a-z]+[A-Za-z0-9_]*', 0) FROM t UNION ALL SELECT doc_id, 0.6, 'Thing__c' FROM t) SELECT doc_id, name, CAST(max(score) AS DOUBLE) AS score FROM w WHERE length(name) >= 3 AND name NOT IN ({DENIED}) GROUP BY ALL"
)
def mention_extract(spark, d):
    """What documents mention, their first word in code and a custom name before the rest."""
    docs = T.read(spark, d, "documents").where("text is not null")
    head = F.regexp_extract("text", "^[A-Za-z0-9_]+", 0)
    return markdown.mentions(docs.select("doc_id", F.concat(F.when(head != "", F.concat(F.lit("`"), head, F.lit("` "))).otherwise(""), F.lit("Thing__c "), "text").alias("text")))


FIND = r"regexp_extract_all({0}, '(?:^|[^A-Za-z0-9_\x{{80}}-\x{{10FFFF}}])([A-Z][a-z]+[A-Za-z0-9_]*)', 1)"
KNOWN = f"SELECT DISTINCT 'item_' || name AS id, name, false AS is_doc FROM (SELECT unnest({FIND.format('text')}) AS name FROM benchmark) UNION ALL SELECT DISTINCT 'page_' || name, name, false FROM (SELECT unnest({FIND.format('html')}) AS name FROM pages) UNION ALL SELECT DISTINCT 'talk_' || name, name, true FROM (SELECT unnest({FIND.format('text')}) AS name FROM conversations)"
LABELS = f"l AS (SELECT * FROM ({KNOWN}) WHERE name NOT IN ({', '.join(chr(39) + w + chr(39) for w in markdown.DENY)}))"
MENTIONS = f"{WORDS}, {LABELS}, h AS (SELECT 'doc:' || doc_id AS source, id AS target, is_doc, w.name, max(CASE WHEN is_doc THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, w.name) AS solid FROM w JOIN l ON l.name = w.name), k AS (SELECT source, target, name, count(*) OVER (PARTITION BY source, name) AS n FROM h WHERE solid = 0 OR NOT is_doc)"


def _mentions(spark, d):
    """Names in documents that are known from benchmark items, pages and, as documents, conversations."""

    def known(table, text, prefix, file_type):
        found = markdown.names(T.read(spark, d, table).select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), least=2).select("name").distinct()
        return found.select(F.concat(F.lit(prefix), "name").alias("id"), F.col("name").alias("label"), F.lit(file_type).alias("file_type"))

    nodes = known("benchmark", "text", "item_", "object").unionAll(known("pages", "html", "page_", "object")).unionAll(known("conversations", "text", "talk_", "document"))
    found = markdown.names(T.read(spark, d, "documents"), least=2).select(F.concat(F.lit("doc:"), "doc_id").alias("doc_id"), "name", F.lit(0.6).alias("score"))
    return resolve.resolve_mentions(found, nodes)


@query(f"{MENTIONS} SELECT source, target, name, CASE WHEN n > 1 THEN 0.4 ELSE 0.6 END::DOUBLE AS confidence_score FROM k")
def mention_resolve(spark, d):
    return _mentions(spark, d).select("source", "target", "name", "confidence_score")


@query(f"{MENTIONS} SELECT name, CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT source) AS BIGINT) AS docs FROM k WHERE n > 1 GROUP BY 1")
def mention_ambiguous(spark, d):
    return _mentions(spark, d).where("candidates > 1").groupBy("name").agg(F.count("*").alias("edges"), F.countDistinct("source").alias("docs"))


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=[\"'']([^\"''#]+)', 1)) AS target FROM pages")
def page_links(spark, d):
    return web.links(T.read(spark, d, "pages"))


@query("SELECT page_id, tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9:-]*)', 1))) AS tag FROM pages) GROUP BY ALL")
def html_child_tags(spark, d):
    return web.tags(T.read(spark, d, "pages"))


PAGED = "(SELECT page_id, html || ' <script>Page' || page_id || '.load(); Shop.open(1)</script>' AS html FROM pages)"


@query(f"SELECT DISTINCT page_id, receiver, method FROM (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\\.([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS receiver, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\\.([A-Za-z_][A-Za-z0-9_]*)\\(', 2)) AS method FROM {PAGED})")
def call_sites(spark, d):
    """Pages with a script that calls."""
    pages = T.read(spark, d, "pages")
    return web.calls(pages.select("page_id", F.concat("html", F.lit(" <script>Page"), "page_id", F.lit(".load(); Shop.open(1)</script>")).alias("html")))


@query("SELECT window_start AS started, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS value FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, value FROM events) GROUP BY ALL")
def tumbling_windows(spark, d):
    e = T.read(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("started"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, GROUPING(event_type) AS g FROM events GROUP BY ROLLUP(event_type)")
def coverage_rollup(spark, d):
    return T.read(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.grouping("event_type").cast("bigint").alias("g"))


@query(
    "WITH RECURSIVE f AS (SELECT source AS folder, source || '/' || doc_id AS path, CAST(floor((least(length(text), 20000) + 80) / 4) AS BIGINT) AS tokens FROM documents), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) AS rn FROM f), r AS (SELECT folder, path, tokens, rn, 0 AS chunk, tokens AS load FROM o WHERE rn = 1 UNION ALL SELECT o.folder, o.path, o.tokens, o.rn, CASE WHEN r.load > 0 AND r.load + o.tokens > 40000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.load > 0 AND r.load + o.tokens > 40000 THEN o.tokens ELSE r.load + o.tokens END FROM r JOIN o ON o.folder = r.folder AND o.rn = r.rn + 1) SELECT path, folder, CAST(chunk AS INTEGER) AS chunk, tokens FROM r"
)
def chunk_pack(spark, d):
    from weftgraph.sources.llm_chunks import pack

    docs = T.read(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.length("text").alias("n"))
    return pack(docs.select("path", X.token_estimate("n").alias("tokens")), 40_000)
