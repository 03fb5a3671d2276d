"""Classes and triggers: a scanner of source text, batched through Arrow.

Comments and strings are blanked first, position by position, so that braces, verbs and calls are code. A class gives its
methods by brace-matched spans; what happens in a span belongs to its innermost method.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract.fragments import Fragments
from weftgraph.session import cut, ship

BLANKED = re.compile(r"""/\*.*?(?:\*/|\Z)|//[^\n]*|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)""", re.S)
WORD = r"[A-Za-z_]\w*"
HEADER = re.compile(rf"\b(?P<what>class|interface|enum)\s+(?P<name>{WORD})(?:\s+extends\s+(?P<base>[\w.]+))?(?:\s+implements\s+(?P<faces>[^{{]+?))?\s*(?=\{{|$)", re.I | re.M)
ACCESS = re.compile(r"\b(?:public|private|global|protected)\b[^;{}()]*$", re.I)
MODIFIER = r"public|private|protected|global|webservice|override|virtual|abstract|static|testmethod"
METHOD = re.compile(rf"(?:\b(?:{MODIFIER})\s+)+(?:[\w<>\[\],.]+\s+)+(?P<name>{WORD})\s*\((?P<args>[^)]*)\)\s*\{{", re.I)
QUERY = re.compile(r"\[\s*select\b[^\]]*?\bfrom\s+(\w+)", re.I)
CHANGE = re.compile(r"(?<![\w.])(insert|update|delete|upsert|merge|undelete)\s+(\w+)\s*;", re.I)
CALL = re.compile(rf"({WORD})\s*\.\s*({WORD})\s*\(")
TRIGGER = re.compile(r"\btrigger\s+(\w+)\s+on\s+(\w+)\s*\(\s*([^)]*?)\s*\)", re.I)
INTERVIEW = re.compile(r"\bflow\s*\.\s*interview\s*\.\s*(\w+)", re.I)
ENDPOINT = re.compile(r"""setendpoint\s*\(\s*(['"])(.+?)\1""", re.I)
PUBLISH = re.compile(r"\beventbus\s*\.\s*publish\s*\(\s*new\s+(\w+?__e)\b", re.I)
SETTING = re.compile(r"\b(\w+?__(mdt|c))\s*\.\s*(getinstance|getorgdefaults)\s*\(", re.I)
DECLARED = re.compile(r"\b(?:(?:list|set|map)\s*<(?P<inner>[^;()]+?)>|(?P<type>[A-Z]\w*))\s+(?P<name>[a-z]\w*)\s*(?=[=;,):])", re.I)
NOT_CLASSES = frozenset(
    "abstract and anytype apexpages assert blob boolean break case catch class collection const continue crypto currency database date datetime decimal default delete do double else encodingutil enum "
    "exception extends false final finally for from global http httprequest httpresponse id if implements in insert instanceof integer interface iterable iterator json limits list long map math merge "
    "messaging new not null object or override package pattern private protected public query restcontext restrequest restresponse return schema select set static string super switch system test this "
    "throw time transient trigger true try type undelete update upsert url userinfo virtual void when where while with".split()
)
OPERATION = {"insert": "create"}


def blank(text: str) -> str:
    """The same length and lines, without what stands in comments and strings."""
    return BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def close(text: str, at: int) -> int:
    """Position behind the brace that closes the one at ``at``, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def top_level(parts: str) -> list[str]:
    """Names between commas outside angle brackets, without their arguments."""
    flat = parts
    while (less := re.sub(r"<[^<>]*>", "", flat)) != flat:
        flat = less
    return [p.strip() for p in flat.split(",") if p.strip()]


def declared(text: str) -> dict[str, str]:
    """Variables' types; those of collections first, then the first declaration."""
    hits = [(m["inner"] is None, k, m) for k, m in enumerate(DECLARED.finditer(text))]
    out: dict[str, str] = {}
    for simple, _, m in sorted(hits, key=lambda h: h[:2]):
        kind = m["type"] if simple else (top_level(m["inner"]) or [""])[-1]
        if kind[:1].isupper() and kind.lower() not in NOT_CLASSES and m["name"][:1].islower():
            out.setdefault(m["name"], kind)
    return out


def is_class(name: str) -> bool:
    return len(name) > 1 and name[0].isupper() and name.lower() not in NOT_CLASSES and not (len(name) <= 10 and re.fullmatch(r"[A-Z][A-Z0-9_]+", name))


def ident(*parts: str) -> str:
    kept = [p.strip("_. ") for p in parts if p and p.strip("_. ")]
    return re.sub(r"[^a-zA-Z0-9_]+", "_", "_".join(kept)).strip("_").lower()


class Out:
    """Rows of one file."""

    def __init__(self, path: str) -> None:
        self.path, self.rows, self.seen = path, [], set()

    def add(self, what: str, **row) -> None:
        self.rows.append({"what": what, "source_file": self.path, "ord": len(self.rows), **row})

    def node(self, id_: str, label: str, sf_type: str, line: int | None = None, **attrs: str) -> None:
        self.add("node", id=id_, label=label, sf_type=sf_type, line=line, attrs=json.dumps(attrs) if attrs else None)

    def edge(self, source: str, target: str, relation: str, confidence: str = "EXTRACTED", score: float | None = None, operation: str | None = None) -> None:
        if (key := (source, target, relation, operation)) not in self.seen:
            self.seen.add(key)
            self.add("edge", source=source, target=target, relation=relation, confidence=confidence, score=score, operation=operation)


def scan_class(path: str, text: str) -> list[dict]:
    out, code = Out(path), blank(text)
    head = next((m for m in HEADER.finditer(code) if ACCESS.search(code[max(0, m.start() - 200) : m.start()])), None)
    if not head:
        return []
    name, me = head["name"], ident("apex", head["name"])
    out.node(me, name, {"interface": "ApexInterface", "enum": "ApexEnum"}.get(head["what"].lower(), "ApexClass"))
    for relation, names in (("extends", [head["base"] or ""]), ("implements", top_level(head["faces"] or ""))):
        for n in names:
            if n and n.lower() not in NOT_CLASSES:
                out.edge(me, ident("apex", n), relation, "INFERRED", 0.9)
    lines = [m.start() for m in re.finditer("\n", code)]
    spans: list[tuple[int, int, dict[str, str]]] = []
    for m in METHOD.finditer(code):
        if m["name"].lower() in NOT_CLASSES:
            continue
        start, end = m.end() - 1, close(code, m.end() - 1)
        it = ident("method", name, m["name"])
        out.node(it, f"{name}.{m['name']}()", "ApexMethod", bisect_right(lines, m.start()) + 1)
        out.edge(me, it, "contains")
        spans.append((m.start(), end, declared(code[m.start() : end])))
        for c in CALL.finditer(code, start, end):
            if is_class(c[1]):
                out.add("call", caller_id=it, callee_class=c[1], callee_method=c[2])
    for m in QUERY.finditer(code):
        if m[1].lower() not in NOT_CLASSES:
            out.edge(me, ident("object", m[1]), "queries")
    overall = declared(code)
    for m in CHANGE.finditer(code):
        around = [s for s in spans if s[0] <= m.start() < s[1]]
        types = min(around, key=lambda s: s[1] - s[0])[2] if around else overall
        kind = types.get(m[2]) or (m[2] if m[2][0].isupper() else "")
        if kind and m[2].lower() not in NOT_CLASSES and kind.lower() not in NOT_CLASSES:
            verb = m[1].lower()
            out.edge(me, ident("object", kind), "dml", "INFERRED", 0.7, OPERATION.get(verb, verb))
    for m in INTERVIEW.finditer(code):
        out.edge(me, ident("flow", m[1]), "invokes")
    # endpoints stand in strings: the text as it was, where the call itself is code
    for m in ENDPOINT.finditer(text):
        if code[m.start() : m.start() + 11].strip():
            callout(out, me, m[2].strip())
    for m in PUBLISH.finditer(code):
        out.edge(me, ident("object", m[1]), "publishes")
    for m in SETTING.finditer(code):
        if m[2].lower() == "mdt" and m[3].lower() == "getinstance":
            out.edge(me, ident("custommetadata", m[1]), "reads_config", "INFERRED")
        elif m[2].lower() == "c":
            out.edge(me, ident("object", m[1]), "reads_config", "INFERRED")
    return out.rows


def callout(out: Out, me: str, url: str) -> None:
    if named := re.match(r"callout:([^/]+)", url, re.I):
        out.edge(me, ident("namedcredential", named[1]), "makes_callout")
    elif web := re.match(r"https?://(?:[^/@]*@)?([^/:?#]*)", url):
        host = web[1].lower() or url
        to = ident("externalendpoint", host)
        if (me, to, "makes_callout", None) not in out.seen:
            out.node(to, host, "ExternalEndpoint", None, confidence="INFERRED")
        out.edge(me, to, "makes_callout", "INFERRED")


def scan_trigger(path: str, text: str) -> list[dict]:
    out, code = Out(path), blank(text)
    m = TRIGGER.search(code)
    name = m[1] if m else path.rsplit("/", 1)[-1].removesuffix(".trigger")
    me = ident("trigger", name)
    if not m:
        out.node(me, name, "ApexTrigger")
        return out.rows
    out.node(me, name, "ApexTrigger", code.count("\n", 0, m.start()) + 1, trigger_events=m[3])
    out.edge(me, ident("object", m[2]), "triggers")
    if m[2].lower().endswith("__e"):
        out.edge(me, ident("object", m[2]), "subscribes")
    for c in CALL.finditer(code, m.end()):
        if is_class(c[1]):
            out.add("call", caller_id=me, callee_class=c[1], callee_method=c[2])
    return out.rows


FIELDS = {"what": pa.string(), "source_file": pa.string(), "ord": pa.int64(), "id": pa.string(), "label": pa.string(), "sf_type": pa.string(), "line": pa.int32(), "attrs": pa.string(), "source": pa.string(), "target": pa.string(), "relation": pa.string(), "confidence": pa.string(), "score": pa.float64(), "operation": pa.string(), "caller_id": pa.string(), "callee_class": pa.string(), "callee_method": pa.string()}
ROW = "what string, source_file string, ord long, id string, label string, sf_type string, line int, attrs string, source string, target string, relation string, confidence string, score double, operation string, caller_id string, callee_class string, callee_method string"


def extract(files: DataFrame) -> Fragments:
    """Fragments of ``files(path, kind, text)`` of classes and triggers."""
    ship(files.sparkSession)

    schema = pa.schema(FIELDS)

    def run(batches):
        for batch in batches:
            rows = [r for p, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in (scan_class if k == "apex_class" else scan_trigger)(p, t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema)

    # scanned once: nodes, edges and calls read what was written
    rows = cut(files.select("path", "kind", "text").mapInArrow(run, ROW))
    nodes = rows.where("what = 'node'").withColumn("file_type", F.lit("apex")).withColumn("attrs", F.from_json("attrs", "map<string,string>"))
    edges = rows.where("what = 'edge'").withColumn("confidence_score", F.col("score")).withColumn("weight", F.lit(1.0)).withColumn("line", F.lit(None).cast("int"))
    return Fragments.of(files.sparkSession, nodes, edges, rows.where("what = 'call'"))
