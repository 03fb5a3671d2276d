"""Scalar functions of the engine as Catalyst expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Namespace prefix of a label: what stands before a double underscore that another one follows.
CUSTOM_SUFFIXES = ("c", "e", "x", "mdt", "r", "b", "share", "history", "feed", "kav")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def make_id(*parts: Column | str) -> Column:
    """Natural key: trimmed parts joined by ``_``, other characters folded into ``_``, lower case. Null and empty parts are left out."""
    trimmed = F.array(*[F.btrim(_c(p).cast("string"), F.lit("_. ")) for p in parts])
    joined = F.array_join(F.filter(trimmed, lambda p: p.isNotNull() & (p != "")), "_")
    return F.lower(F.btrim(F.regexp_replace(joined, "[^a-zA-Z0-9_]+", "_"), F.lit("_")))


def normalise_id(x: Column | str) -> Column:
    """Key for matching ids that differ in case and separators only."""
    return F.lower(F.btrim(F.regexp_replace(_c(x), "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def norm_label(x: Column | str) -> Column:
    """Lower case; only ``a-z``, digits and spaces; trimmed."""
    return F.btrim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9 ]", ""), F.lit(" "))


def sanitise_label(x: Column | str) -> Column:
    """Without control characters, 256 characters at most."""
    return F.substring(F.regexp_replace(_c(x), "[\\x00-\\x1f\\x7f]", ""), 1, 256)


@pandas_udf(StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return x.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def strip_accents(x: Column | str) -> Column:
    """Letters of any script without their diacritics. Texts in ASCII are left as they are; only the others go through Arrow."""
    c = _c(x)
    return F.when(c.rlike("[^\\x00-\\x7f]"), _decomposed(F.when(c.rlike("[^\\x00-\\x7f]"), c))).otherwise(c)


def title_words(x: Column | str) -> Column:
    """Title case in which every run of letters starts anew, after digits too."""
    parts = F.regexp_extract_all(F.lower(_c(x)), F.lit("([a-z]+|[^a-z]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def namespace(x: Column | str, compatible: bool = False) -> Column:
    """Package prefix of a label, or null. ``compatible`` also takes the name of a plain custom object for one."""
    found = F.nullif(F.regexp_extract(_c(x), "^([A-Za-z][A-Za-z0-9]*)__", 1), F.lit(""))
    if compatible:
        return found
    rest = F.lower(F.regexp_extract(_c(x), "^[A-Za-z][A-Za-z0-9]*__(.*)$", 1))
    return F.when(~rest.isin(*CUSTOM_SUFFIXES), found)


def url_host(x: Column | str) -> Column:
    return F.lower(F.try_parse_url(_c(x), F.lit("HOST")))


def clamp_int(x: Column | str, default: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(_c(x).try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def token_estimate(length: Column | str) -> Column:
    """Tokens of a prompt that quotes a file: 20,000 characters of it at most and a header, four a token."""
    return F.floor((F.least(_c(length), F.lit(20_000)) + 80) / 4).cast("long")


def kebab_to_camel(x: Column | str) -> Column:
    parts = F.split(_c(x), "-")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.initcap(p))
    return F.concat(parts[0], F.array_join(tail, ""))


def stem(path: Column | str) -> Column:
    """File name up to its first dot."""
    return F.element_at(F.split(F.element_at(F.split(_c(path), "/"), -1), "\\."), 1)


def before_last_dot(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "\\.[^.]*$", "")


def folder(path: Column | str, up: int = 1) -> Column:
    """Name of the folder ``up`` levels above the file."""
    return F.try_element_at(F.split(_c(path), "/"), F.lit(-1 - up))


def cypher_string(x: Column | str) -> Column:
    return F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def cypher_name(x: Column | str, fallback: str) -> Column:
    clean = F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^A-Za-z0-9_]", "")
    return F.when(clean.rlike("^[A-Za-z_]"), clean).otherwise(F.lit(fallback))


def slug(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def file_name(x: Column | str) -> Column:
    """A label as a file name."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(_c(x), '[\\\\/:*?"<>|#^\\[\\]\\n\\r]', "_"), F.lit(" .")), F.lit("")), F.lit("unnamed"))


def mermaid_label(x: Column | str, most: int = 40) -> Column:
    clean = F.regexp_replace(_c(x), '["\\[\\]{}()|<>]', "'")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 1), F.lit("…"))).otherwise(clean)


def category(file_type: Column | str) -> Column:
    """The broad kind of a node's file type."""
    kinds = {"apex": "code", "trigger": "code", "lwc": "ui", "aura": "ui", "visualforce": "ui", "layout": "ui", "flow": "automation", "workflow": "automation", "automation": "automation", "object": "data", "field": "data", "profile": "security", "permset": "security", "sharing": "security", "rules": "security", "config": "config", "document": "docs", "paper": "docs", "image": "docs", "concept": "docs", "reporting": "reporting", "agentforce": "agents", "packaging": "config"}
    pairs = [F.lit(x) for kv in kinds.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(file_type)), F.lit("other"))


def score_of(confidence: Column | str, score: Column | str) -> Column:
    """A given score, else that of the confidence class."""
    c = _c(confidence)
    return F.coalesce(_c(score), F.when(c == "INFERRED", 0.5).when(c == "AMBIGUOUS", 0.2).otherwise(1.0))
