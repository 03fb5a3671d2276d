"""Schemas and vocabularies of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, label string, sf_type string, file_type string, source_file string, line int, stub boolean, attrs map<string,string>"
EDGE = "source string, target string, relation string, confidence string, confidence_score double, weight double, source_file string, line int, operation string, ord long"
RAW_CALL = "caller_id string, callee_class string, callee_method string, source_file string, ord long"
MENTION = "doc_id string, name string, score double, source_file string, line int"

CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
FILE_TYPES = ("apex", "trigger", "flow", "object", "field", "lwc", "aura", "visualforce", "layout", "profile", "permset", "automation", "config", "rules", "sharing", "reporting", "packaging", "agentforce", "document", "paper", "image", "concept")
#: Of two relations between the same pair, a simple graph keeps that of higher priority.
PRIORITY = {"contains": 100, "extends": 95, "implements": 95, "master_detail": 92, "triggers": 90, "calls": 85, "invokes": 80, "dml": 75, "queries": 70, "references": 60, "uses": 50, "grants": 40}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the schema's columns, nulls where it has none."""
    out = []
    for part in _fields(schema):
        name, kind = part
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def _fields(schema: str) -> list[tuple[str, str]]:
    out, depth, cur = [], 0, ""
    for ch in schema + ",":
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and not depth:
            name, kind = cur.strip().split(" ", 1)
            out.append((name, kind))
            cur = ""
        else:
            cur += ch
    return out


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
