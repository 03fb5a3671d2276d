"""Fragments from language models: prompts packed by tokens, sent in parallel tasks, retried and bisected, merged.

A backend is any function ``(prompt) -> Reply``; those here speak HTTP with the standard library. What fails costs its
chunk and no more: a failed chunk is reported in the results and gives no fragments.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract.fragments import Fragments
from weftgraph.functions.text import token_estimate
from weftgraph.session import cut, ship
from weftgraph.sources.llm_chunks import pack

#: Characters of a file that a prompt quotes.
FILE_CHARS = 20_000
MAX_REPLY = 10 << 20
PROMPT = """Read the files below. Answer with one JSON object {"nodes": [{"id", "label", "file_type"}], "edges": [{"source", "target", "relation", "confidence", "confidence_score"}]} of meaningful entities and relations across them that their syntax doesn't state. confidence is EXTRACTED, INFERRED or AMBIGUOUS.
"""


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    truncated: bool = False


@dataclass(frozen=True)
class Backend:
    """Where a model is and what it costs (dollars a million tokens, in and out)."""

    url: str
    model: str
    keys: tuple[str, ...]
    price: tuple[float, float]
    style: str = "chat"
    max_tokens: int = 8192


BACKENDS = {
    "gemini": Backend("https://generativelanguage.googleapis.com/v1beta/openai/chat/completions", "gemini-2.5-flash-lite", ("GEMINI_API_KEY", "GOOGLE_API_KEY"), (0.10, 0.40)),
    "kimi": Backend("https://api.moonshot.ai/v1/chat/completions", "kimi-k2", ("MOONSHOT_API_KEY",), (0.74, 4.66)),
    "claude": Backend("https://api.anthropic.com/v1/messages", "claude-sonnet-4-5", ("ANTHROPIC_API_KEY",), (3.0, 15.0), "messages"),
    "openai": Backend("https://api.openai.com/v1/chat/completions", "gpt-4.1-mini", ("OPENAI_API_KEY",), (0.40, 1.60)),
    "bedrock": Backend("https://bedrock-runtime.us-east-1.amazonaws.com/openai/v1/chat/completions", "openai.gpt-oss-120b-1:0", ("AWS_BEARER_TOKEN_BEDROCK",), (0.15, 0.60)),
    "ollama": Backend("http://localhost:11434/v1/chat/completions", "qwen2.5-coder", ("OLLAMA_BASE_URL",), (0.0, 0.0)),
}


def detect_backend(env: dict[str, str] | None = None) -> str | None:
    """The first backend with a key in the environment."""
    env = os.environ if env is None else env
    return next((n for n, b in BACKENDS.items() if any(env.get(k) for k in b.keys)), None)


def cost(name: str, tokens_in: int, tokens_out: int) -> float:
    a, b = BACKENDS[name].price
    return (tokens_in * a + tokens_out * b) / 1e6


class RateLimited(Exception):
    """Too many requests; ``wait`` seconds if the answer says so."""

    def __init__(self, wait: float | None = None) -> None:
        super().__init__("rate limited")
        self.wait = wait


class TooLong(Exception):
    """The prompt exceeds the model's context."""


def retry_after(text: str) -> float | None:
    """Seconds to wait that an error's text names."""
    for pattern in (r"retry[- ]?after[\"':= ]+([\d.]+)", r"retry[- ]?delay[\"':= ]+([\d.]+)", r"(?:try again|retry|wait)\D{0,20}([\d.]+)\s*s"):
        if m := re.search(pattern, text, re.I):
            return float(m[1].rstrip("."))
    return None


def caller(name: str, model: str | None = None, key: str | None = None) -> Callable[[str], Reply]:
    """A function that sends a prompt to a backend."""
    b = BACKENDS[name]
    key = key or next((os.environ[k] for k in b.keys if os.environ.get(k)), "")
    url = f"{key.rstrip('/')}/v1/chat/completions" if name == "ollama" and key else b.url
    model = model or os.environ.get("WEFTGRAPH_MODEL") or b.model

    def call(prompt: str) -> Reply:
        body = {"model": model, "max_tokens": b.max_tokens, "messages": [{"role": "user", "content": prompt}]}
        headers = {"content-type": "application/json"} | ({"x-api-key": key, "anthropic-version": "2023-06-01"} if b.style == "messages" else {"authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=600) as r:
                got = json.loads(r.read(MAX_REPLY))
        except urllib.error.HTTPError as e:
            text = e.read(65536).decode(errors="replace")
            if e.code == 429:
                raise RateLimited(retry_after(f"retry-after: {e.headers.get('retry-after')}") or retry_after(text)) from e
            if e.code in (400, 413) and re.search(r"context|too long|maximum.{0,20}tokens", text, re.I):
                raise TooLong from e
            raise
        use = got.get("usage", {})
        if b.style == "messages":
            return Reply("".join(x.get("text", "") for x in got["content"]), use.get("input_tokens", 0), use.get("output_tokens", 0), got.get("stop_reason") == "max_tokens")
        choice = got["choices"][0]
        return Reply(choice["message"]["content"] or "", use.get("prompt_tokens", 0), use.get("completion_tokens", 0), choice.get("finish_reason") == "length")

    return call


def parse(text: str) -> dict | None:
    """The object in a reply, fenced or not; none where there is none or it is too large."""
    if len(text) > MAX_REPLY:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for body in (fenced[1] if fenced else text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            got = json.loads(body)
        except ValueError:
            continue
        if isinstance(got, dict):
            return {k: [x for x in got.get(k) or [] if isinstance(x, dict)] for k in ("nodes", "edges")}
    return None


def prompt_of(files: list[tuple[str, str]]) -> str:
    return PROMPT + "".join(f"\n=== {p}\n{t[:FILE_CHARS]}\n" for p, t in files)


def ask(files: list[tuple[str, str]], call: Callable[[str], Reply], depth: int = 3, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> list[tuple[dict, Reply]]:
    """Replies for a chunk: waits when rate limited, halves what is too long or cut off, ``depth`` times at most."""
    reply = None
    for k in range(tries):
        try:
            reply = call(prompt_of(files))
            break
        except RateLimited as e:
            if k == tries - 1:
                raise
            sleep(min(120.0, e.wait if e.wait is not None else 10.0 * 2**k))
        except TooLong:
            if len(files) < 2 or not depth:
                raise
            break
    if (reply is None or reply.truncated) and len(files) > 1 and depth:
        mid = len(files) // 2
        return ask(files[:mid], call, depth - 1, tries, sleep) + ask(files[mid:], call, depth - 1, tries, sleep)
    got = parse(reply.text)
    return [(got, reply)] if got is not None else []


RESULT = "source_file string, nodes array<struct<id:string,label:string,sf_type:string,file_type:string>>, edges array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double>>, input_tokens long, output_tokens long, error string"


def replies(files: DataFrame, call: Callable[[str], Reply], budget: int = 40_000, parallel: int = 4) -> DataFrame:
    """A row a chunk of ``files(path, text)``: its fragments, tokens, and error if it failed."""
    spark = ship(files.sparkSession)
    chunks = pack(files.select("path", token_estimate(F.octet_length("text").cast("long")).alias("tokens")), budget)
    texts = files.select("path", F.substring("text", 1, FILE_CHARS).alias("text"))
    whole = chunks.join(texts, "path").groupBy("folder", "chunk").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("files")).repartition(parallel)

    def text(x, key: str) -> str | None:
        return None if x.get(key) is None else str(x[key])

    def run(batches):
        for pdf in batches:
            out = []
            for own in pdf["files"]:
                pairs = [(f["path"], f["text"] or "") for f in own]
                nodes, edges, used, error = [], [], [0, 0], None
                try:
                    for got, reply in ask(pairs, call):
                        nodes += [{k: text(n, k) for k in ("id", "label", "sf_type", "file_type")} for n in got["nodes"]]
                        edges += [{k: text(e, k) for k in ("source", "target", "relation", "confidence")} | {"confidence_score": float(e["confidence_score"]) if isinstance(e.get("confidence_score"), int | float) else None} for e in got["edges"]]
                        used = [used[0] + reply.input_tokens, used[1] + reply.output_tokens]
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append({"source_file": pairs[0][0], "nodes": nodes, "edges": edges, "input_tokens": used[0], "output_tokens": used[1], "error": error})
            yield pd.DataFrame(out, columns=["source_file", "nodes", "edges", "input_tokens", "output_tokens", "error"])

    return cut(whole.mapInPandas(run, RESULT)) if spark else whole


def fragments(got: DataFrame) -> Fragments:
    """Nodes and edges of replies; those without what makes them one are left out."""
    nodes = got.select("source_file", F.explode("nodes").alias("n")).select("n.*", "source_file").where("id <> ''").withColumn("label", F.coalesce("label", "id"))
    edges = got.select("source_file", F.posexplode("edges").alias("ord", "e")).select("e.*", "source_file", F.col("ord").cast("long").alias("ord")).where("source <> '' and target <> ''")
    known = F.when(F.upper("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), F.upper("confidence")).otherwise("INFERRED")
    return Fragments.of(got.sparkSession, nodes, edges.withColumn("relation", F.coalesce("relation", F.lit("references"))).withColumn("confidence", known).withColumn("weight", F.lit(1.0)))
