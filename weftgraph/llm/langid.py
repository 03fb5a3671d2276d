"""Language of every word of code-switched text by a linear-chain conditional random field.

A word's features are its affixes (prefixes of 1 to 3 and suffixes of 1 to 4 letters), the letter bi- and trigrams of
the word with its ends marked, and the languages in whose lexicon it is (words that the training texts hold often).
Weights by (feature, language) and learned language transitions are fitted together on the conditional likelihood, its
gradient by forward-backward. Training sequences are spans of labelled documents joined to switch language; at
most ``TRAIN_DOCS`` documents of a language are used. Labelling takes the language of highest posterior
marginal of each word, again by forward-backward over the whole document.

A word is a run of non-white-space characters without outer punctuation, lower-cased; runs without letters or digits
aren't words. Defined cases: a text that is null, empty or without words has language null and no segments; without
labelled documents every word is ``und``; rows whose lang is null or empty are labelled but not trained on; repeated
rows are labelled each; a null doc_id is labelled and kept as null; a very long text is one sequence, whole; of languages of
as many words (or of equal posterior) the first by name is taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, list_array, normal_words

TRAIN_DOCS = 150
SEQUENCES = 3000
LEXICON = 300
STEPS = 40
#: Words whose scores a worker remembers.
MEMORY = 300_000


def word_features(word: str) -> list[str]:
    w = f"^{word}$"
    out = ["p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], "s" + word[-4:]]
    out += [w[i : i + 2] for i in range(len(w) - 1)]
    out += [w[i : i + 3] for i in range(len(w) - 2)]
    return out


@dataclass
class Crf:
    langs: list[str]
    index: dict[str, int]
    #: feature x language, without and with a last row of zeros
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, tuple[str, ...]]
    memory: dict[str, int] = field(default_factory=dict)
    known: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"memory": {}, "known": None}

    def features(self, word: str) -> list[int]:
        get = self.index.get
        return [i for f in [*word_features(word), *self.lexicon.get(word, ())] if (i := get(f)) is not None]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores by word and language."""
        if self.known is None:
            self.known = np.zeros((MEMORY, len(self.langs)))
        new = [w for w in words if w not in self.memory]
        if len(new) + len(self.memory) > MEMORY:
            self.memory, new = {}, words
        fresh = self._emit(new)
        if len(new) > MEMORY:
            return fresh
        base = len(self.memory)
        self.known[base : base + len(new)] = fresh
        self.memory.update(zip(new, range(base, base + len(new)), strict=True))
        return self.known[np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))]

    def _emit(self, words: list[str]) -> np.ndarray:
        rows = [self.features(w) for w in words]
        width = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(width.sum()))
        total = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(self.weights[flat], 0)])
        ends = np.cumsum(width)
        return total[ends] - total[ends - width]


def layout(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: word positions time by time, where each time starts, and how many are active then."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    longest = int(length[order[0]]) if len(order) else 0
    active = np.searchsorted(-length[order], -np.arange(longest), "left") if longest else np.zeros(0, np.int64)
    start = np.append(0, np.cumsum(active))
    time = np.repeat(np.arange(longest), active)
    nth = np.arange(start[-1]) - start[time] if longest else np.zeros(0, np.int64)
    return bounds[order][nth] + time if longest else nth, start, active


def forward_backward(psi: np.ndarray, start: np.ndarray, active: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled messages over time-ordered potentials ``psi``: alpha, beta, scales and (alpha before each transition's) product sums by pair."""
    n = len(active)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    scale = np.ones(len(psi))
    for t in range(n):
        i, j = start[t], start[t + 1]
        v = psi[i:j] if t == 0 else (alpha[start[t - 1] : start[t - 1] + active[t]] @ a) * psi[i:j]
        s = v.sum(1)
        scale[i:j] = s
        np.divide(v, s[:, None], out=alpha[i:j])
    pairs = np.zeros_like(a)
    for t in range(n - 1, 0, -1):
        i, j = start[t], start[t + 1]
        k = start[t - 1]
        v = psi[i:j] * beta[i:j] / scale[i:j, None]
        pairs += alpha[k : k + active[t]].T @ v
        beta[k : k + active[t]] = v @ a.T
    return alpha, beta, scale, pairs * a


def fit(texts: list[str], langs: list[str], seed: int = 7, sequences: int = SEQUENCES, steps: int = STEPS) -> Crf:
    """Train on code-switched sequences made from whole labelled texts."""
    names = sorted(set(langs))
    if not names:
        return Crf(["und"], {}, np.zeros((1, 1)), np.zeros((1, 1)), {})
    bounds, codes, words = normal_words(pa.array(texts, pa.string()))
    rng = np.random.default_rng(seed)
    of = [[k for k, x in enumerate(langs) if x == name and bounds[k + 1] > bounds[k]] for name in names]
    usable = [k for k, x in enumerate(of) if x]
    lexicon: dict[str, list[str]] = {}
    for k in usable:
        seen = Counter()
        for d in of[k]:
            seen.update(np.unique(codes[bounds[d] : bounds[d + 1]]).tolist())
        for code, _ in sorted(seen.items(), key=lambda x: (-x[1], words[x[0]]))[:LEXICON]:
            lexicon.setdefault(words[code], []).append(f"lex:{names[k]}")
    seqs, gold = [], []
    for _ in range(sequences if usable else 0):
        seq, lab = [], []
        for _ in range(rng.integers(1, 5)):
            k = usable[rng.integers(len(usable))]
            d = of[k][rng.integers(len(of[k]))]
            n = int(rng.integers(3, 20))
            at = int(rng.integers(bounds[d], max(bounds[d] + 1, bounds[d + 1] - n)))
            part = codes[at : min(at + n, bounds[d + 1])]
            seq.append(part)
            lab.append(np.full(len(part), k))
        seqs.append(np.concatenate(seq))
        gold.append(np.concatenate(lab))
    if not seqs:
        return Crf(names, {}, np.zeros((1, len(names))), np.zeros((len(names), len(names))), {})
    code = np.concatenate(seqs)
    y = np.concatenate(gold)
    used, code = np.unique(code, return_inverse=True)
    model = Crf(names, {}, np.zeros((0, len(names))), np.zeros((len(names), len(names))), {w: tuple(x) for w, x in lexicon.items()})
    rows = [[*word_features(words[u]), *model.lexicon.get(words[u], ())] for u in used]
    often = Counter(f for r in rows for f in r)
    model.index = {f: k for k, f in enumerate(sorted(f for f, c in often.items() if c > 1))}
    feats = [model.features(words[u]) for u in used]
    width = np.fromiter(map(len, feats), np.int64, len(feats))
    flat = np.fromiter((i for r in feats for i in r), np.int64, int(width.sum()))
    owner = np.repeat(np.arange(len(used)), width)
    L, nf = len(names), len(model.index)
    at, start, active = layout(np.append(0, np.cumsum([len(s) for s in seqs])))
    tc, ty = code[at], y[at]
    hot = np.eye(L)[ty]
    inner = np.concatenate([np.arange(start[t - 1], start[t - 1] + active[t]) for t in range(1, len(active))]) if len(active) > 1 else np.zeros(0, np.int64)
    want = np.zeros((L, L))
    np.add.at(want, (ty[inner], ty[start[1] : start[1] + len(inner)]), 1)
    w, tr = np.zeros((nf, L)), np.eye(L)
    moments = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(tr), np.zeros_like(tr))]

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(owner, values[:, k], len(used)) for k in range(L)], 1)

    for step in range(1, steps + 1):
        score = by_word(w[flat])
        psi = np.exp(score - score.max(1, keepdims=True))[tc]
        alpha, beta, _, pairs = forward_backward(psi, start, active, np.exp(tr))
        post = alpha * beta
        post /= post.sum(1, keepdims=True)
        rest = hot - post
        per_word = np.stack([np.bincount(tc, rest[:, k], len(used)) for k in range(L)], 1)
        gw = np.stack([np.bincount(flat, per_word[owner, k], nf) for k in range(L)], 1) - 0.5 * w
        for (m, v), x, g in zip(moments, (w, tr), (gw, want - pairs - 0.5 * tr), strict=True):
            m *= 0.8
            m += 0.2 * g
            v *= 0.95
            v += 0.05 * g * g
            x += 0.15 * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-8)
    model.weights, model.transitions = w, tr
    return model


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Crf:
    """Fit on at most ``per_lang`` documents of each language, the same ones each time."""
    from pyspark.sql import Window

    ranked = docs.where("doc_id is not null and lang is not null and lang <> ''").select("doc_id", "lang").withColumn("_h", F.xxhash64("doc_id")).withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id")))
    picked = ranked.where(F.col("_n") <= per_lang).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).where("text is not null").select("doc_id", "lang", "text").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def label_words(model: Crf, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds by text, each word's language number and its posterior."""
    bounds, codes, words = normal_words(column)
    label, sure = np.zeros(len(codes), np.int64), np.ones(len(codes))
    if not len(codes):
        return bounds, label, sure
    score = model.emissions(words)
    psi = np.exp(np.maximum(score - score.max(1, keepdims=True), -60))
    at, start, active = layout(bounds)
    alpha, beta, *_ = forward_backward(psi[codes[at]], start, active, np.exp(model.transitions))
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    best = post.argmax(1)
    label[at] = best
    sure[at] = post[np.arange(len(post)), best]
    return bounds, label, sure


OUT = "doc_id long, lang string, n_words int, n_switches int, certainty double, segment_starts array<int>, segment_langs array<string>"


def label(docs: DataFrame, model: Crf) -> DataFrame:
    """One row a document: its commonest language, words, switches, mean posterior, and the segments by first word and language."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m: Crf = held.value
        bounds, lab, sure = label_words(m, batch.column("text"))
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        count = np.zeros((len(n), len(m.langs)), np.int64)
        np.add.at(count, (doc, lab), 1)
        new = np.ones(len(lab), bool)
        new[1:] = (lab[1:] != lab[:-1]) | (doc[1:] != doc[:-1])
        seg = np.flatnonzero(new)
        ends = np.searchsorted(doc[seg], np.arange(len(n) + 1))
        names = pa.array(m.langs)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                names.take(pa.array(count.argmax(1), mask=n == 0)),
                pa.array(n.astype(np.int32)),
                pa.array(np.maximum(np.diff(ends) - 1, 0).astype(np.int32)),
                pa.array(np.bincount(doc, sure, len(n)) / np.maximum(n, 1), mask=n == 0),
                list_array(ends, pa.array((seg - bounds[doc[seg]]).astype(np.int32))),
                list_array(ends, names.take(pa.array(lab[seg]))),
            ],
            names=["doc_id", "lang", "n_words", "n_switches", "certainty", "segment_starts", "segment_langs"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, OUT)
