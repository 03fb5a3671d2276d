"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

A public vocabulary file (a parameter, see ``TOKENIZER``) is read by each worker. Bytes are written as its alphabet's
characters, one a byte, and the library's BPE model merges them. Pre-tokens never cross a space that a non-space
follows, so texts are split there, and each distinct piece of a batch is pre-tokenised and encoded once.
``token_starts`` are the character offsets in the text at which tokens start; a token that starts within a
character (one split over tokens) gets that character's offset. Decoding maps tokens to the bytes of their
characters, joins them, and reads the whole as UTF-8, so characters split over tokens come back whole.

Defined cases: a null or empty text has no tokens, and decodes to an empty text; strings of special tokens are ordinary
text; any Unicode text round-trips, very long ones whole; a null doc_id is kept as null; an empty table gives no rows; other
columns are ignored by ``encode``; repeated rows are encoded each. Pre-tokens are those of the byte-level pre-tokeniser with
its usual pattern; ``codec`` refuses a vocabulary file whose pre-tokeniser is another.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from weftgraph.llm.common import arrow_map, list_array, texts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space, or the end, after a space: only such texts have pre-tokens across spaces.
LOOSE = r" (?:[\s\v\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|\z)"
#: Characters that are neither letters, digits, white space nor the start of a contraction.
MARKS = ".,;:!?*&%$#|()-\""
#: Text encoded at a time: offsets and indexes take some fifty bytes a byte of it.
ENCODE_BYTES = 1 << 20
#: Distinct pre-tokens whose tokens a worker remembers.
MEMORY = 150_000


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    free = 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        said = tokenizer.pre_tokenizer
        if not isinstance(said, ByteLevel) or said.add_prefix_space or not said.use_regex:
            raise ValueError(f"{path} pre-tokenises otherwise than byte-level BPE does: {said}")
        self.model = tokenizer.model
        self.to_chars = {b: c for b, c in enumerate(byte_chars())}
        self.ascii = str.maketrans({chr(b): c for b, c in self.to_chars.items() if b < 128})
        back = {c: b for b, c in self.to_chars.items()}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.length) - self.length
        self.memory: dict[str, bytes] = {}

    def mapped(self, text: str) -> str:
        return text.translate(self.ascii) if text.isascii() else "".join([self.to_chars[b] for b in text.encode()])

    def pre_token(self, text: str) -> bytes:
        """The 32-bit token ids of one pre-token."""
        got = self.memory.get(text)
        if got is None:
            got = array("i", [t.id for t in self.model.tokenize(self.mapped(text))]).tobytes()
            self.remember(text, got)
        return got

    def piece(self, text: str) -> bytes:
        """Token ids of one piece of text, which may hold several pre-tokens."""
        got = self.memory.get(text)
        if got is not None:
            return got
        # letters alone, after a space or not, are one pre-token; marks that end them another
        word = text.rstrip(MARKS)
        if word.isalpha() or word[:1] == " " and word[1:].isalpha():
            return self.pre_token(word) + self.pre_token(text[len(word) :]) if len(word) < len(text) else self.pre_token(text)
        return b"".join(map(self.pre_token, PATTERN.findall(text)))

    def remember(self, text: str, ids: bytes) -> None:
        if len(self.memory) >= MEMORY:
            self.memory = dict(list(self.memory.items())[: MEMORY // 2])
        self.memory[text] = ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds by text and all token ids."""
        column = texts(column)
        loose = pc.match_substring_regex(column, LOOSE).to_numpy(zero_copy_only=False)
        n = len(column)
        tight = pa.array(~loose)
        parts = pc.split_pattern(column.filter(tight), " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = parts.values.slice(int(parts.offsets[0].as_py()), int(ends[-1])).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        # a text's first piece has no space before it
        first = np.zeros(len(code), bool)
        first[ends[:-1]] = True
        heads, code_of_head = np.unique(code[first], return_inverse=True)
        code[first] = len(words) + code_of_head
        ids = [self.piece(" " + w) for w in words] + [self.piece(words[h]) for h in heads]
        base = len(ids)
        # texts in which white space follows a space are pre-tokenised whole
        whole = [b"".join(map(self.pre_token, PATTERN.findall(t))) for t in column.filter(pa.array(loose)).to_pylist()]
        ids += whole
        width = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.int32)
        start = np.cumsum(width) - width
        count = np.ones(n, np.int64)
        count[~loose] = np.diff(ends)
        upto = np.append(0, np.cumsum(count))
        every = np.zeros(upto[-1], np.int64)
        is_loose = np.repeat(loose, count)
        every[~is_loose] = code
        every[is_loose] = base + np.arange(len(whole))
        w = width[every]
        total = np.append(0, np.cumsum(w))
        out = flat[np.repeat(start[every] - total[:-1], w) + np.arange(total[-1])]
        return total[upto], out

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, joined."""
        w = self.length[ids]
        total = np.append(0, np.cumsum(w))
        return self.pool[np.repeat(self.at[ids] - total[:-1], w) + np.arange(total[-1])]

    def starts(self, bounds: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Character offset in its text of each token."""
        lead = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        at = np.cumsum(self.length[ids]) - self.length[ids]
        chars = lead[at]
        inside = (raw[np.minimum(at, max(0, len(raw) - 1))] & 0xC0) == 0x80 if len(raw) else np.zeros(len(at), bool)
        chars = chars - inside
        per = np.diff(bounds)
        base = np.repeat(chars[np.minimum(bounds[:-1], max(0, len(chars) - 1))] if len(chars) else np.zeros(len(per), np.int64), per)
        return (chars - base).astype(np.int32)

    def decode(self, bounds: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts of token ids; bytes that are no UTF-8 become U+FFFD."""
        raw = self.raw(ids)
        ends = np.append(0, np.cumsum(self.length[ids]))[bounds]
        try:
            return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([bytes(raw[i:j]).decode(errors="replace") for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.large_string())


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, token_ids, token_starts, n_tokens, and whether decoding the ids gives the text back."""

    def run(batch: pa.RecordBatch):
        c = codec(tokenizer)
        column = texts(batch.column("text"))
        bounds, ids = c.encode(column)
        same = pc.equal(c.decode(bounds, ids), column)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), list_array(bounds, pa.array(ids)), list_array(bounds, pa.array(c.starts(bounds, ids, c.raw(ids)))), pa.array(np.diff(bounds).astype(np.int32)), same.cast(pa.int32())],
            names=["doc_id", "token_ids", "token_starts", "n_tokens", "round_trip"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, token_ids array<int>, token_starts array<int>, n_tokens int, round_trip int", most=ENCODE_BYTES)


def decode(tokens: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and the text of ``token_ids``; null ids give an empty text."""

    def run(batch: pa.RecordBatch):
        c = codec(tokenizer)
        lists = pc.fill_null(batch.column("token_ids"), pa.scalar([], pa.list_(pa.int32())))
        bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
        ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), c.decode(bounds, ids).cast(pa.string())], names=["doc_id", "text"])

    return arrow_map(tokens.select("doc_id", F.col("token_ids").cast("array<int>").alias("token_ids")), run, "doc_id long, text string", by=None)
