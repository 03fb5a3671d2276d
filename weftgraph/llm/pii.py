"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, URL schemes, plus signs and digit
groups, and identifier cues in any case (``account``, ``iban``, ``password``, ``apiKey``, ...). At each, a deterministic parser
expands to both sides and validates what it spans:

* ``email``: local part and dotted domain around an at-sign, of any length, with an alphabetic top level;
* ``url_credentials``: a URL that carries user and password before its host, up to white space, a quote or a closing bracket;
* ``phone``: ``+`` and 8 to 15 digits in groups (ten after ``+1``), or ``(ddd) ddd-dddd`` / ``ddd-ddd-dddd``;
* ``ip_address``: four numbers of 0 to 255;
* ``card``: 13 to 19 digits, plain or in groups, that pass Luhn's check;
* ``iban``: country, check digits and account with remainder 1 modulo 97; ``ssn``: ``ddd-dd-dddd`` in valid areas;
* ``credential``: the value after ``password=``, ``token = "..."`` and their like, of 8 or more characters with a digit or
  a sign among them (so ``password=correcthorsebattery`` isn't one), and access-key ids;
* ``account``: an identifier of 6 to 34 characters with 5 or more digits after an account cue.

Spans that overlap become one, of the kind that starts first, then is longer, then comes first above. Positions count characters.
Every parser looks at each character a bounded number of times in all (at-signs part local parts and domains, slashes
part authorities, an anchor within a URL or value that was found belongs to it), so time is linear in the text, however
long and whatever it repeats. Defined cases: a null or empty text has no findings; an empty table gives no rows; a null
doc_id is kept in findings as null; repeated rows give repeated findings; other columns are ignored (``redact`` keeps
them, and brings ``n_chars`` up to date if it is there).
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map

KINDS = ("email", "url_credentials", "phone", "ip_address", "card", "iban", "ssn", "credential", "account")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key", "auth_key", "authkey", "auth-key")
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte", "iban", "passport", "customer id", "user id", "member id", "routing")
SCHEMES = ("://",)
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
DIGITS = frozenset("0123456789")
WORD = re.compile(r"[A-Za-z0-9_]")
#: Lower case of ASCII alone, for texts whose lower case is longer: it leaves every character where it is.
LOWER = {c: c + 32 for c in range(65, 91)}
NANP = re.compile(r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)")
INTL = re.compile(r"\+[1-9]\d{0,3}(?:[ .-]?\(?\d{1,5}\)?){1,6}")
LOCAL_PHONE = re.compile(r"(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)")
IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)")
CARD = re.compile(r"\d{13,19}(?!\d)|\d{4}(?:[ -]\d{4}){3}(?!\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)")
SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d)")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
SECRET_VALUE = re.compile(r"""[A-Za-z0-9_-]{0,16}["']?\s{0,3}(?:=>|[=:])\s{0,3}["']?([A-Za-z0-9_+/=.~!@#$%^&*-]{8,})""")
ACCOUNT_VALUE = re.compile(r"""(?:\s{0,2}(?:number|no\.?|nr\.?|id|#))?\s{0,2}[:=#]?\s{0,2}([A-Za-z0-9][A-Za-z0-9-]{4,32}[A-Za-z0-9])(?![A-Za-z0-9])""", re.I)
ACCESS_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in (
        [("@", "at"), ("akia", "key"), ("asia", "key")]
        + [(s, "scheme") for s in SCHEMES]
        + [(f"+{d}", "plus") for d in "123456789"]
        + [(f"{d}{e}", "digits") for d in "0123456789" for e in "0123456789"]
        + [(f"{d}.{e}", "digits") for d in "0123456789" for e in "0123456789"]
        + [(c, "secret") for c in SECRET_CUES]
        + [(c, "account") for c in ACCOUNT_CUES]
    ):
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def email_at(text: str, at: int) -> Span | None:
    start, end = at, at + 1
    while start and text[start - 1] in LOCAL:
        start -= 1
    while end < len(text) and text[end] in HOST:
        end += 1
    while start < at and text[start] in ".%+-":
        start += 1
    while end > at + 1 and text[end - 1] in ".-":
        end -= 1
    labels = text[at + 1 : end].split(".")
    # what follows the top level may be the next sentence: "a@b.example.Next"
    while len(labels) > 1 and not (labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24):
        end -= len(labels.pop()) + 1
    if start == at or text[at - 1] == "." or len(labels) < 2 or any(not x or x[0] == "-" or x[-1] == "-" or len(x) > 63 for x in labels):
        return None
    return start, end, "email"


AUTHORITY = re.compile(r"""[^\s"'<>)\]}/]*""")
URL_END = re.compile(r"""[\s"'<>)\]}]""")


def url_at(text: str, at: int) -> Span | None:
    start = at
    while start and text[start - 1].isalpha() and text[start - 1].isascii():
        start -= 1
    user, _, host = AUTHORITY.match(text, at + 3).group().rpartition("@")
    if start == at or ":" not in user or not host:
        return None
    end = URL_END.search(text, at + 3)
    return start, end.start() if end else len(text), "url_credentials"


def whole(text: str, start: int, end: int) -> bool:
    return not (start and WORD.match(text[start - 1])) and not (end < len(text) and WORD.match(text[end]))


def plus_at(text: str, at: int) -> Span | None:
    if text.startswith("+1", at) and (m := NANP.match(text, at)):
        return at, m.end(), "phone"
    if not (m := INTL.match(text, at)):
        return None
    end = at + 1
    count = 0
    # the longest run of whole groups with no more than 15 digits
    for g in re.finditer(r"[ .-]?\(?(\d+)\)?", m.group()[1:]):
        count += len(g[1])
        if count > 15:
            break
        end = at + 1 + g.end()
    if (digits := sum(c in DIGITS for c in text[at:end])) < 8 or digits > 15 or end < len(text) and text[end] in DIGITS:
        return None
    return at, end, "phone"


def digits_at(text: str, at: int) -> Span | None:
    start = at
    while start and text[start - 1] in DIGITS:
        start -= 1
    if start > 1 and text[start - 2 : start] in ("-(", "+(") or start and text[start - 1] == "+":
        return None
    if (m := IPV4.match(text, start)) and not (start > 1 and text[start - 1] == "." and text[start - 2] in DIGITS):
        if all(int(x) < 256 for x in m.group().split(".")) and whole(text, start, m.end()):
            return start, m.end(), "ip_address"
    if (m := SSN.match(text, start)) and whole(text, start, m.end()):
        return start, m.end(), "ssn"
    if (m := CARD.match(text, start)) and whole(text, start, m.end()):
        only = re.sub(r"\D", "", m.group())
        if luhn(only) and only.strip("0"):
            return start, m.end(), "card"
    opened = start - 1 if start and text[start - 1] == "(" else start
    if (m := LOCAL_PHONE.match(text, opened)) and whole(text, opened, m.end()):
        return opened, m.end(), "phone"
    if start > 1 and text[start - 2 : start].isascii() and text[start - 2 : start].isupper() and (m := IBAN.match(text, start - 2)) and not (start > 2 and WORD.match(text[start - 3])):
        # the longest valid account among the groups that match: remainders of what follows the head, then of the head
        head, rest, n, end = int("".join(str(int(c, 36)) for c in text[start - 2 : start + 2])), 0, 4, 0
        for k in range(start + 2, m.end()):
            if text[k] != " ":
                v = int(text[k], 36)
                rest, n = (rest * (10 if v < 10 else 100) + v) % 97, n + 1
                if 15 <= n <= 34 and (rest * 10**6 + head) % 97 == 1:
                    end = k + 1
        if end:
            return start - 2, end, "iban"
    return None


def secret_at(text: str, end: int) -> Span | None:
    m = SECRET_VALUE.match(text, end)
    if not m or not any(c in DIGITS or c in "!#$%^&*+=~@" for c in m[1]):
        return None
    stop = m.end(1)
    while stop > m.start(1) and text[stop - 1] in ".":
        stop -= 1
    return m.start(1), stop, "credential"


def account_at(text: str, start: int, end: int) -> Span | None:
    m = ACCOUNT_VALUE.match(text, end)
    if not m or start and text[start - 1].isalpha() or sum(c in DIGITS for c in m[1]) < 5:
        return None
    return m.start(1), m.end(1), "account"


def find(text: str | None) -> list[Span]:
    """Spans in order, without overlap."""
    if not text:
        return []
    spans: set[Span] = set()
    past = inside_url = inside_value = -1
    for last, (kind, length) in automaton().iter(low if len(low := text.lower()) == len(text) else text.translate(LOWER)):
        at, got = last - length + 1, None
        if kind == "digits":
            if at < past:
                continue
            got = digits_at(text, at)
            past = at + 1
            while past < len(text) and text[past] in DIGITS:
                past += 1
        elif kind == "at":
            got = email_at(text, at)
        elif kind == "plus":
            got = plus_at(text, at)
        elif kind == "scheme":
            if at >= inside_url and (got := url_at(text, at)):
                inside_url = got[1]
        elif kind == "secret":
            if at >= inside_value and (got := secret_at(text, last + 1)):
                inside_value = got[1]
        elif kind == "account":
            got = account_at(text, at, last + 1)
        elif (m := ACCESS_KEY.match(text, at)) and not (at and WORD.match(text[at - 1])):
            got = at, m.end(), "credential"
        if got:
            spans.add(got)
    return united(spans)


def united(spans: set[Span]) -> list[Span]:
    """Spans in order, those that overlap made one of the first's kind."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[1] > out[-1][1]:
            out[-1] = out[-1][0], s[1], out[-1][2]
    return out


def findings(docs: DataFrame) -> DataFrame:
    """One row a finding: doc_id, kind, start (of the first character, from 0), end (past the last) and value."""

    def run(batch: pa.RecordBatch):
        rows = [(d, k, s, e, t[s:e]) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for s, e, k in find(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "kind", "start", "end", "value"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, kind string, start int, end int, value string")


def masked(text: str | None) -> str | None:
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns; each finding in ``text`` replaced by its kind."""

    def run(batch: pa.RecordBatch):
        kind = batch.schema.field("text").type
        text = pa.array([masked(t) for t in batch.column("text").to_pylist()], kind)
        names = batch.schema.names
        cols = [text if n == "text" else pc.utf8_length(text).cast(batch.schema.field(n).type) if n == "n_chars" else batch.column(k) for k, n in enumerate(names)]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(docs, run, docs.schema)
