"""Secrets in source and configuration text.

Three base patterns are always reported. Beside them, the text is lexed into name-literal
pairs (``name = "literal"``, ``"name": "literal"``, ``name: literal`` and the like), constants are carried from
name to name and through ``+``, and the literals that reach a sensitively named target are scored by
the name and by how random they look.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base patterns, in their order.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20

# How sensitive a part of a target's name is, and parts that speak against it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "signature": 0.6,
    "private": 0.7, "encryption": 0.7, "key": 0.6, "keys": 0.6, "salt": 0.7, "dsn": 0.6, "cookie": 0.6, "jwt": 0.9,
}
HARMLESS = {"public", "length", "len", "count", "min", "max", "path", "file", "filename", "dir", "url", "uri", "name", "id", "type",
            "field", "label", "hint", "prompt", "policy", "expires", "expiry", "ttl", "timeout", "limit", "format", "regex", "pattern", "header"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|change_?me|example|dummy|test|sample|placeholder|your[-_ ].*|insert.*|none|null|true|false|undefined|todo|<.*>|\$?\{.*\}|%.*%)$")
# The same for a value too long for the fixed words: its start and last character decide.
_LONG_PLACEHOLDER = re.compile(r"(?i)^(?:your[-_ ].*|insert.*|<.*>|\$?\{.*\}|%.*%)$")
_HEAD = 16
LIMIT = 0.45
# A profile of more characters is scaled down; only proportions matter there.
_MOST = 1e200

# Quoted texts end on their line.
_QUOTED = {'"': r'"(?:[^"\\\n]|\\.)*"', "'": r"'(?:[^'\\\n]|\\.)*'", "`": r"`[^`\n]*`"}


def _lexer(unclosed: str) -> re.Pattern:
    """Tokens; a mark in ``unclosed`` opens no text."""
    return re.compile(rf"""
    (?P<text>{"|".join(p for mark, p in _QUOTED.items() if mark not in unclosed)})
  | (?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*)
  | (?P<op>:=|=>|==|!=|<=|>=|[:=+,;(){{}}\[\]])
  | (?P<comment>\#[^\n]*|//[^\n]*)
  | (?P<skip>\\\r?\n)
  | (?P<nl>\n)
  | (?P<other>[^\s"'`A-Za-z_$:=+,;(){{}}\[\]#/]+|.)
""", re.X)


_LEXERS = {frozenset(marks): _lexer(marks) for marks in ("", '"', "'", "\"'")}
_BARE = re.compile(r"[^\s\"'`#;,(){}\[\]]+")
_LINE_END = re.compile(r"[^\S\n]*(?:[#\n]|\Z)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# A text without any of these has no sensitive name.
_HINTS = tuple(w for w in SENSITIVE if not any(v != w and v in w for v in SENSITIVE))
_SETS = (":", "=", ":=", "=>")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind."""
    lower, found = text.lower(), []
    if any(w in lower for w in ("password", "passwd", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def name_score(name: str) -> float:
    """How sensitive a target is, from the parts of its name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS or "public" in parts:
        return 0.0
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)


@dataclass(frozen=True, slots=True)
class Profile:
    """What the score needs of a value, so that joined values are scored without their text.

    Characters are counted by code point modulo 128: exact for ASCII, folded beyond it. ``kinds`` marks
    lower case, upper case, digits, other characters and white space.
    """

    counts: np.ndarray
    length: float
    kinds: tuple[bool, ...]
    head: str
    last: str

    @classmethod
    def of(cls, value: str) -> Profile:
        points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = set(value)
        kinds = (any(c.islower() for c in seen), any(c.isupper() for c in seen), any(c.isdigit() for c in seen),
                 any(not c.isalnum() for c in seen), any(c.isspace() for c in seen))
        return cls(np.bincount(points & 127, minlength=128).astype(float), float(len(value)), kinds, value[:_HEAD], value[-1:])

    def __add__(self, other: Profile) -> Profile:
        counts, length = self.counts + other.counts, self.length + other.length
        if length > _MOST:
            counts, length = counts / 1e100, length / 1e100
        head = self.head if len(self.head) == _HEAD else (self.head + other.head)[:_HEAD]
        return Profile(counts, length, tuple(a or b for a, b in zip(self.kinds, other.kinds)), head, other.last or self.last)

    def placeholder(self) -> bool:
        if self.length <= _HEAD:
            return bool(PLACEHOLDER.match(self.head))
        one = len({c.lower() for c in self.head}) == 1 and self.head[0] in "xX*.-_"
        same = sum(self.counts[ord(c)] for c in {self.head[0].lower(), self.head[0].upper()}) if one else 0
        return bool(one and same == self.length) or bool(_LONG_PLACEHOLDER.match(self.head + self.last))

    def score(self) -> float:
        """From 0 to 1: long, mixed and varied values look like secrets; words and placeholders do not."""
        if self.length < 6 or self.kinds[4] or self.placeholder():
            return 0.0
        share = self.counts[self.counts > 0] / self.length
        entropy = -float(np.dot(share, np.log2(share)))
        return min(1.0, entropy / 3.5) * (0.55 + 0.15 * sum(self.kinds[:4]))


def literal_score(value: str) -> float:
    return Profile.of(value).score()


class _Value:
    """A constant: a literal's span, or two constants joined. Names share them, nothing is copied."""

    __slots__ = ("left", "right", "start", "end")

    def __init__(self, left: _Value | None = None, right: _Value | None = None, start: int = 0, end: int = 0) -> None:
        self.left, self.right, self.start, self.end = left, right, start, end


def _reached(values: list[_Value]) -> set[tuple[int, int]]:
    """Spans of all literals that the values are made of, each value visited once."""
    seen, found, todo = set(map(id, values)), set(), list(values)
    while todo:
        v = todo.pop()
        if v.left is None:
            if v.end > v.start:
                found.add((v.start, v.end))
            continue
        for part in (v.left, v.right):
            if id(part) not in seen:
                seen.add(id(part))
                todo.append(part)
    return found


def _tokens(text: str) -> Iterator[re.Match]:
    """Tokens in order.

    Once a quotation mark finds no partner on its line, all later ones of its kind there are escaped for it and for each
    other, so the rest of the line is read without that kind; a line is not searched again from each of them.
    """
    at, unclosed, stop = 0, frozenset(), -1
    while at < len(text):
        for m in _LEXERS[unclosed].finditer(text, at):
            if unclosed and m.start() >= stop:
                at, unclosed = m.start(), frozenset()
                break
            yield m
            if m[0] in ('"', "'") and m[0] not in unclosed:
                at, unclosed = m.end(), unclosed | {m[0]}
                stop = end if (end := text.find("\n", at)) >= 0 else len(text)
                break
        else:
            return


def _indent(text: str, at: int) -> int:
    line = text[text.rfind("\n", 0, at) + 1:at]
    return len(line) - len(line.lstrip())


def _pairs(text: str) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """(target, terms) of the assignments of a text; a term is (kind, value, start, end).

    A value may stand on a later line than its name, in parentheses, or go on after a ``+``. A line break ends it otherwise.
    """
    tokens = [(m.lastgroup, m[0], *m.span()) for m in _tokens(text) if m.lastgroup != "skip" and (m[0] == "\n" or not m[0].isspace())]
    n = len(tokens)

    def past(j: int) -> int:
        while j < n and tokens[j][0] in ("nl", "comment"):
            j += 1
        return j

    def sets(j: int) -> bool:
        return j < n and tokens[j][1] in _SETS

    run_end = -1  # the end of the unquoted run that was looked at last

    i = 0
    while i < n:
        kind, value, start, _ = tokens[i]
        k = past(i + 1) if kind in ("text", "name") else n
        if not sets(k):
            i += 1
            continue
        target, j = (value[1:-1] if kind == "text" else value), k + 1
        if tokens[k][1] == ":" and j + 1 < n and tokens[j][0] == "name" and tokens[j + 1][1] == "=":
            j += 2  # name: type = value
        first = past(j)
        if kind == "name" and j < n and tokens[j][1] in ("|", ">", "|-", ">-", "|+", ">+"):
            first = past(j + 1) if j + 1 < n and tokens[j + 1][0] == "nl" else first
        broken = first > j
        if tokens[k][1] in (":", "=") and kind == "name" and first < n and tokens[first][0] != "text":
            at = tokens[first][2]
            if at >= run_end:
                bare = _BARE.match(text, at)
                run_end = bare.end() if bare else at
            alone = run_end > at and _LINE_END.match(text, run_end)
            # On a later line it is a value only if indented, and not a pair itself.
            own = not broken or (_indent(text, at) > _indent(text, start) and alone and not re.search(r":$|[:=][^=]", text[at:run_end]))
            if alone and own:  # a value without quotes, alone to the end of the line
                yield target, [("bare", text[at:run_end], at, run_end)]
                stop = end if (end := text.find("\n", at)) >= 0 else len(text)
                while i < n and tokens[i][2] < stop:
                    i += 1
                continue
        j, depth = first, 0
        while j < n and tokens[j][1] == "(":
            j, depth = past(j + 1), depth + 1
        if j < n and (quote := text[tokens[j][2]:tokens[j][2] + 3]) in ('"""', "'''"):
            at = tokens[j][2] + 3
            close = text.find(quote, at)
            if close >= 0:  # what stands inside is looked at as well
                inner = text[at:close]
                at += len(inner) - len(inner.lstrip())
                yield target, [("triple", inner.strip(), at, at + len(inner.strip()))]
                i = k + 1
                continue
        if (broken or depth) and sets(past(j + 1)):  # the next pair
            yield target, []
            i = k + 1
            continue
        terms, good, ended = [], True, False
        while j < n and tokens[j][0] in ("text", "name"):
            terms.append(tokens[j])
            j += 1
            m = past(j)
            if m < n and tokens[m][1] == "+":
                v = past(m + 1)
                across = m > j or v > m + 1
                if v < n and tokens[v][0] in ("text", "name") and not (across and sets(past(v + 1))):
                    j = v
                    continue
                ended = across or v >= n
                good = ended
            elif depth and tokens[j - 1][0] == "text" and m < n and tokens[m][0] == "text":
                j = m  # neighbours in parentheses are one literal
                continue
            break
        if not ended and j < n and tokens[j][1] not in (",", ";", "}", ")", "]") and tokens[j][0] not in ("comment", "nl"):
            good = False
        yield target, terms if good else []
        i = max(j, k + 1) if good and terms else i + 1


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive target, directly or through constants."""
    if not ("=" in text or ":" in text):
        return []
    lower = text.lower()
    if not any(h in lower for h in _HINTS):
        return []
    known: dict[str, tuple[_Value, Profile]] = {}
    secret: list[_Value] = []
    for target, terms in _pairs(text):
        whole: tuple[_Value, Profile] | None = None
        for kind, value, start, end in terms:
            if kind == "text":
                term = _Value(start=start + 1, end=end - 1), Profile.of(value[1:-1])
            elif kind == "triple":
                term = _Value(start=start, end=end), Profile.of("".join(x.strip() for x in value.split("\n")))
            elif kind == "bare" and value not in known:
                term = _Value(start=start, end=end), Profile.of(value)
            elif value in known:
                term = known[value]
            else:
                whole = None
                break
            whole = (_Value(whole[0], term[0]), whole[1] + term[1]) if whole else term
        if whole is None:
            known.pop(target, None)
            continue
        known[target] = whole
        score = name_score(target)
        if score and score * whole[1].score() >= LIMIT:
            secret.append(whole[0])
    return [("literal", s, e) for s, e in sorted(_reached(secret))]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; a literal inside a base span is not told twice."""
    base = base_spans(text)
    more, k, reach = [], 0, -1
    for s in literal_spans(text):
        while k < len(base) and base[k][1] <= s[1]:
            reach, k = max(reach, base[k][2]), k + 1
        if s[2] > reach:
            more.append(s)
    return base, in_order(base + more)


_SCHEMA = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_RESULT = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def column(rows: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in r] for r in rows], pa.list_(_SCHEMA))
    for batch in batches:
        both = [all_spans(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), column([b for b, _ in both]), column([a for _, a in both])], names=["doc_id", "base", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, ``base`` spans and all ``spans`` (kind, start, end in code points, end exclusive).

    A null text is empty. Rows are independent, so nulls, repeated rows and an empty table need no care;
    other columns are not read. A text is held whole by one task.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _RESULT)


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span replaced; overlapping spans are replaced together."""
    parts, at = [], 0
    for _, start, end in all_spans(text)[1]:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def digest(spans: list[Span]) -> str:
    """Spans joined as kind:start:end."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
