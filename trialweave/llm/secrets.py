"""Secret scans: plain patterns first, then an assignment-aware lexer over the same text.

The lexer reads source and configuration syntax into pairs of a target name and a literal
(``name = "x"``, ``name: x``, ``"name": "x"``, ``name => x``, ``export NAME=x``, ``<name>x</name>``),
remembers the constants it has seen so that ``target = CONSTANT`` and ``"a" + "b"`` resolve to their
literals, and scores each literal by how sensitive its target's name is and how random it looks.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow

# The plain patterns of the contract.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "literal")

#: Words in a target's name and how sensitive they make it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7,
    "bearer": 0.8, "private": 0.5, "access": 0.4, "key": 0.5, "signature": 0.6, "salt": 0.6,
    "session": 0.3, "client": 0.2, "api": 0.4, "signing": 0.4, "encryption": 0.5,
}
#: A literal is reported from this score: name sensitivity (at most 1) plus randomness (at most 1).
MIN_SCORE = 1.2
MIN_LITERAL = 8

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType())]))


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


_ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, KEYWORDS))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)  # noqa: UP031
_HINTS = ("password", "passwd", "secret", "token", "api")

# A name, an assignment mark, and what follows it up to the end of a literal. The name may be
# quoted or dotted; one space-free bare word counts as a literal only after "=" or ":". Nothing has
# a length limit: possessive runs keep the scan linear, since none of them is read twice.
_LABEL = r"(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)"
_QUOTED = (r"""(?:"(?P<dq>[^"\n\\]*+(?:\\[\s\S][^"\n\\]*+)*+)"|"""
           r"""'(?P<sq>[^'\n\\]*+(?:\\[\s\S][^'\n\\]*+)*+)'""")
_PAIR = re.compile(
    r"(?<![A-Za-z0-9_.-])" + _LABEL + r"""["'\]]{0,2}[ \t]*+(?P<mark>:=|=>|=|:)[ \t]*+"""
    + _QUOTED + r"""|(?P<bare>[^\s"'<>,;(){}\[\]]++))""")
_JOINED = re.compile(r"[ \t]*+\+[ \t]*+" + _QUOTED + ")")
_TAG = re.compile("<" + _LABEL + r">(?P<bare>[^<>\s]++)</(?P=name)>")
#: A further pair of a query string, inside a bare literal.
_FIELD = re.compile("(?<=[?&])" + _LABEL + "=(?P<bare>[^&]++)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the plain patterns, each kind leftmost and not overlapping."""
    spans = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text)
                  if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)
                  if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def sensitivity(name: str) -> float:
    """How sensitive a target's name is: the sum of its words' weights, at most 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = ["".join(p) for p in zip(words, words[1:])]
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in words + pairs))


def randomness(literal: str) -> float:
    """Entropy of the characters against that of a random string, with a share for digits."""
    if len(literal) < MIN_LITERAL:
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    scale = min(math.log2(len(literal)), 5.0)
    digits = any(c.isdigit() for c in literal) and any(c.isalpha() for c in literal)
    return min(1.0, entropy / scale) * (1.0 if digits else 0.4)


def lex(text: str) -> list[tuple[int, str, int, int, str, bool]]:
    """Pairs (position, name, literal start, literal end, literal, whether it lies in the literal of
    another pair) in the order of the text."""
    pairs = list(_lexed(text, 0, len(text), False))
    if "</" in text:
        pairs += [(m.start(), m["name"], *m.span("bare"), m["bare"], False)
                  for m in _TAG.finditer(text)]
        pairs.sort()
    return pairs


def _lexed(text: str, begin: int, stop: int, inner: bool):
    """The pairs of a stretch of the text, each followed by those that its literal holds."""
    for match in _PAIR.finditer(text, begin, stop):
        group = next(g for g in ("dq", "sq", "bare") if match[g] is not None)
        start, end = match.span(group)
        parts, at = [(start, end)], match.end()
        while group != "bare" and (more := _JOINED.match(text, at, stop)):
            parts.append(more.span("dq" if more["dq"] is not None else "sq"))
            end, at = parts[-1][1], more.end()
        yield (match.start(), match["name"], start, end,
               "".join(text[a:b] for a, b in parts), inner)
        if group == "bare":
            for field in _FIELD.finditer(text, start, end):
                yield field.start(), field["name"], *field.span("bare"), field["bare"], True
            continue
        for a, b in parts:
            yield from _lexed(text, a, b, True)


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals whose target's name, or that of a name they reach, is sensitive; none lies
    in another."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    constants: dict[str, tuple[int, int, str]] = {}
    found, covered = set(), 0
    for at, name, start, end, literal, inner in lex(text):
        value = (start, end, literal)
        if _NAME.match(literal) and literal in constants:
            value = constants[literal]  # the target is given what that constant holds
        if inner:
            constants.setdefault(name, value)
            if at < covered:
                continue
        else:
            constants[name] = value
        weight = sensitivity(name)
        if weight and weight + randomness(value[2]) >= MIN_SCORE and len(value[2]) >= MIN_LITERAL:
            found.add((value[0], value[1], "literal"))
            if value[:2] == (start, end):
                covered = max(covered, end)
    return sorted(found)


def all_spans(text: str) -> list[tuple[int, int, str]]:
    """Plain spans, and literals that no plain span covers, by start and then kind.

    One sweep in the order of starts: of the plain spans that start no later than a literal, the
    furthest end tells whether one covers it.
    """
    spans = sorted(base_spans(text))
    at, reach, more = 0, -1, []
    for literal in literal_spans(text):
        while at < len(spans) and spans[at][0] <= literal[0]:
            reach, at = max(reach, spans[at][1]), at + 1
        if literal[1] > reach:
            more.append(literal)
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of (kind, start, end) in code points, end
    exclusive, by start and then kind (``assign access hex literal``).

    Null and empty texts have none. Repeated rows stay repeated; other columns are not read. One
    pass, no shuffle.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType),
                           T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in all_spans(v.as_py())]
                     for v in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])
        return run
    return map_arrow(rows, build, schema, "text")


def redact(df: DataFrame, mark: str = "[secret]", text: str = "text",
           length: str | None = "n_chars") -> DataFrame:
    """The frame with every secret span of ``text`` replaced by ``mark``; overlapping spans are
    replaced once. ``length``, where the frame has it, becomes the new number of code points of
    changed rows. Null texts stay null, all columns stay.
    """
    schema, names = df.schema, df.columns
    at = names.index(text)
    counted = names.index(length) if length in names else None

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            changed = {}
            for row, value in enumerate(texts):
                spans = all_spans(value) if value else []
                if not spans:
                    continue
                out, end = [], 0
                for a, b, _ in spans:
                    if a >= end:
                        out += [value[end:a], mark]
                    end = max(end, b)
                changed[row] = "".join(out) + value[end:]
            if changed:
                for row, value in changed.items():
                    texts[row] = value
                columns[at] = pa.array(texts, columns[at].type)
                if counted is not None:
                    lengths = columns[counted].to_pylist()
                    for row, value in changed.items():
                        lengths[row] = len(value)
                    columns[counted] = pa.array(lengths, columns[counted].type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        return run
    return map_arrow(df, build, schema, text)
