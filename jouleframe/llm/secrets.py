"""Secret scans by assignment-aware lexing (operator 2).

Three plain patterns give the base spans: values assigned to a secret's name, access keys,
and long hexadecimal runs. Beside them a lexer reads each whole text as source or
configuration: it finds every ``name = literal`` pair (``=``, ``:``, ``:=``, ``=>``; quoted
strings, also on the next line or after a type, string concatenations, bare words; JSON keys,
quoted subscripts, exports, flags, XML attributes),
binds names to literals in order of appearance, and follows names that are assigned other
names or concatenations of them, so a constant that reaches a sensitive name later is
flagged where it is written. Values are evaluated as far as they are written out: strings side by
side, joined, in parentheses or interpolated make one constant, of a call the last string
argument counts, and a word that is called or assigned elsewhere is a name. A constant is
scored by how sensitive the words of the names are that it reaches and how random it looks as a
whole; its literal parts above ``LEAST`` are spans of kind ``literal``.

Texts are scanned row by row in Arrow batches; nothing is moved, and a long text costs one
task memory in proportion to itself. Defined results: a null or empty text has no spans
(``spans`` is '' and ``base_sha256`` that of ''). Overlapping spans of different kinds all
stay; a ``literal`` that lies in a base span is not repeated. Repeated rows each get their
own row; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from jouleframe.llm.common import text_of

LEAST = 0.6       # least score of a flagged pair
SHORTEST = 8      # characters of a literal worth scoring

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "literal")

# Words of a name and how surely they mean a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
             "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "private": 0.6, "signing": 0.6, "encryption": 0.6, "access": 0.5, "client": 0.3, "key": 0.5,
             "salt": 0.6, "session": 0.5, "cookie": 0.4, "dsn": 0.6, "webhook": 0.5, "pass": 0.8, "pin": 0.4, "api": 0.4}
HARMLESS = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|\*\*\*|<[^>]*>|\$\{|\{\{|^(?:none|null|true|false|undefined|required|optional|string|todo)$", re.A)

_QUOTED = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"""
_GAP = r"[\x20\t]*+"
_BREAK = r"[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?+"
# A type between a name and its literal; it holds no colon, so that a scan ends before the next one.
_TYPE = (rf"""[&*]*+(?:'\w++[\x20\t]++)?+(?![0-9])[\w.]++(?:\[[^\]\[:\n"'`=]*+(?:\[[^\]\[:\n"'`=]*+\][^\]\[:\n"'`=]*+)*+\]|<[^<>:\n"'`=]*+(?:<[^<>:\n"'`=]*+>[^<>:\n"'`=]*+)*+>)*+"""
         rf"""(?:{_GAP}\|{_GAP}[\w.]++)*+\??+{_GAP}""")
# A value on the next line is a literal, and no quoted name there.
_NEXT = rf"""{_BREAK}(?=(?:{_QUOTED})(?!{_GAP}[:=\]]))"""
# A name, which can be the last of several or the quoted subscript of another, and its operator. A name without one is passed over
# as a whole, for no part of it has one either: a text is read once, however long its names and gaps.
PAIR = re.compile(rf"""(?P<more>(?:(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*+{_GAP},{_GAP})*+)(?P<name>(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_.-]*+)"""
                  rf"""(?:(?P<shut>["'`]?(?:{_GAP}\])?+){_GAP}"""
                  rf"""(?P<sign>:(?![:=]){_GAP}{_TYPE}=(?![=>]){_NEXT}|(?::=|=>|=(?!=)|:(?!:))(?:{_NEXT}|{_GAP})))?+""", re.A)
# What a value is made of. Values end at anything else, so containers and keyword arguments give pairs of their own.
TOKEN = re.compile(rf"""(?P<quoted>(?P<prefix>[A-Za-z]{{0,2}}(?=["'`]))(?P<body>\"{{3}}(?s:.*?)\"{{3}}|'{{3}}(?s:.*?)'{{3}}|{_QUOTED}))|(?P<ref>\$(?:[A-Za-z_]\w*+|\{{[A-Za-z_]\w*+\}}))"""
                   rf"""|(?P<or>\|\||\?\?|(?:or|and)\b)|(?P<open>\()|(?P<shut>\))|(?P<comma>,)|(?P<plus>\+)|(?P<word>[^\s"'`,;(){{}}\[\]<>+|]+)""", re.A)
BLOCK = re.compile(r"[|>][-+0-9]*[\x20\t]*+\r?\n(?P<indent>[\x20\t]++)(?P<lines>[^\n]++(?:\n(?P=indent)[^\n]++)*+)", re.A)
ATTRIBUTES = re.compile(r"""\b(?:key|name)\s{0,8}=\s{0,8}(["'])(?P<name>[\w.:-]++)\1\s{1,8}value\s{0,8}=\s{0,8}(["'])(?P<value>[^"'\n]*+)\3""", re.A | re.I)
INSIDE = re.compile(r"\$\{?(\w+)\}?|\{(\w+)[^{}\n]*\}", re.A)
CONSTANT_NAME = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\Z")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z", re.A)


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:])}
    scores = sorted((SENSITIVE[w] for w in {*words, *joined} if w in SENSITIVE), reverse=True)
    return min(1.0, sum(s / 2 ** i for i, s in enumerate(scores)))


def randomness(literal: str) -> float:
    """From 0 (one repeated letter, plain words) to 1 (many different characters of several classes)."""
    n = len(literal)
    if n < SHORTEST or HARMLESS.search(literal):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    spaced = 0.5 if re.search(r"\s", literal) else 1.0
    return min(1.0, bits / 4.0) * min(1.0, 0.4 + 0.2 * classes) * spaced * min(1.0, 0.5 + n / 32)


Part = tuple[int, int] | str  # a literal's place, or a name whose value stands there


def value_of(text: str, at: int, bare: bool) -> tuple[list[list[Part]], int]:
    """The comma-separated values that begin at ``at``, each as alternatives' parts one after another, and where they end.

    Parts that stand side by side or are joined by ``+`` make one constant; of a call the last string
    argument counts. ``bare`` words are literals as well, unless they are called.
    """
    values: list[list[Part]] = [[]]
    calls: list[tuple[bool, list[Part]]] = []  # of open parentheses: whether of a call, and what stood before
    last = ""
    while True:
        while at < len(text) and (text[at] in " \t" or (calls or last == "plus") and text[at] in "\r\n\\"):
            at += 1
        m = TOKEN.match(text, at)
        if not m:
            return values, at
        kind = next(k for k in ("quoted", "ref", "or", "open", "shut", "comma", "plus", "word") if m[k] is not None)
        # Only strings go on without a sign between them.
        if kind in ("word", "ref", "quoted") and last in ("word", "ref", "quoted", "shut") and not kind == last == "quoted" or kind == "open" and last in ("quoted", "shut", "ref"):
            return values, at
        if kind == "quoted":
            edge = 3 if m["body"][:3] in ('\"\"\"', "\'\'\'") and len(m["body"]) >= 6 else 1
            start, end = m.start("body") + edge, m.end("body") - edge
            if not (calls and calls[-1][0] and CONSTANT_NAME.match(text[start:end])):
                values[-1] += _pieces(text, start, end)
        elif kind == "ref":
            values[-1].append(m[0].strip("${}"))
        elif kind == "open":
            calls.append((last == "word", values[-1]))
            if last == "word" and values[-1]:
                values[-1].pop()  # a name that is called is no value
            values[-1] = []
        elif kind == "shut":
            if not calls:
                return values, at
            values[-1] = calls.pop()[1] + values[-1]
        elif kind == "comma":
            if calls:
                if calls[-1][0]:
                    values[-1] = []
            else:
                values.append([])
        elif kind == "word":
            if NAME.match(m["word"]):
                # Called, subscripted, dotted without a digit, or an argument: a name. Other bare words may be either.
                name = not bare or calls or text[m.end():m.end() + 1] in ("(", "[") or "." in m["word"] and not re.search("[0-9]", m["word"])
                values[-1].append(m["word"] if name else f"?{m.start()}:{m.end()}")
            elif not calls:
                values[-1].append((m.start(), m.end()))
        last, at = kind, m.end()


def _pieces(text: str, start: int, end: int) -> list[Part]:
    """A string's literal stretches and the names that it interpolates."""
    out: list[Part] = []
    at = start
    for m in INSIDE.finditer(text, start, end):
        if m.start() > at:
            out.append((at, m.start()))
        out.append(m[1] or m[2])
        at = m.end()
    if at < end:
        out.append((at, end))
    return out


def pairs(text: str):
    """Names and the parts of what they are assigned."""
    for m in PAIR.finditer(text):
        if m["sign"] is None:
            continue
        at = m.end()
        block = BLOCK.match(text, at) if m["sign"].strip() == ":" else None
        if block:
            place = block.start("lines")
            for line in block["lines"].split("\n"):
                yield m["name"], [(place + len(line) - len(line.lstrip()), place + len(line.rstrip()))]
                place += len(line) + 1
            continue
        values, _ = value_of(text, at, "=" in m["sign"])
        names = [n.strip() for n in m["more"].split(",")[:-1]] + [m["name"]]
        if len(names) == len(values):
            yield from zip(names, values)
        else:
            yield m["name"], values[0]
    for m in ATTRIBUTES.finditer(text):
        yield m["name"], [(m.start("value"), m.end("value"))]


def literals(text: str) -> list[tuple[int, int, float]]:
    """Spans of the literal parts of constants that are, or later become, the value of a sensitive name."""
    bound: dict[str, list[list[Part]]] = {}
    reach: dict[str, float] = {}
    for name, parts in pairs(text):
        if parts:
            reach.setdefault(name, sensitivity(name))
            bound.setdefault(name, []).append(parts)
    # A bare word is the value of a name that is assigned somewhere, else a literal.
    for constants in bound.values():
        for parts in constants:
            for i, p in enumerate(parts):
                if isinstance(p, str) and p[0] == "?":
                    start, end = map(int, p[1:].split(":"))
                    parts[i] = text[start:end] if text[start:end] in bound else (start, end)
    # A constant is as sensitive as the most sensitive name that it reaches: from those names backwards, most sensitive first.
    for name in sorted(reach, key=reach.get, reverse=True):
        level, waiting = reach[name], [name]
        while waiting:
            for parts in bound.get(waiting.pop(), ()):
                for other in parts:
                    if isinstance(other, str) and other in bound and reach[other] < level:
                        reach[other] = level
                        waiting.append(other)
    found = {}
    for name, constants in bound.items():
        if reach[name]:
            for parts in constants:
                # A name stands for its constant where it has one only.
                own = [q for p in parts for q in ([p] if not isinstance(p, str) else bound[p][0] if len(bound.get(p, ())) == 1 else []) if not isinstance(q, str)]
                score = math.sqrt(reach[name] * randomness("".join(text[a:b] for a, b in own)))
                if score >= LEAST:
                    found |= {(a, b): score for a, b in own if b > a}
    return [(a, b, score) for (a, b), score in found.items()]


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), by start, then kind as listed."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    added = []
    if "=" in text or ":" in text:
        inside = sorted((s, e) for s, e, _ in base)
        added = [(s, e, "literal") for s, e, _ in literals(text) if not any(a <= s and e <= b for a, b in inside)]
    return sorted({*base, *added}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


RESULT = (StructType().add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("spans", "string")
          .add("n_literal", "long"))


@F.pandas_udf(RESULT)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            spans = spans_of(text or "")
            base = [x for x in spans if x[2] != "literal"]
            n = Counter(x[2] for x in spans)
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n["literal"]))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])


def scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _scan(text_of()).alias("s")).select("doc_id", "s.*")
