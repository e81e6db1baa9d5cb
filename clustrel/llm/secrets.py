"""Secret scans: fixed patterns, and literals assigned to sensitive names.

Three kinds of spans come from fixed patterns (assign, access, hex). The kind ``literal`` comes from lexing
assignments in source and configuration syntax (``name = "x"``, ``name: x``, ``"name": "x"``, ``name => x``,
``export NAME=x``, ``obj.name = x``, ``obj["name"] = x``, ``name ?= x``, ``#define NAME x``, ``<name>x</name>``,
``name="x"`` in tags, lists in brackets, blocks of YAML, strings in three quotes or with a prefix, ``new String("x")``,
``name: type = x``, ``name[] = x``, ``name = ("x" "y")``, ``getenv("NAME", "x")``, ``name = bytes("x")``): each
gives a name and an expression of literals and names joined by ``+``, ``..``, ``.``, ``or``, ``||``, ``??`` or standing side by side. A name that was assigned earlier stands for its
literals, so that a constant under a plain name is found where it reaches a sensitive one. A literal's score
is the sensitivity of the target name times what its characters say against a word or a placeholder. A literal
within a base span makes no span of its own: it gives that span its target's name and its score (0 without one).

Spans are in code points, end exclusive, ordered by start, then kind. Edge cases: a null or empty text has no
spans; texts are read whole, at any length; every row is scanned for itself, so ties, repeated rows and empty
tables need no care; columns other than id and text aren't read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrel.llm.common import documents

KINDS = ("assign", "access", "hex", "literal")
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18

# Parts of names and how sensitive they are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "key": 0.6, "private": 0.7, "signing": 0.7, "access": 0.5, "salt": 0.6, "cookie": 0.5,
}
# What stands where a secret is to be filled in.
PLACEHOLDERS = re.compile(r"example|change_?me|your|placeholder|dummy|sample|redacted|todo|none|null|true|false|undefined|x{4,}|\*{3,}|<|\$\{|\{\{|%\(", re.I)
THRESHOLD = 0.45
MIN_LITERAL = 8
#: Strings without any of which, in lower case, a text has no sensitive name, and no keyword of the assign kind.
_ROOTS = tuple(w for w in SENSITIVE if not any(o != w and o in w for o in SENSITIVE))
_BASE_ROOTS = ("passw", "secret", "token", "api")
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_STRING = r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_SITE = re.compile(
    r"""(?:(?<![\w.])|(?<=\[))(?P<q>["']?)(?P<name>[A-Za-z_][\w.-]*(?:\[["'][\w.-]+["']\])*)(?P=q)
        (?:[\x20\t]*:[\x20\t]*[&*]?(?:'\w+[\x20\t]+)?[A-Za-z_][\w.<>\[\]]{0,60}(?:[\x20\t]*\|[\x20\t]*\w{1,30})?[\x20\t]+=(?!=)|\[\w{0,20}\][\x20\t]*=(?!=)|[\x20\t]*(?:[:?]=|=>|=(?!=)|:(?!:|//)))[\x20\t]*(?=[^\s=])
    |(?<=[\w.])(?:getenv|get|env|setdefault|getProperty)\([\x20\t]*["'](?P<arg>[A-Za-z_][\w.-]*)["'][\x20\t]*,[\x20\t]*(?=[bBrRuUfF]{0,2}["'])
    |\#[\x20\t]*define[\x20\t]+(?P<macro>[A-Za-z_]\w*)[\x20\t]+(?=\S)
    |<(?P<tag>[A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>(?=[^<\s])""",
    re.A | re.X,
)
_TERM = re.compile(rf"(?:[bBrRuUfF]{{1,2}}|[@$L])?(?P<s>{_STRING})|(?:new[\x20\t]+[A-Za-z_][\w.]*\((?=[\"'`]))|(?P<n>[A-Za-z_][\w.]*(?![\w.+/=-]*[0-9+/=~!@#%^&*-]))|(?P<b>[A-Za-z0-9+/_.=~!@#%^&*-]+)", re.A)
#: What joins terms: signs, alternatives, or nothing between two strings.
_JOIN = re.compile(r"[\x20\t]*(?:\+|\.\.|\|\||\?\?)[\x20\t]*|[\x20\t]+(?:\.|or)[\x20\t]+|[\x20\t]+(?=[bBrRuUfF]{0,2}[\"'])")
_ROWS = re.compile(r"\s*(?:\+\s*)?(?=[bBrRuUfF]{0,2}[\"'])")
_PAREN = re.compile(r"\(\s*(?=[bBrRuUfF]{0,2}[\"'])")
#: Calls that hand on the literals among their arguments, and the arguments of a call.
_WRAPS = frozenset("str bytes bytearray string secretstr secret b64decode decode encode unhexlify fromhex quote".split())
_ARGS = re.compile(r"\([^()\n]{0,500}\)")
_COMMA = re.compile(r"\s*,\s*")
_LIST = re.compile(r"\[\s*")
#: A block of lines after a name in YAML: its first line is the value.
_BLOCK = re.compile(r"[|>][+-]?[\x20\t]*\n[\x20\t]+(?=\S)")
_TAGGED = re.compile(r"[^<\n]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """How likely a name is that of a secret: by its parts in snake, dotted or camel case."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    parts = [p[:-1] if p.endswith("s") and p not in SENSITIVE else p for p in parts]
    parts += [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)


def strength(value: str) -> float:
    """From 0 to 1: how little a literal looks like a word or a placeholder."""
    if len(value) < MIN_LITERAL or " " in value or PLACEHOLDERS.search(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / min(4.0, math.log2(n))) * (0.5, 0.5, 0.8, 1.0, 1.0)[classes] * min(1.0, n / 12)


def may_have_hex(text: str) -> bool:
    """False only if no 16 hex digits stand in a row: then no 8 of every second character do."""
    half = _HEX_BYTE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)[::2]]
    for step in (1, 2, 4):
        half = half[:-step] & half[step:]
    return bool(half.any())


Literal = tuple[int, int, str]


class Reach:
    """What reaches one assignment: its own literals, and the assignments whose literals it takes over, held by reference."""

    __slots__ = ("taken", "own")

    def __init__(self, own: list[Literal], taken: list[Reach]) -> None:
        self.own, self.taken = own, taken


def assignments(text: str) -> Iterator[tuple[str, Reach]]:
    """Each assigned name and what reaches it, constants of earlier assignments included."""
    constants: dict[str, Reach] = {}
    for site in _SITE.finditer(text):
        name, at, own, taken = site["name"] or site["arg"] or site["macro"] or site["tag"], site.end(), [], []
        if site["tag"]:
            value = _TAGGED.match(text, at)
            own.append((*value.span(), value[0]))
            yield name, Reach(own, taken)
            continue
        join = _JOIN
        if opened := _LIST.match(text, at):
            at, join = opened.end(), _COMMA
        elif block := _BLOCK.match(text, at):
            at = block.end()
        elif opened := _PAREN.match(text, at):
            at, join = opened.end(), _ROWS
        while term := _TERM.match(text, at):
            at = term.end()
            if term["s"] is not None:
                edge = 3 if term["s"][:3] in ('"""', "'''") and len(term["s"]) >= 6 else 1
                own.append((term.start("s") + edge, term.end("s") - edge, term["s"][edge:-edge]))
            elif term["n"] is not None and term["n"] in constants:
                taken.append(constants[term["n"]])
            elif term["n"] is None and term["b"] is None:
                continue  # the call of a constructor: its first argument follows
            elif term["n"] is None or not text.startswith("(", at):
                start, end = term.span()
                bare = term[0].rstrip(".,;")
                own.append((start, end - (len(term[0]) - len(bare)), bare))
            else:  # a call: what it is made on, and the literals that it wraps
                base, _, last = term["n"].rpartition(".")
                if base in constants:
                    taken.append(constants[base])
                if args := _ARGS.match(text, at):
                    if last.lower() in _WRAPS:
                        inner = (m for m in _TERM.finditer(text, at, args.end()) if m["s"] is not None)
                        own += [(m.start("s") + 1, m.end("s") - 1, m["s"][1:-1]) for m in inner]
                    at = args.end()
            if not (more := join.match(text, at)):
                break
            at = more.end()
        if own or taken:
            constants[name] = Reach(own, taken)
            yield name, constants[name]


def reaching(found: list[tuple[float, str, Reach]]) -> Iterator[tuple[float, str, Literal]]:
    """The sensitivity and name of the first most sensitive target of each literal; every assignment is walked once."""
    seen: set[int] = set()
    for weight, name, top in sorted(found, key=lambda f: -f[0]):
        todo = [top]
        while todo:
            at = todo.pop()
            if id(at) in seen:
                continue
            seen.add(id(at))
            yield from ((weight, name, x) for x in at.own)
            todo += at.taken


def scan(text: str | None) -> list[dict]:
    """All spans of a text: kind, start, end, name, score."""
    if not text:
        return []
    low = text.lower()
    base: list[tuple] = []
    if any(r in low for r in _BASE_ROOTS):
        base += [("assign", m.start(), m.end(), m[1], 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    base += [("access", *m.span(), "", 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if may_have_hex(text):
        base += [("hex", *m.span(), "", 0.0) for m in HEX.finditer(text)]
    more: dict[tuple[int, int], tuple] = {}
    if any(r in low for r in _ROOTS):
        held = sorted((a, b, k) for k, (kind, a, b, _, _) in enumerate(base) if kind != "hex")
        targets = [(weight, name, reach) for name, reach in assignments(text) if (weight := sensitivity(name))]
        for weight, name, (start, end, value) in reaching(targets):
            score = weight * strength(value)
            if score < THRESHOLD:
                continue
            k = bisect_right(held, (start, math.inf)) - 1
            around = [held[j] for j in (k - 1, k) if j >= 0 and held[j][0] <= start and end <= held[j][1]]
            for _, _, j in around:  # a base span keeps its place, and bears the target's name and the literal's score
                if base[j][4] < score or not base[j][3]:
                    base[j] = (*base[j][:3], name, score)
            if not around and score > more.get((start, end), (0.0,))[-1]:
                more[start, end] = ("literal", start, end, name, score)
    found = sorted([*base, *more.values()], key=lambda s: (s[1], KINDS.index(s[0])))
    return [dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in found]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id and spans, an array of structs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = pa.array([scan(t.as_py()) for t in b.column("text")], SPANS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), spans], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """The spans of all documents, counted and digested."""
    found = scan_secrets(documents(spark, sf_dir))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(of(*KINDS[:3])), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(of("literal")).cast("long").alias("n_literal"),
        F.size(F.filter("spans", lambda s: s["score"] > 0)).cast("long").alias("n_scored"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: s["score"] > 0), lambda s: s["name"]))), ",").alias("names"),
        F.coalesce(F.round(F.array_max(F.transform("spans", lambda s: s["score"])), 6), F.lit(0.0)).alias("top_score"),
    )
