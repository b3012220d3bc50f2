"""Secret scans: multipart credential linking.

Strong patterns (key assignments, access-key identifiers, long hex runs) are always reported. Weak parts (user or
client identifiers, random-looking tokens, endpoints) are reported only when complementary parts meet in a scope: a
random token counts only beside an identifier, an identifier only beside a secret, an endpoint only beside both.

A scope is a paragraph, an interval of the text between blank lines. Identifiers, secrets and endpoints are intervals
too; one sweep over all in order of their starts joins each part with the scope that holds it, so a text costs the
sort of its parts, however many lie in one scope.

Defined cases: a null text is an empty text and has no spans; a null doc_id passes through; repeated rows are
scanned alike; columns other than the id and the text are not read, so clashing names do no harm; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, id_text_rows

KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
MIN_ENTROPY = 3.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""(?:client_?id|access_?key(?:_?id)?|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.I | re.A)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{4,}""", re.I | re.A)
_PARAGRAPH = re.compile(r"\n[\x20\t]*\n")
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_IDENT_HINTS = (b"client", b"access", b"account", b"user", b"login")
#: Hex digits to x, all else to a space: a run of 24 hex digits becomes a substring search.
_HEX_MAP = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


def _random_looking(token: str) -> bool:
    """At least three classes of characters (or two and a digit) and the entropy of a generated key."""
    classes = bool(re.search("[a-z]", token)) + bool(re.search("[A-Z]", token)) + bool(re.search("[0-9]", token)) + bool(re.search("[+/_=-]", token))
    if classes < 3:
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= MIN_ENTROPY


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong patterns, code points, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    out = []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


Span = tuple[int, int, str]


def scopes_of(text: str) -> list[tuple[int, int]]:
    """The paragraphs, in order."""
    cuts = [0, *(k for m in _PARAGRAPH.finditer(text) for k in m.span()), len(text)]
    return list(zip(cuts[::2], cuts[1::2]))


def interval_join(scopes: list[tuple[int, int]], parts: list[Span]) -> Iterator[tuple[int, list[Span]]]:
    """(scope's place, its parts by start) of the scopes that hold any; scopes are disjoint. One sweep over both."""
    parts = sorted(parts)
    at = 0
    for k, (lo, hi) in enumerate(scopes):
        while at < len(parts) and parts[at][0] < lo:
            at += 1
        start = at
        while at < len(parts) and parts[at][0] < hi:
            at += 1
        if at > start:
            yield k, parts[start:at]


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of taken. Both are swept by start; reach is the farthest end of taken so far."""
    spans, taken = sorted(spans), sorted(taken)
    out, at, reach = [], 0, -1
    for s, e, kind in spans:
        while at < len(taken) and taken[at][0] <= s:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= s and not (at < len(taken) and taken[at][0] < e):
            out.append((s, e, kind))
    return out


def linked_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts whose scopes hold complementary parts. Tokens and endpoints are looked for only in scopes of an identifier."""
    low = text.encode("utf-8", "surrogatepass").lower()
    idents = [(m.start(1), m.end(1), "link_id") for m in _IDENT.finditer(text)] if any(h in low for h in _IDENT_HINTS) else []
    if not idents and not any(k == "access" for _, _, k in strong):
        return []
    scopes = scopes_of(text)
    found: list[Span] = []
    for k, held in interval_join(scopes, [*idents, *strong]):
        kinds = {kind for _, _, kind in held}
        if not kinds & {"link_id", "access"}:
            continue
        lo, hi = scopes[k]
        here = [x for x in held if x[2] != "link_id"]
        names = [x for x in held if x[2] == "link_id"]
        tokens = [(*m.span(), "link_secret") for m in _TOKEN.finditer(text, lo, hi) if _random_looking(m.group())]
        tokens = apart(tokens, here + names)
        if not tokens and not kinds & {"assign", "hex"}:
            continue
        found += tokens + apart(names, here)
        found += apart([(*m.span(), "link_endpoint") for m in _ENDPOINT.finditer(text, lo, hi)], here)
    return found


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, each by start, then kind in the order of KINDS."""
    order = {k: i for i, k in enumerate(KINDS)}
    key = lambda x: (x[0], order[x[2]], x[1])
    base = sorted(base_spans(text or ""), key=key)
    return base, sorted(base + linked_spans(text or "", base), key=key)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_OUT = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in id_text_rows(batches):
        yield batch_of(_OUT, [ids, [[{"kind": k, "start": s, "end": e} for s, e, k in scan_text(t)[1]] for t in texts]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the spans found, as array<struct<kind, start, end>>. One scan, no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, "id long, spans array<struct<kind:string,start:long,end:long>>")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    base = F.filter("spans", lambda x: x.kind.isin(*KINDS[:3]))
    return found.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
