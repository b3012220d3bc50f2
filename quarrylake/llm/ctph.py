"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it takes a chosen residue modulo the block size, so that an
edit moves boundaries only near itself. Each chunk gives one of 64 characters. A fingerprint is
"block:characters at block:characters at twice the block". Two fingerprints are compared where their block sizes
meet, by the edit distance (insertions and deletions) of the characters.

Defined cases: a null text is an empty text with the fingerprint "3::"; a null id sorts first; rows of one id are
ordered by their text; equal texts have equal fingerprints and likeness 1; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import batch_of, read_table, scratch

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH, LEAST, WINDOW = 64, 3, 7
_FACTORS = [np.uint32(pow(0x9E3779B1, k + 1, 1 << 32)) for k in range(WINDOW)]


def rolling(data: bytes) -> np.ndarray:
    """A 32-bit hash of the seven bytes that end at each place (fewer at the start)."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    r = x * _FACTORS[0]
    for k in range(1, min(WINDOW, len(x))):
        r[k:] += x[:-k] * _FACTORS[k]
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x85EBCA6B)
    r ^= r >> np.uint32(13)
    return r


def _signature(data: bytes, ends: np.ndarray) -> str:
    """One character a chunk; the last takes what is left, so every byte counts."""
    if not data:
        return ""
    cuts = ends[: LENGTH - 1].tolist()
    out, start = [], 0
    for end in cuts:
        out.append(ALPHABET[zlib.crc32(data[start : end + 1]) >> 26])
        start = end + 1
    if start < len(data):
        out.append(ALPHABET[zlib.crc32(data[start:]) >> 26])
    return "".join(out)


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    block = LEAST
    while block * LENGTH < len(data):
        block *= 2
    if not data:
        return f"{block}::"
    rolled = rolling(data)
    while True:
        at = np.flatnonzero(rolled % np.uint32(block) == np.uint32(block - 1))
        if block == LEAST or len(at) >= LENGTH // 2:
            break
        block //= 2
    twice = at[rolled[at] % np.uint32(2 * block) == np.uint32(2 * block - 1)]
    return f"{block}:{_signature(data, at)}:{_signature(data, twice)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - distance / total length; strings that share no run of characters (of short ones, half their length) count as 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = max(1, min(WINDOW, len(a) // 2, len(b) // 2))
    seen = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in seen for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1. Block sizes must be equal or differ by a factor of two."""
    if one == other:
        return 1.0
    (b1, s1, t1), (b2, s2, t2) = (x.split(":") for x in (one, other))
    n1, n2 = int(b1), int(b2)
    if n1 == n2:
        return max(_alike(s1, s2), _alike(t1, t2) if t1 and t2 else 0.0)
    if n1 == 2 * n2:
        return _alike(s1, t2)
    if n2 == 2 * n1:
        return _alike(t1, s2)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many of the following text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_DDL = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _row(doc_id, text: str, print_: str, following: str, next_print: str) -> tuple:
    new = edited(text, following)
    new_print = print_ if new == text else fingerprint(new)
    return (0, None, doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_, new_print, likeness(print_, new_print), likeness(print_, next_print), None)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: each finds its next in the stream. The first and the last of a partition go out whole (kinds 1 and 2), for their neighbours' sake."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            out = []
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                print_ = fingerprint(text)
                if last is None:
                    out.append((1, part, doc_id, None, None, print_, None, None, None, text))
                else:
                    out.append(_row(*last, text, print_))
                last = (doc_id, text, print_)
            yield batch_of(_OUT, zip(*out)) if out else batch_of(_OUT, [[]] * len(_OUT))
    if last is not None:
        yield batch_of(_OUT, zip((2, part, last[0], None, None, last[2], None, None, None, last[1])))


_PAIR = pa.schema([f for f in _OUT if f.name not in ("kind", "part", "text")])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(*r.values())[2:9] for r in batch.to_pylist()]
        if rows:
            yield batch_of(_PAIR, zip(*rows))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near both and the next text are.

    Rows are range-partitioned by id, so the next row is in the same stream but for one row a partition; those few
    rows meet their neighbours in a small join. Nothing is sorted in one place.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done = scratch(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_walk, _DDL), "ctph")
    firsts = done.where("kind = 1")
    # one row a partition: the next partition that has rows, and around from the last to the first
    order = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    ends = done.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(order, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("next_print")), "next").select("doc_id", "text", "fingerprint", "following", "next_print")
    names = [f.name for f in _PAIR]
    ddl = ", ".join(x for x in _DDL.split(", ") if x.split()[0] in names)
    return done.where("kind = 0").select(*names).unionByName(ends.mapInArrow(_meet, ddl))


def op7_ctph(spark, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
