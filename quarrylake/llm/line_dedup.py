"""Line dedup: content-defined line chunks.

The lines of a text are hashed; a rolling hash over the last SPAN line hashes ends a chunk where its low bits are
zero, so boundaries depend on nearby lines only and shift with them. A line of LONG_WORDS words or more is a chunk of
its own (also a boundary that content alone decides). A chunk of MIN_LINES lines or of one such long line that occurs
again anywhere in the corpus is removed from all places but its first (lowest id, then place). Hashes only nominate:
the bytes of all places of a chunk are compared before anything is removed, and a chunk whose places differ stays.

dedup_lines() removes chunks only. dedup_passages(), the query and the pipeline's stage, also removes every run of
adjacent lines of LONG_WORDS words or more together that stands at an earlier place (id, then line), wherever chunks
end. The least such runs from each line on and up to each line are keyed like chunks: those inside a repeated run cover
all of its lines. Where a copy overlaps its own first place, the lines of the first place stay.

A place belongs to a row by its id and a digest of its text, so rows that share an id but not their text are told apart,
and only rows whose bytes were searched lose lines. Rows without an id come last in order, by their text's digest.

Defined cases: a null text has no lines and stays null; a text all of whose chunks go becomes empty; a chunk of white
space only is never removed; rows equal in id and text are one place, share their decisions and stay alike; all columns
of the input are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import BoundedBloom, batch_of, id_text_rows, lean, scratch

SPAN, BITS, MIN_LINES, LONG_WORDS = 2, 1, 2, 50


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk."""
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    long_ = [x.count(b" ") >= LONG_WORDS - 1 and len(x.split()) >= LONG_WORDS for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if long_[i]:
            if i > start:
                out.append((start, i))
            out.append((i, i + 1))
            start = i + 1
        elif i - start + 1 >= MIN_LINES:
            rolled = 0
            for h in hashes[i - SPAN + 1 : i + 1]:
                rolled = (rolled * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
            rolled ^= rolled >> 32
            if not (rolled * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS):
                out.append((start, i + 1))
                start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def removable(text: str | None) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first line, line after the last, key, bytes) of the chunks that may go."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    if len(lines) == 1 and len(lines[0]) < 2 * LONG_WORDS - 1:
        return
    for a, b in chunks(lines):
        raw = b"\n".join(lines[a:b])
        if (b - a >= MIN_LINES or len(raw.split()) >= LONG_WORDS) and raw and not raw.isspace():
            yield a, b, xxhash.xxh3_128_digest(raw), raw


def runs(words: list[int]) -> set[tuple[int, int]]:
    """(first line, line after the last) of the least runs of LONG_WORDS words from each line on and up to each line; words has the words of each line."""
    sums = [0, *accumulate(words)]
    out = set()
    for i in range(len(words)):
        end = bisect_left(sums, sums[i] + LONG_WORDS)
        if end < len(sums):
            out.add((i, end))
        if sums[i + 1] >= LONG_WORDS:
            out.add((bisect_right(sums, sums[i + 1] - LONG_WORDS) - 1, i + 1))
    return out


def passages(text: str | None) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Of the chunks and the least runs that may go, as removable()."""
    held = set()
    for a, b, key, raw in removable(text):
        held.add((a, b))
        yield a, b, key, raw
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    for a, b in runs([len(x.split()) for x in lines]) - held:
        raw = b"\n".join(lines[a:b])
        yield a, b, xxhash.xxh3_128_digest(raw), raw


Spans = Callable[[str | None], Iterator[tuple[int, int, bytes, bytes]]]
_PLACES = pa.schema([("id", pa.int64()), ("row", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("key", pa.binary())])
_BYTES = pa.schema([("key", pa.binary()), ("bytes", pa.binary())])


def _places(spans: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, texts, rows = (batch.slice(at, 512).column(k).to_pylist() for k in range(3))
                out = [(i, row, a, b, key) for i, t, row in zip(ids, texts, rows) for a, b, key, _ in spans(t)]
                if out:
                    yield batch_of(_PLACES, zip(*out))

    return run


def _row(docs: DataFrame) -> Column:
    """What tells a row from others: its text's digest, and a mark of its id."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.col("text")).cast("binary")))


def _nominated(bloom: BoundedBloom, spans: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in id_text_rows(batches, 1024):
            held: dict[tuple[bytes, bytes], None] = {}
            size = 0
            for t in texts:
                for _, _, key, raw in spans(t):
                    if bloom.has(key) and (key, raw) not in held:
                        held[(key, raw)] = None
                        size += len(raw)
                if size > 4 << 20:
                    yield batch_of(_BYTES, zip(*held))
                    held, size = {}, 0
            if held:
                yield batch_of(_BYTES, zip(*held))

    return run


def cuts(docs: DataFrame, spans: Spans = removable) -> DataFrame:
    """id, row (as _row) -> the line ranges to remove, array<struct<a, b>>, for the rows that lose any."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row(docs).alias("row"))
    places = scratch(rows.mapInArrow(lean(_places(spans)), "id long, row binary, a int, b int, key binary"), "line-places")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row", "a")
    repeated = scratch(places.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("key", F.col("first.row").alias("first_row"), F.col("first.a").alias("first_a")), "line-repeated")
    bloom = BoundedBloom.of(repeated, "key")
    agreed = rows.select("doc_id", "text").mapInArrow(lean(_nominated(bloom, spans)), "key binary, bytes binary").groupBy("key").agg((F.min("bytes") == F.max("bytes")).alias("same")).where("same").select("key")
    # a table of its own: places meet it in a join of two exchanges, which Spark broadcasts if small and splits where a chunk is hot
    sure = scratch(repeated.join(agreed, "key"), "line-sure")
    gone = places.join(sure, "key").where("row <> first_row or a <> first_a")
    # a copy that overlaps its first place begins after it; equal bytes have equally many lines
    gone = gone.withColumn("a", F.when(F.col("row") == F.col("first_row"), F.greatest("a", F.col("first_a") + F.col("b") - F.col("a"))).otherwise(F.col("a")))
    return gone.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_set(F.struct("a", "b"))).alias("cuts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with the repeated chunks cut out of text, all other columns as they are."""
    return _without(docs, cuts(docs))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """As dedup_lines(), with the repeated runs of adjacent lines of LONG_WORDS words or more cut out as well."""
    return _without(docs, cuts(docs, passages))


def _without(docs: DataFrame, cut: DataFrame) -> DataFrame:
    schema = docs.schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(batch.num_columns - 1)
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            if marked.null_count < batch.num_rows:
                at = kept.schema.names.index("text")
                texts = kept.column(at).to_pylist()
                for i, ranges in enumerate(marked.to_pylist()):
                    if ranges and texts[i] is not None:
                        gone = {k for r in ranges for k in range(r["a"], r["b"])}
                        texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
                columns = list(kept.columns)
                columns[at] = pa.array(texts, kept.schema.field(at).type)
                kept = pa.RecordBatch.from_arrays(columns, names=kept.schema.names)
            yield kept

    cut = cut.select(F.col("row").alias("__line_row"), F.col("cuts").alias("__line_cuts"))
    joined = docs.join(cut, _row(docs) == F.col("__line_row"), "left").select(*[docs[c] for c in docs.columns], "__line_cuts")
    return joined.mapInArrow(lean(rebuild), schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, its length and what was cut."""
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs.withColumn("n_before", F.coalesce(F.length("text"), F.lit(0)).cast("long"))).select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), (F.col("n_before") - F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_cut"))
