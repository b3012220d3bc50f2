"""Best-fit packing: hierarchical residual packing.

Documents become token ids and are cut into pieces of at most CAPACITY tokens. Full pieces are sequences at once. The
rest is packed best fit, longest first, inside each partition; bins that are nearly full leave as sequences, and the
others go up a tree: at each level the underfull bins of FAN_IN groups are items for the next round of best fit,
until one group is left. What goes up is one row a bin. A group of more than RUN bins is split by hash, so a task holds
RUN rows or so at any size; the top is packed again in other splits until a round saves less than a hundredth of its bins.

Defined cases: a null text is an empty text, whose only id is the end mark 0; a null id passes through; rows of one
id are packed as documents of their own; ties are broken by arrival; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import default_path, word_bpe
from .common import batch_of, id_text_rows, lean, lean_group, read_table, scratch

CAPACITY, NEARLY, FAN_IN = 2048, 2040, 8
#: Pieces or bins that one round of best fit holds at a time: a partition of more is packed in runs, a group in parts of as many.
RUN = 200_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("up", pa.bool_())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, up boolean"


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Longest first, each into the fullest bin that it fits: (bin, offset) of each item and the bins' fill. Bins with equal room are told apart by a bit set over rooms, so an item costs a few steps."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fill, at, offset = 0, [], [0] * len(lengths), [0] * len(lengths)
    for i in order:
        n = lengths[i]
        wide = open_ >> n
        if wide:
            room = n + (wide & -wide).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        at[i], offset[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            rooms[left].append(b)
            open_ |= 1 << left
    return at, offset, fill


def rising(fill: list[int]) -> set[int]:
    """The bins that go up a level."""
    return {b for b, f in enumerate(fill) if f < NEARLY}


def _pack(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_bpe(path)
        part = TaskContext.get().partitionId()
        made = 0
        held: list[tuple] = []
        end = np.zeros(1, np.uint32)

        def bin_id() -> int:
            nonlocal made
            made += 1
            return part << 32 | made

        def flush() -> pa.RecordBatch:
            at, offset, fill = best_fit([h[3] for h in held])
            ids = [bin_id() for _ in fill]
            up = rising(fill)
            rows = [(*h, ids[b], o, b in up) for h, b, o in zip(held, at, offset)]
            held.clear()
            return batch_of(_PIECES, zip(*rows))

        for doc_ids, texts in id_text_rows(batches, 256):
            out = []
            for doc_id, ids in zip(doc_ids, encoder.encode([t or "" for t in texts])):
                ids = np.concatenate([ids, end]).astype("<u4")
                for k, start in enumerate(range(0, len(ids), CAPACITY)):
                    piece = ids[start : start + CAPACITY]
                    row = (doc_id, k, start, len(piece), zlib.crc32(piece.tobytes()))
                    if len(piece) == CAPACITY:
                        out.append((*row, bin_id(), 0, False))
                    else:
                        held.append(row)
            if out:
                yield batch_of(_PIECES, zip(*out))
            if len(held) >= RUN:
                yield flush()
        if held:
            yield flush()

    return run


_MOVES = "bin long, into long, base long, fill long, up boolean"


def _merge_bins(table: pa.Table) -> pa.Table:
    bins, fill = table.column("bin").to_pylist(), table.column("fill").to_pylist()
    both = sorted(zip(bins, fill))
    at, base, total = best_fit([f for _, f in both])
    up = rising(total)
    name: dict[int, int] = {}
    for (b, _), t in zip(both, at):
        name.setdefault(t, b)
    return pa.table({"bin": [b for b, _ in both], "into": [name[t] for t in at], "base": base, "fill": [total[t] for t in at], "up": [t in up for t in at]}, schema=pa.schema([("bin", pa.int64()), ("into", pa.int64()), ("base", pa.int64()), ("fill", pa.int64()), ("up", pa.bool_())]))


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: where it comes from, its checksum, and its place in a sequence of at most CAPACITY tokens.

    The texts are read once; pieces without their ids are kept in the shared folder. A round moves a row a bin.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch(source.mapInArrow(lean(_pack(path or default_path())), _PIECES_DDL), "pieces")
    open_ = pieces.where("up")
    bins = open_.groupBy("bin").agg(F.sum("length").alias("fill"))
    groups = pieces.agg(F.max(F.shiftright("bin", 32))).first()[0]  # one number: the last partition's
    if groups is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    moved, level, width, more = None, 0, groups + 1, True
    left = bins
    while more:
        # the group of a bin at this level, from the partition that made it; groups of more than RUN bins are split
        width = -(-width // FAN_IN)
        group = F.shiftright("bin", 32)
        for _ in range(level + 1):
            group = F.floor(group / FAN_IN)
        left = left.select("bin", "fill", group.alias("tree"))
        size = left.groupBy(F.col("tree").alias("_tree")).agg(F.count("*").alias("_n"))
        part = F.pmod(F.xxhash64("bin", F.lit(level)), F.ceil(F.col("_n") / RUN))
        step = left.join(size, F.col("tree") == F.col("_tree")).select("bin", "fill", "tree", part.alias("grp"))
        step = scratch(step.groupBy("tree", "grp").applyInArrow(lean_group(_merge_bins), _MOVES), f"bins-{level}")
        if moved is None:
            moved = step.select("bin", "into", "base")
        else:
            there = step.select(F.col("bin").alias("_from"), F.col("into").alias("_to"), F.col("base").alias("_more"))
            moved = scratch(moved.join(there, moved["into"] == F.col("_from"), "left").select("bin", F.coalesce("_to", "into").alias("into"), (F.col("base") + F.coalesce("_more", F.lit(0))).alias("base")), f"moved-{level}")
        if width == 1:
            before, after = step.agg(F.count("*"), F.count_distinct("into")).first()
            more = before > RUN and (before - after) * 100 >= before
        left = step.where("up").groupBy(F.col("into").alias("bin")).agg(F.max("fill").alias("fill"))
        level += 1
    placed = open_.join(moved.withColumnRenamed("bin", "_bin"), F.col("bin") == F.col("_bin")).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return pieces.where("not up").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset").unionByName(placed)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
