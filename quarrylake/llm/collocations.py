"""Phrase collocation mining: depth-limited count tries of each shard, merged by prefix range.

A shard is a few megabytes of text. Its trie of four levels is built from the windows of four words that start at each
word: sorted, equal windows counted, every window written only from the level on at which it leaves the one before. That
is the trie in depth-first order, with counts at its leaves. It is cut at the boundaries of the prefix ranges and sent as
one row a range. Each range merges the sorted tries of all shards and sums counts along prefixes, so that each node has
its phrase's count. Boundaries are windows of a sample, so a frequent word, or pair, or triple, is cut like any other stretch
of the order; the nodes that lie on a boundary are sent from both sides and summed afterwards.

What occurs 30 times or more, and the spine along the boundaries, becomes a table of nodes. A part of a frequent phrase is as
frequent, so this table has all parts: a phrase's left part is its node's ancestor (a walk), its right part the node that its
suffix link (the key without the first words) points to; both are joins of the table with itself.

There are RANGES ranges at most. Beyond RANGES times RANGE_BYTES of text, ranges are also dealt by a hash of the first two
words, so a task's share does not grow with the input; the sample and its boundaries stay as they are.

Defined cases: a null text is empty; a null lang is "und"; only A-Z are lowered; a piece ends at . , ; : ! ? and line
ends, so that no phrase crosses them or a document's end; a repeated row counts again; ids and other columns are not read;
an empty table, or one without frequent phrases, gives no rows. Counts are 64-bit, products decimals of 38 digits.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import batch_of, give_back, lean, read_table, scratch

DEPTH = 4
LEAST, TOP = 30, 2000
#: Bytes of text a shard and a range; ranges at most; windows in the sample of boundaries, and documents in it, about.
SHARD_BYTES, RANGE_BYTES, RANGES = 4 << 20, 4 << 20, 4096
SAMPLE_WINDOWS, SAMPLE_DOCS = 1 << 15, 4096

_WORD, _BLANK, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _END

_SHARD = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("sub", pa.int64()), ("trie", pa.binary())])
_NODES = pa.schema([("lang", pa.string()), ("depth", pa.int32()), ("phrase", pa.binary()), ("n", pa.int64())])
_SAMPLE = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.binary()))])

Boundaries = dict[str, list[tuple[bytes, ...]]]


def word_windows(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The sorted distinct words of texts; of each word the windows that start there, as numbers of words from 1 (0: the piece has ended); and the text it is in."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    empty = pa.array([], pa.large_binary()), np.zeros((DEPTH, 0), np.int64), np.zeros(0, np.int64)
    if not len(texts):
        return empty
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    in_word = kind == _WORD
    start = in_word.copy()
    start[1:] &= ~in_word[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] |= in_word[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return empty
    lengths = np.add.reduceat(in_word, starts, dtype=np.int64)
    low = data[in_word]
    low = low + np.uint8(32) * ((low >= 65) & (low <= 90))
    places = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(low)]).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    ids = rank[words.indices.to_numpy()]
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == _END)[starts] + text
    windows = np.zeros((DEPTH, len(ids)), np.int64)
    windows[0] = ids
    for k in range(1, DEPTH):
        same = piece[k:] == piece[:-k]
        windows[k, : len(ids) - k][same] = ids[k:][same]
    return words.dictionary.take(pa.array(order)), windows, text


def _keys(windows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return windows[0] << bits | windows[1], windows[2] << bits | windows[3]


def sorted_leaves(windows: np.ndarray, counts: np.ndarray | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order and how often each is there. Sorted runs are merged, not sorted again."""
    high, low = _keys(windows, words.bit_length())
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    at = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(order) else np.zeros(0, np.int64)
    if counts is None:
        n = np.diff(np.append(at, len(order)))
    else:
        n = np.add.reduceat(counts[order], at) if len(at) else counts
    return windows[:, order[at]], n


def _leaves_prefix(windows: np.ndarray) -> list[np.ndarray]:
    """Of each level: where a window has another prefix of that length than the one before."""
    out, changed = [], np.zeros(windows.shape[1], bool)
    if windows.shape[1]:
        changed[0] = True
    for level in windows:
        changed = changed.copy()
        changed[1:] |= level[1:] != level[:-1]
        out.append(changed)
    return out


def _lists(values: dict[str, pa.Array]) -> bytes:
    lists = [pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), v) for v in values.values()]
    batch = pa.RecordBatch.from_arrays(lists, names=list(values))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack_trie(words: pa.Array, windows: np.ndarray, counts: np.ndarray) -> bytes:
    """A trie of sorted distinct windows: words in it, the new nodes of each level, counts of leaves."""
    used = np.unique(windows)
    used = used[used > 0]
    number = np.zeros(len(words) + 1, np.int32)
    number[used] = np.arange(1, len(used) + 1)
    values = {"words": words.take(pa.array(used - 1)), "n": pa.array(counts)}
    for d, changed in enumerate(_leaves_prefix(windows)):
        values |= {f"at{d}": pa.array(np.packbits(changed)), f"w{d}": pa.array(number[windows[d][changed]])}
    return _lists(values)


def unpack_trie(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    get = lambda k: batch.column(k).values
    counts = get("n").to_numpy()
    windows = np.empty((DEPTH, len(counts)), np.int64)
    for d in range(DEPTH):
        at = np.unpackbits(get(f"at{d}").to_numpy(), count=len(counts)).astype(np.int64)
        windows[d] = get(f"w{d}").to_numpy()[np.cumsum(at) - 1] if len(counts) else 0
    return get("words"), windows, counts


def _cut_places(words: pa.Array, windows: np.ndarray, boundaries: list[tuple[bytes, ...]]) -> list[int]:
    """Where in the order of windows each boundary falls. A word gets an even number, one that is not there the odd one between its neighbours."""
    if not boundaries:
        return []
    asked = pa.array([w for b in boundaries for w in b], pa.large_binary())
    spots = pc.index_in(asked, words).to_pylist()
    have = words.to_pylist()
    number = iter([2 * s + 2 if s is not None else 2 * bisect.bisect_left(have, w) + 1 for s, w in zip(spots, asked.to_pylist())])
    bits = (2 * len(have) + 2).bit_length()
    high, low = _keys(windows * 2, bits)
    out = []
    for b in boundaries:
        p = [next(number) for _ in b]
        p = np.array([*p, *[0] * (DEPTH - len(p))], np.int64)
        absent = np.flatnonzero(p % 2)
        if len(absent):
            p[absent[0] + 1 :] = 0
        h, lo = p[0] << bits | p[1], p[2] << bits | p[3]
        i, j = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
        out.append(int(i + np.searchsorted(low[i:j], lo, "left")))
    return out


def shard_tries(texts: pa.Array, langs: list[str], boundaries: Boundaries, subs: int) -> Iterator[tuple[str, int, int, bytes]]:
    """(lang, range, sub, trie) of one shard."""
    words, windows, text = word_windows(texts)
    number = {lang: i for i, lang in enumerate(sorted(set(langs)))}
    of = np.array([number[x] for x in langs], np.int64)[text] if len(langs) else text
    hashes = np.array([0, *(zlib.crc32(w) for w in words.to_pylist())], np.int64) if subs > 1 else None
    for lang, i in number.items():
        leaves, counts = sorted_leaves(windows[:, of == i], None, len(words))
        cuts = [0, *_cut_places(words, leaves, boundaries.get(lang, [])), leaves.shape[1]]
        for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b:
                continue
            part, n = leaves[:, a:b], counts[a:b]
            if hashes is None:
                yield lang, r, 0, pack_trie(words, part, n)
                continue
            sub = (hashes[part[0]] * 1_000_003 + hashes[part[1]]) % subs
            for s in np.unique(sub):
                yield lang, r, int(s), pack_trie(words, part[:, sub == s], n[sub == s])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(texts, langs) of about SHARD_BYTES; a longer text stands alone."""
    texts, langs, size = [], [], 0
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
        at = 0
        for i, n in enumerate(sizes):
            if size and size + n > SHARD_BYTES:
                texts.append(column.slice(at, i - at))
                langs += batch.column("lang").slice(at, i - at).to_pylist()
                yield pa.concat_arrays(texts), langs
                texts, langs, size, at = [], [], 0, i
            size += n
        texts.append(column.slice(at))
        langs += batch.column("lang").slice(at).to_pylist()
    if langs:
        yield pa.concat_arrays(texts), langs


def _merged(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One trie of many: their words, windows and counts."""
    parts = [unpack_trie(b) for b in blobs]
    every = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    order = pc.sort_indices(every.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    ids, at, windows = rank[every.indices.to_numpy()], 0, []
    for words, w, _ in parts:
        windows.append(np.concatenate([[0], ids[at : at + len(words)]])[w])
        at += len(words)
    leaves, counts = sorted_leaves(np.concatenate(windows, axis=1), np.concatenate([p[2] for p in parts]), len(order))
    return every.dictionary.take(pa.array(order)), leaves, counts


def range_nodes(blobs: list[bytes], least: int, all_words: bool) -> Iterator[tuple[int, bytes, int]]:
    """(depth, phrase, count) of a range's nodes of least at least, of its first and last paths, of its words where all_words; depth 0: all windows."""
    words, leaves, counts = _merged(blobs)
    name = words.to_pylist()
    yield 0, b"", int(counts.sum())
    for d, changed in enumerate(_leaves_prefix(leaves)):
        at = np.flatnonzero(changed)
        n = np.add.reduceat(counts, at)
        keep = n >= least
        keep[[0, -1]] = True
        if all_words and d == 0:
            keep[:] = True
        keep &= leaves[d, at] > 0
        for path, total in zip(leaves[: d + 1, at[keep]].T.tolist(), n[keep].tolist()):
            yield d + 1, b" ".join(name[i - 1] for i in path), total


def _boundaries(docs: DataFrame, rows: int, size: int, ranges: int) -> Boundaries:
    """Windows of a sample at equal distances, by language."""
    if ranges < 2 or not rows:
        return {}
    share = min(1.0, SAMPLE_DOCS / rows)
    step = max(1, int(size * share / 6 / SAMPLE_WINDOWS))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _slices(batches):
            words, windows, text = word_windows(texts)
            name = words.to_pylist()
            some = range(step // 2, windows.shape[1], step)
            yield batch_of(_SAMPLE, [[langs[text[i]] for i in some], [[name[w - 1] for w in windows[:, i] if w] for i in some]])

    found = defaultdict(list)
    for r in docs.sample(share, seed=1).mapInArrow(lean(take), "lang string, path array<binary>").collect():
        found[r["lang"]].append(tuple(bytes(w) for w in r["path"]))
    total = sum(map(len, found.values()))
    out = {}
    for lang, paths in found.items():
        paths.sort()
        n = max(1, round(ranges * len(paths) / total))
        out[lang] = sorted({paths[len(paths) * k // n] for k in range(1, n)})
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, range_bytes: int = RANGE_BYTES, most_ranges: int = RANGES) -> DataFrame:
    """(lang, depth, phrase, f): phrases of one to four words that occur least times or more; depth 0 has all words of a language. Written to the shared folder."""
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text"))
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = -(-size // range_bytes)
    ranges = max(1, min(most_ranges, wanted))
    subs = max(1, -(-wanted // ranges))
    boundaries = _boundaries(texts, rows, size, ranges)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs in _slices(batches):
            for row in shard_tries(part, langs, boundaries, subs):
                yield batch_of(_SHARD, [[x] for x in row])
            give_back()

    def merge(table: pa.Table) -> pa.Table:
        nodes = list(range_nodes(table.column("trie").to_pylist(), least, subs > 1))
        lang = table.column("lang")[0].as_py()
        out = pa.Table.from_batches([batch_of(_NODES, [[lang] * len(nodes), *(list(c) for c in zip(*nodes))])])
        give_back()
        return out

    tries = texts.mapInArrow(lean(build), "lang string, range int, sub long, trie binary")
    nodes = tries.groupBy("lang", "range", "sub").applyInArrow(merge, "lang string, depth int, phrase binary, n long")
    summed = nodes.groupBy("lang", "depth", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))
    return scratch(summed.where((F.col("f") >= least) | (F.col("depth") == 0)), "phrase-counts")


def _part(at: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", at, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **ranges: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first of each language."""
    counts = phrase_counts(docs, least, **ranges)
    nodes = counts.where("depth > 0").select("lang", "phrase", "f")
    words = counts.where("depth = 0").select("lang", F.col("f").alias("n"))
    candidates = counts.where("depth > 1").select("lang", "phrase", "depth", F.col("f").alias("a")).withColumn("w", F.split("phrase", " "))
    # walks give the left parts, suffix links the right parts
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("depth") - F.col("k")).alias("right"))
    cuts = cuts.join(nodes.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(nodes.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    # phrases inside longer ones
    inner = candidates.where("depth > 2").select("lang", "a", "w", "depth", F.explode(F.expr("flatten(transform(sequence(2, depth - 1), m -> transform(sequence(1, depth - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where("longer is null or cast(longer as decimal(38,0)) * 100 < cast(a as decimal(38,0)) * 80")
    # the first of each language, first among those of one hash
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The rows of op12_collocations in one piece.
OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A\\x0B\\x0C\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3), (4)) v(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.f AS a, k.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(k.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT c.lang, c.f, array_to_string(c.w[i:i + j - 1], ' ') AS phrase FROM c, range(2, 4) q(j), range(1, 4) z(i) WHERE j < c.m AND i + j - 1 <= c.m),
x AS (SELECT lang, phrase, max(f) AS longer FROM u GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.longer IS NULL OR 100 * x.longer < 80 * b.a)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))
