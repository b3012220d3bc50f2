"""Quality rules: gradient-boosted trees over document statistics.

Fixed rules reject texts that are short or mostly repetition; what passes is judged by boosted trees. The trees are
fitted in numpy on the statistics of at most TRAIN_ROWS labelled rows, with monotonic constraints (more symbols,
repeated lines or repeated words never raise the verdict), and are flattened into node arrays so that a whole batch
descends level by level.

Defined cases: a null text has no words and fails the base rule; a null id passes through; labels with a null id or
quality are left out; a doc_id labelled twice counts with its lower quality, one of
several texts with that of the least digest; without labels of both kinds the trees
are empty and only the base rules decide; repeated rows are judged alike; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, id_text_rows, read_table

#: Labelled rows that the trees may be fitted on at most: those whose ids hash lowest.
TRAIN_ROWS = 20_000
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
FEATURES = ("log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "unique_share", "upper_share", "digit_share", "words_per_line", "punct_share", "top_word_share")
#: -1: the verdict must not rise with the feature.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0)
_UPPER, _DIGITS, _PUNCT = bytes(range(65, 91)), bytes(range(48, 58)), b".,!?;:"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more. Window hashes only nominate; the words decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[k : k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    pair = np.flatnonzero(same)
    equal = (windows[order[pair]] == windows[order[pair + 1]]).all(axis=1)
    hit = np.zeros(n, bool)
    if equal.all():
        hit[order[pair]] = hit[order[pair + 1]] = True
    else:  # two windows share a hash: count the windows themselves
        count: dict[bytes, int] = {}
        keys = [windows[i].tobytes() for i in range(n)]
        for k in keys:
            count[k] = count.get(k, 0) + 1
        hit[:] = [count[k] > 1 for k in keys]
    mark = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + WINDOW, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of the trees."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, [0.0] * len(FEATURES)
    in_words = sum(map(len, words))
    chars = len(text) - (len(raw) - in_words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    gone = lambda which: (len(raw) - len(raw.translate(None, which))) / in_words
    features = [float(np.log1p(n)), chars / n, symbols / n, dup / max(1, len(lines)), repeat / n, len(count) / n, gone(_UPPER), gone(_DIGITS), n / max(1, len(lines)), gone(_PUNCT), max(count.values()) / n]
    return n, chars, symbols, dup, repeat, features


@dataclass
class Trees:
    """Node arrays, one row a tree: feature (-1 at leaves), threshold, children and value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.feature):
            return total
        tree, node = np.arange(len(self.feature)), np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            v = np.take_along_axis(x, np.maximum(f, 0), axis=1)
            step = np.where(v <= self.threshold[tree, node], self.left[tree, node], self.right[tree, node])
            node = np.where(f < 0, node, step)
        return total + self.value[tree, node].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 5.0, monotone: tuple = MONOTONE) -> Trees:
    """Logistic boosting on binned features. A split that breaks a constraint is not taken; the children's values are bounded by the middle of the split above, so the whole tree keeps the constraint."""
    nodes = 2 ** (depth + 1) - 1
    if len(y) < 20 or y.min() == y.max():
        z = np.zeros((0, nodes))
        return Trees(0.0, z.astype(int), z, z.astype(int), z.astype(int), z, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    base = float(margin[0])
    out = [np.full((rounds, nodes), -1), np.zeros((rounds, nodes)), np.zeros((rounds, nodes), int), np.zeros((rounds, nodes), int), np.zeros((rounds, nodes))]
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        where = np.zeros(len(y), int)
        bound = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            if node not in bound:
                continue
            rows = np.flatnonzero(where == node)
            lo, hi = bound[node]
            gs, hs = g[rows].sum(), h[rows].sum()
            out[4][t, node] = rate * np.clip(gs / (hs + ridge), lo, hi)
            if 2 * node + 2 >= nodes or hs < 2 * 1e-3 or len(rows) < 2 * least:
                continue
            best = (1e-6, None)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = np.clip(gl / (hl + ridge), lo, hi), np.clip((gs - gl) / (hs - hl + ridge), lo, hi)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                ok = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * monotone[j] >= 0)
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                continue
            j, k, vl, vr = best[1]
            out[0][t, node], out[1][t, node], out[2][t, node], out[3][t, node] = j, edges[j][k], 2 * node + 1, 2 * node + 2
            go = binned[rows, j] > k
            where[rows] = np.where(go, 2 * node + 2, 2 * node + 1)
            mid = (vl + vr) / 2
            bound[2 * node + 1] = (lo, hi) if not monotone[j] else ((lo, mid) if monotone[j] > 0 else (mid, hi))
            bound[2 * node + 2] = (lo, hi) if not monotone[j] else ((mid, hi) if monotone[j] > 0 else (lo, mid))
        margin += out[4][t, where]
    return Trees(base, *out, depth)


_STATS = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("features", pa.list_(pa.float64()))])
_STATS_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in id_text_rows(batches):
        yield batch_of(_STATS, [ids, *zip(*map(statistics, texts))])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its counts and features. One scan, no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics, _STATS_DDL)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fits the trees. The labelled sample is bounded by rows, so it may be broadcast and its statistics collected."""
    sample = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select(F.col("doc_id"))), "doc_id", "left_semi")
    # of several texts of an id the one of the least digest, so that reruns fit the same trees
    chosen = chosen.groupBy("doc_id").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    found = document_statistics(chosen).select("doc_id", "features").join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("features", "quality").toPandas()
    x = np.array(found["features"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["quality"].to_numpy(float))


def quality_verdicts(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """Counts, base_failed, the trees' probability of good quality and kept, per row."""
    out = pa.schema([*[f for f in _STATS if f.name != "features"], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality_score", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_text_rows(batches):
            *counts, features = zip(*map(statistics, texts))
            n, repeat = np.array(counts[0]), np.array(counts[4])
            failed = (n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n)
            score = 1 / (1 + np.exp(-trees.score(np.array(features))))
            kept = ~failed & (score >= threshold) if len(trees.feature) else ~failed
            yield batch_of(out, [ids, *counts, failed, kept, score])

    ddl = _STATS_DDL.replace("features array<double>", "base_failed boolean, kept boolean, quality_score double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, ddl)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_verdicts(docs, train(docs, read_table(spark, sf_dir, "labels")))
