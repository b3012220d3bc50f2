"""LM scoring: masked pseudo-likelihood.

Every word is predicted from the words on both sides. A word's place among all words is a path of LEVELS digits: all
but the last a hash of its ending, so that like words are near, the last a hash of the word. A network in numpy with a
window of two words to either side (an embedding for each place and ending, a hidden layer) gives each digit's
probability after the digits before it: the hidden layer is scaled by the first two of them, and a softmax over DIGITS
follows. The words that share a whole path have their shares of its corpus count.
So log P(word | both sides) = sum of the digits' log-probabilities + log n(word) - log n(path), a distribution over all
words of the corpus, and a document's score is the sum over its words. The softmaxes' offsets are the corpus counts of
the paths: a network that says nothing is the unigram model of all words.

Everything is learned from all documents. Every word is counted, in a table of the corpus's words. The network sees each
document once, in ROUNDS rounds; a document's round and shard are a hash of its id and text, a shard's documents are in
order of that hash, and the shards of a round start from the same parameters, which are then averaged by words. So the
result is a function of the rows, not of how they are partitioned. Shards hold SHARD words or so: their number grows with
the corpus. The KEPT most frequent words' counts are known to every task, all other counts are joined by word; which
words are kept changes no score.

Defined cases: a null or blank text has no words, score 0 and a null mean; a null id passes through; repeated rows
score alike (and count as often as they occur); a word that the counts do not have counts as half a word; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_of, id_text_rows, most_frequent, read_table, scratch

SIDES, HIDDEN, DIGITS, LEVELS = (-2, -1, 1, 2), 16, 16, 4
#: A word's ending is its last ENDING bytes, one of ENDINGS hashes; EDGE is what is beyond a text's ends.
ENDING, ENDINGS, LEAVES = 3, DIGITS ** (LEVELS - 1), DIGITS**LEVELS
EDGE = ENDINGS
ROUNDS, SHARD, BATCH, RATE, FAN_IN, LEAST = 4, 1 << 20, 4096, 0.1, 32, 0.1
#: Words whose windows a shard holds at a time.
CHUNK = 1 << 17
KEPT, COUNTED, KNOWN = 1 << 16, 100_000, 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Keys(dict):
    """Word -> key: 12 bits of its ending's hash, 52 of its own; the first 16 are its path. Bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        key = self[word] = xxhash.xxh3_64_intdigest(word[-ENDING:]) % ENDINGS << 52 | xxhash.xxh3_64_intdigest(word) >> 12
        return key


_KEYS = _Keys()


def keys_of(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_KEYS.__getitem__, words), np.uint64, len(words))


def paths_of(keys: np.ndarray) -> np.ndarray:
    """The paths, which are all that the network needs."""
    return (keys >> np.uint64(48)).astype(np.uint16)


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(endings at each of SIDES, path) of all words of the texts, given as paths; beyond a text's ends is EDGE."""
    reach = max(SIDES)
    sizes = np.array([len(d) for d in docs])
    flat = np.full(int(sizes.sum()) + reach * (len(docs) + 1), EDGE, np.int32)
    at = np.arange(int(sizes.sum())) + reach * (1 + np.repeat(np.arange(len(docs)), sizes))
    path = np.concatenate(docs).astype(np.int32)
    flat[at] = path >> 4
    return np.stack([flat[at + k] for k in SIDES]), path


class Prior:
    """Corpus counts of the paths: log-shares of the digits after each beginning of a path, and log n of whole paths."""

    def __init__(self, counts: np.ndarray):
        self.leaf = np.log(np.maximum(counts, 0.5))
        n = counts + LEAST
        self.levels = []
        for _ in range(LEVELS):
            n = n.reshape(-1, DIGITS)
            self.levels.append(np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))
            n = n.sum(axis=1)
        self.levels.reverse()


class Network:
    """Parameters: embeddings for each place, hidden bias, scales by the first and the first two digits, output weights of each level."""

    SHAPES = (*[(ENDINGS + 1, HIDDEN)] * len(SIDES), (HIDDEN,), (DIGITS, HIDDEN), (DIGITS**2, HIDDEN), *[(HIDDEN, DIGITS)] * LEVELS)

    def __init__(self, parts: list[np.ndarray], prior: Prior):
        self.parts, self.prior = parts, prior
        k = len(SIDES)
        self.embeddings, self.bias, self.scales, self.weights = parts[:k], parts[k], parts[k + 1 : k + 3], parts[k + 3 :]

    @classmethod
    def start(cls, prior: Prior, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        k = len(SIDES)
        embeddings = [draw.normal(0, 0.1, s) for s in cls.SHAPES[:k]]
        middle = [np.zeros(cls.SHAPES[k]), *[np.ones(s) for s in cls.SHAPES[k + 1 : k + 3]]]
        weights = [draw.normal(0, 0.05, s) for s in cls.SHAPES[k + 3 :]]
        return cls([p.astype(np.float32) for p in (*embeddings, *middle, *weights)], prior)

    def pack(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts]).astype("<f4").tobytes()

    @classmethod
    def unpack(cls, flat: np.ndarray, prior: Prior) -> Network:
        cuts = np.cumsum([int(np.prod(s)) for s in cls.SHAPES])[:-1]
        return cls([p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, cuts), cls.SHAPES)], prior)

    def forward(self, context: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, list, list, np.ndarray]:
        """Hidden values, their scales (rows, values), what each level saw, and the log-probability of each path."""
        hidden = self.bias + self.embeddings[0][context[0]]
        for e, c in zip(self.embeddings[1:], context[1:]):
            hidden += e[c]
        np.tanh(hidden, out=hidden)
        scaled = [(at, t[at]) for t, at in zip(self.scales, (path >> 12, path >> 8))]
        inputs = [hidden, *(hidden * s for _, s in scaled)]
        rows, ones, seen = np.arange(len(path)), np.ones(DIGITS, hidden.dtype), []
        total = np.zeros(len(path), hidden.dtype)
        for level, (weight, offset) in enumerate(zip(self.weights, self.prior.levels)):
            digit = path >> 4 * (LEVELS - 1 - level) & DIGITS - 1
            h = inputs[min(level, 2)]
            z = h @ weight
            z += offset[path >> 4 * (LEVELS - level)] if level else offset
            np.minimum(z, 60, out=z)
            total += z[rows, digit]
            np.exp(z, out=z)
            norm = z @ ones
            total -= np.log(norm)
            seen.append((h, z, norm, digit))
        return hidden, scaled, seen, total

    def gradient(self, context: np.ndarray, path: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
        """(rows, slope of the summed log-probability there) of each part."""
        hidden, scaled, seen, _ = self.forward(context, path)
        rows, weights = np.arange(len(path)), []
        back = [np.zeros_like(hidden) for _ in range(3)]
        for level, ((h, z, norm, digit), weight) in enumerate(zip(seen, self.weights)):
            z *= (-1 / norm)[:, None]
            z[rows, digit] += 1
            weights.append((slice(None), h.T @ z))
            back[min(level, 2)] += z @ weight.T
        scales = [_by_row(at, g * hidden) for g, (at, _) in zip(back[1:], scaled)]
        whole = back[0]
        for g, (_, s) in zip(back[1:], scaled):
            whole += g * s
        whole *= 1 - hidden * hidden
        return [*[_by_row(c, whole) for c in context], (slice(None), whole.sum(axis=0)), *scales, *weights]


def _by_row(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(at.astype(np.uint16), kind="stable")  # a radix sort: no table has more rows
    row = at[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return row[first], np.add.reduceat(g[order], first, axis=0)


class Trainer:
    """Ascent with a step for each parameter by the slopes that it has seen, a step a batch; rows without slope stay."""

    def __init__(self, net: Network):
        self.net = Network([p.copy() for p in net.parts], net.prior)
        self.seen = [np.full_like(p, 1e-3) for p in net.parts]

    def step(self, context: np.ndarray, path: np.ndarray) -> None:
        n = np.float32(len(path) ** 0.5)
        for p, seen, (at, g) in zip(self.net.parts, self.seen, self.net.gradient(context, path)):
            g = g / n
            seen[at] += g * g
            p[at] += np.float32(RATE) * g / np.sqrt(seen[at])


_COUNT = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = np.fromiter(map(_KEYS.__getitem__, held), np.uint64, len(held))
        return batch_of(_COUNT, [keys.view(np.int64), list(held.values())])

    for _, texts in id_text_rows(batches):
        for t in texts:
            held.update(words_of(t))
        if len(held) > COUNTED:
            yield rows()
            held = Counter()
    if held:
        yield rows()


class Counts:
    """How often each word occurs: the table of all, the totals of the paths, and the KEPT most frequent by key."""

    def __init__(self, table: DataFrame):
        self.table = table
        path = F.shiftrightunsigned("key", 48)
        sums = table.groupBy(path.alias("path")).agg(F.sum("n").alias("n")).toPandas()  # LEAVES rows at most
        n = np.zeros(LEAVES)
        n[sums["path"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
        self.total, self.prior = int(n.sum()), Prior(n)
        top = most_frequent(table, "n", KEPT).toPandas().sort_values("key")
        self.keys, self.logs = top["key"].to_numpy(np.int64), np.log(top["n"].to_numpy(np.float64))


def count_words(docs: DataFrame) -> Counts:
    table = docs.select("doc_id", "text").mapInArrow(_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return Counts(scratch(table, "lm-counts"))


_CODES = pa.schema([("shard", pa.int32()), ("mark", pa.int64()), ("codes", pa.binary())])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield batch_of(_CODES, [part.column(0), part.column(1), [paths_of(keys_of(t)).tobytes() for t in part.column(2).to_pylist()]])


_PARTS = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("net", pa.binary())])
_PARTS_DDL = "shard long, n long, net binary"


def _chunks(docs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The texts in order, as many at a time as have CHUNK words; a longer text is one alone."""
    held, n = [], 0
    for d in docs:
        if held and n + len(d) > CHUNK:
            yield held
            held, n = [], 0
        held.append(d)
        n += len(d)
    if held:
        yield held


def train_on(net: Network, docs: list[np.ndarray], seed: int) -> Network:
    """One pass over the texts, each chunk's words in an order that the seed gives."""
    trainer, draw = Trainer(net), np.random.default_rng(seed)
    for some in _chunks(docs):
        context, path = windows(some)
        order = draw.permutation(len(path))
        for at in range(0, len(path), BATCH):
            now = order[at : at + BATCH]
            trainer.step(context[:, now], path[now])
    return trainer.net


def _mean(table: pa.Table) -> pa.Table:
    total, n = None, 0
    table = table.sort_by("shard")
    for net, k in zip(table.column("net"), table.column("n").to_pylist()):
        x = np.frombuffer(net.as_py(), "<f4").astype(np.float64) * k
        total, n = x if total is None else total + x, n + k
    return pa.table([[table.column("shard")[0].as_py() // FAN_IN], [n], [(total / n).astype("<f4").tobytes()]], schema=_PARTS)


def shard_codes(docs: DataFrame, mark: Column, shards: int) -> DataFrame:
    """(shard, mark, codes) of each text, a partition a shard."""
    codes = docs.select(F.pmod(F.shiftright(mark, 8), F.lit(shards)).cast("int").alias("shard"), mark.alias("mark"), "text")
    return codes.mapInArrow(_codes, "shard int, mark long, codes binary").repartitionById(shards, F.col("shard"))


def train(docs: DataFrame, counts: Counts) -> Network:
    """The rounds one after the other; each has its own documents, and ends with the mean of its shards."""
    net = Network.start(counts.prior)  # the mark's low bits give the round, others the shard
    shards = max(1, round(counts.total / ROUNDS / SHARD))
    mark = F.xxhash64("doc_id", "text")
    for turn in range(ROUNDS):
        mine = docs.where((F.pmod(mark, F.lit(ROUNDS)) == turn) & F.col("text").isNotNull())
        codes = shard_codes(mine, mark, shards)
        start = net

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, bytes]]] = {}
            for b in batches:
                for shard, at, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if raw:
                        held.setdefault(shard, []).append((at, raw))
            for shard in sorted(held):
                texts = [np.frombuffer(raw, np.uint16) for _, raw in sorted(held.pop(shard))]
                done = train_on(start, texts, shard)
                yield batch_of(_PARTS, [[shard], [sum(map(len, texts))], [done.pack()]])

        parts, left = codes.mapInArrow(run, _PARTS_DDL), shards
        while True:
            left = -(-left // FAN_IN)
            parts = parts.groupBy(F.floor(F.col("shard") / FAN_IN).alias("_group")).applyInArrow(_mean, _PARTS_DDL)
            if left == 1:
                break
        mean = parts.collect()  # one row
        if mean:
            net = Network.unpack(np.frombuffer(mean[0]["net"], "<f4"), counts.prior)
    return net


_SCORES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))])


def path_scores(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """log P(path | both sides) of all words of the texts, given as paths."""
    out = []
    for some in _chunks(docs):
        context, path = windows(some)
        out += [net.forward(context[:, at : at + BATCH], path[at : at + BATCH])[-1] for at in range(0, len(path), BATCH)]
    return np.concatenate(out).astype(float)


def score(docs: DataFrame, counts: Counts, net: Network) -> DataFrame:
    """doc_id, score (sum of the words' conditional log-probabilities), its mean and n_words, per row."""
    kept, logs, leaf = counts.keys, counts.logs, counts.prior.leaf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for ids, texts in id_text_rows(batches):
            keys = [keys_of(t) for t in texts]
            n = np.array([len(k) for k in keys])
            sums, rare = np.zeros(len(keys)), [[]] * len(keys)
            full = [k for k in keys if len(k)]
            if full:
                flat = np.concatenate(full)
                each = path_scores(net, [paths_of(k) for k in full]) - leaf[(flat >> np.uint64(48)).astype(np.int64)]
                signed = flat.view(np.int64)
                at = np.minimum(np.searchsorted(kept, signed), len(kept) - 1)
                known = kept[at] == signed
                each += np.where(known, logs[at], 0.0)
                cuts = np.r_[0, np.cumsum(n[n > 0])]
                sums[n > 0] = np.add.reduceat(each, cuts[:-1])
                left = np.flatnonzero(~known)
                of = np.searchsorted(left, cuts)
                rare = [[]] * len(keys)
                for i, a, b in zip(np.flatnonzero(n > 0), of, of[1:]):
                    rare[i] = signed[left[a:b]]
            yield batch_of(_SCORES, [range(row, row + len(ids)), ids, n, sums, rare])
            row += len(ids)

    # written once, so that both sides of the join see the same row numbers
    rows = scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, n_words long, score double, rare array<long>"), "lm-rows")
    words = rows.select("row", F.explode("rare").alias("key"))
    own = words.join(counts.table, "key", "left").groupBy("row").agg(F.sum(F.coalesce(F.log(F.col("n").cast("double")), F.log(F.lit(0.5)))).alias("own"))
    whole = rows.drop("rare").join(own.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    whole = whole.withColumn("score", F.col("score") + F.coalesce("own", F.lit(0.0)))
    return whole.select("doc_id", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_log_prob"), "n_words")


def op4_pseudo_lm(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    counts = count_words(docs)
    return score(docs, counts, train(docs, counts))
