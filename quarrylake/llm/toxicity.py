"""Toxicity: a weighted finite-state pattern grammar.

Five transducers read the words of a clause one after the other, each the output of the one before: negation and
reported speech mark the words that they govern, target marks the words near an addressed person, insult turns insult
words into a kind of path by their marks, threat joins a threat with its target in either order. Their composition is
built once as one transition table; a clause is scored only where its path emits a match, by the kind of path (plain,
targeted, negated, reported, threat), never by an isolated word's presence alone. Lexical arcs (words and stems) carry
log odds learned from labelled rows; the weights of the path kinds come from a logistic fit on the same rows.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2, at most TRAIN_ROWS of them (those whose
ids hash lowest). Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has no clause and gets the score of no matches (drop_toxic keeps null texts, whatever
their score); of several texts of a labelled id the one of the least digest is learned from; a null id is not held out
(its remainder is null) and passes through; without labels of both kinds the lexicon is the fixed seed list; repeated
rows score alike; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, id_text_rows, lean, read_table, scratch

TRAIN_ROWS, THRESHOLD = 20_000, 0.3
#: A lexicon entry must be in this many toxic rows, with log odds of at least LEAST_ODDS.
LEAST_ROWS, LEAST_ODDS, LEXICON, STEMS = 3, 2.0, 256, (3, 4, 5, 6, 7, 8)
_CLAUSE = re.compile(r"[.!?;:|\n]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")

# Closed word classes of the grammar.
TARGETS = frozenset("you your you're u he she they him her them his their du dich dir ihr euch sie er tu te toi vous ton votre il elle ils tú usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says say saying called calls quoted quote wrote writes sagte sagt nannte schrieb disait déclara écrit dijo dice llamó escribió".split())
THREATS = frozenset("kill hurt destroy beat stab shoot burn töten töte schlagen tuer tuerai frapper matar mataré golpear".split())
SEEDS = ("idiot", "moron", "scum", "stupid", "worthless", "pathetic", "disgusting", "loser", "trash", "clown")

# Word classes, which the first transducer reads.
OTHER, INSULT, TARGET, NEGATION, REPORT, THREAT = range(6)
CLASSES = range(6)
#: Kinds of path, which the last transducer writes; what is no match is written as None.
PATHS = ("plain", "targeted", "negated", "reported", "threat")
#: Words that a negation, a target and a threat govern after them.
NEGATED_REACH, TARGET_REACH, THREAT_REACH = 3, 4, 4


class Transducer:
    """A deterministic transducer over words that end anywhere: arcs[state, symbol] is (next state, output)."""

    def __init__(self, start: Hashable, arcs: dict[tuple[Hashable, Hashable], tuple[Hashable, Hashable]]):
        self.start, self.arcs = start, arcs

    @classmethod
    def of(cls, start: Hashable, symbols: Iterable, step: Callable[[Hashable, Hashable], tuple[Hashable, Hashable]]) -> Transducer:
        """All arcs of the states that can be reached from start."""
        symbols, arcs, seen, work = list(symbols), {}, {start}, [start]
        while work:
            state = work.pop()
            for symbol in symbols:
                arcs[state, symbol] = to, _ = step(state, symbol)
                if to not in seen:
                    seen.add(to)
                    work.append(to)
        return cls(start, arcs)

    @property
    def states(self) -> set:
        return {s for s, _ in self.arcs}

    @property
    def symbols(self) -> list:
        return list(dict.fromkeys(x for _, x in self.arcs))

    @property
    def outputs(self) -> list:
        return list(dict.fromkeys(out for _, out in self.arcs.values()))

    def run(self, word: Iterable) -> list:
        state, out = self.start, []
        for symbol in word:
            state, x = self.arcs[state, symbol]
            out.append(x)
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what second writes on reading what first writes."""

    def step(state: tuple, symbol: Hashable) -> tuple:
        a, middle = first.arcs[state[0], symbol]
        b, out = second.arcs[state[1], middle]
        return (a, b), out

    return Transducer.of((first.start, second.start), first.symbols, step)


Marked = tuple[int, frozenset]


def marker(mark: str, opens: int, reach: int | None, symbols: Iterable[Marked]) -> Transducer:
    """Marks the reach symbols (None: all) after one of class opens."""

    def step(left: int, symbol: Marked) -> tuple[int, Marked]:
        cls, marks = symbol
        after = (reach or 1) if cls == opens else left if reach is None else max(0, left - 1)
        return after, (cls, marks | {mark} if left else marks)

    return Transducer.of(0, symbols, step)


def insult(symbols: Iterable[Marked]) -> Transducer:
    """Turns insults into their kind of path; other symbols pass."""

    def step(state: int, symbol: Marked) -> tuple[int, Hashable]:
        cls, marks = symbol
        if cls != INSULT:
            return 0, symbol
        return 0, "reported" if "said" in marks else "negated" if "not" in marks else "targeted" if "target" in marks else "plain"

    return Transducer.of(0, symbols, step)


def threat(symbols: Iterable) -> Transducer:
    """A threat near a target before it, or a target at most THREAT_REACH words after a threat, neither negated nor reported."""

    def step(left: int, symbol: Hashable) -> tuple[int, str | None]:
        after = max(0, left - 1)
        if isinstance(symbol, str):
            return after, symbol
        cls, marks = symbol
        free = not marks & {"not", "said"}
        if cls == THREAT:
            return THREAT_REACH, "threat" if free and "target" in marks else None
        return after, "threat" if cls == TARGET and left and free else None

    return Transducer.of(0, symbols, step)


def grammar_parts() -> list[Transducer]:
    """The component transducers, each over the output alphabet of the one before."""
    parts = [Transducer.of(0, CLASSES, lambda state, cls: (0, (cls, frozenset())))]
    for make in (lambda x: marker("not", NEGATION, NEGATED_REACH, x), lambda x: marker("said", REPORT, None, x), lambda x: marker("target", TARGET, TARGET_REACH, x), insult, threat):
        parts.append(make(parts[-1].outputs))
    return parts


class Machine:
    """The composed grammar as a table of numbers: table[state][class] is (next state, index of PATHS or -1)."""

    def __init__(self) -> None:
        whole = reduce(compose, grammar_parts())
        number = {s: i for i, s in enumerate(sorted(whole.states, key=str))}
        self.start = number[whole.start]
        cell = lambda to, out: (number[to], PATHS.index(out) if out else -1)
        self.table = [[cell(*whole.arcs[s, c]) for c in CLASSES] for s in number]


MACHINE = Machine()


def bare(word: str) -> str:
    return _EDGE.sub("", word)


@dataclass
class Grammar:
    """Insult arcs: whole words, and stems that longer words begin with. bias and weights belong to the logistic score."""

    words: dict[str, float]
    stems: dict[str, float]
    bias: float = -3.0
    weights: list[float] = field(default_factory=lambda: [2.0, 2.5, 0.5, 0.5, 2.0])

    def arc(self, word: str) -> float:
        """Weight of the insult arc that the word takes, or 0."""
        w = self.words.get(word)
        if w is not None:
            return w
        for k in STEMS:
            if len(word) <= k:
                break
            w = self.stems.get(word[:k])
            if w is not None:
                return w
        return 0.0

    def matches(self, text: str) -> list[float]:
        """Summed arc weights of the matched paths, by kind."""
        total = [0.0] * len(PATHS)
        low = text.lower()
        table, arcs = MACHINE.table, {}
        seen = set(low.split())
        for w in seen:
            b = w if w.isalpha() else bare(w)
            a = self.arc(b)
            sym = INSULT if a else THREAT if b in THREATS else OTHER
            if sym:
                arcs[w] = (sym, a or 1.0)
        if not arcs:
            return total
        for clause in _CLAUSE.split(low):
            words = clause.split()
            hits = [self._symbol(w) for w in words]
            if not any(s in (INSULT, THREAT) for s, _ in hits):
                continue
            state = MACHINE.start
            for sym, weight in hits:
                state, out = table[state][sym]
                if out >= 0:
                    total[out] += weight or 1.0  # a threat that its target completes
        return total

    def _symbol(self, word: str) -> tuple[int, float]:
        b = word if word.isalpha() else bare(word)
        a = self.arc(b)
        if a:
            return INSULT, a
        if b in THREATS:
            return THREAT, 1.0
        return (TARGET if b in TARGETS else NEGATION if b in NEGATIONS else REPORT if b in REPORTS else OTHER), 0.0

    def score(self, text: str) -> float:
        z = self.bias + sum(w * math.log1p(m) for w, m in zip(self.weights, self.matches(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features_of(text: str) -> set[str]:
    """Candidate arcs of a text: "=word", and "stem+" for each proper beginning."""
    out = set()
    for w in {bare(w) for w in text.lower().split()}:
        if len(w) >= 3:
            out.add("=" + w)
            out.update(w[:k] + "+" for k in STEMS if len(w) > k)
    return out


def training_rows(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most rows labelled ids outside the held-out quarter."""
    key = F.col("doc_id").cast("long")
    return labels.where("doc_id is not null and toxic is not null").groupBy(key.alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    """Arc weights from counts over the training rows, then the weights of the path kinds."""
    spark = docs.sparkSession
    sample = training_rows(labels, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # one text an id, read from the documents once: the sample is bounded by rows, whatever ids repeat
    chosen = scratch(texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")).select("toxic", "text"), "toxic-sample")
    pos, neg = chosen.agg(F.sum("toxic"), F.count("*") - F.sum("toxic")).first()
    if not pos or not neg:
        return Grammar({w: 3.0 for w in SEEDS}, {})
    counted = pa.schema([("feature", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, texts in id_text_rows(batches):
            c: Counter = Counter()
            for y, t in zip(ys, texts):
                c.update((f, y) for f in features_of(t))
            yield batch_of(counted, zip(*((f, y, n) for (f, y), n in c.items())) if c else [[]] * 3)

    sums = chosen.mapInArrow(lean(count), "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (F.lit(float(pos)) - F.col("p") + 0.5)) - F.log((F.col("q") + 0.5) / (F.lit(float(neg)) - F.col("q") + 0.5))
    best = sums.where(F.col("p") >= LEAST_ROWS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("p") * F.col("odds")), "feature").limit(8 * LEXICON).collect()
    weights = {r["feature"]: r["odds"] for r in best}
    held = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.string()))])

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, texts in id_text_rows(batches):
            yield batch_of(held, [ys, [sorted(features_of(t) & weights.keys()) for t in texts]])

    rows_ = chosen.mapInArrow(which, "toxic int, features array<string>").where(F.size("features") > 0).collect()
    # cover the toxic rows greedily, so that a stem stands for its many longer words and chance companions stay out
    by: dict[str, list[set[int]]] = {f: [set(), set()] for f in weights}
    for i, r in enumerate(rows_):
        for f in r["features"]:
            by[f][r["toxic"]].add(i)
    lexicon: dict[str, float] = {}
    covered: set[int] = set()
    paid: set[int] = set()
    while by and len(lexicon) < LEXICON:
        gain, f = max((len(t - covered) - 3 * len(q - paid), f) for f, (q, t) in by.items())
        if gain < LEAST_ROWS:
            break
        q, t = by.pop(f)
        covered |= t
        paid |= q
        lexicon[f] = weights[f]
    # arcs that every cover needs to be whole: entries nearly free of clean rows come in on their own evidence
    for f, (q, t) in by.items():
        if f[0] == "=" and len(t) >= LEAST_ROWS and len(q) * 8 <= len(t) and len(lexicon) < LEXICON:
            if not any(f[1:].startswith(s[:-1]) for s in lexicon if s[-1] == "+"):
                lexicon[f] = weights[f]
    grammar = Grammar({f[1:]: w for f, w in lexicon.items() if f[0] == "="}, {f[:-1]: w for f, w in lexicon.items() if f[-1] == "+"})
    matched = pa.schema([("toxic", pa.int32()), ("m", pa.list_(pa.float64()))])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, texts in id_text_rows(batches):
            yield batch_of(matched, [ys, [grammar.matches(t) for t in texts]])

    # equal rows of matches are counted together; nothing here is longer than the training rows
    got = chosen.mapInArrow(paths, "toxic int, m array<double>").collect()
    x = np.log1p(np.array([r["m"] for r in got], float).reshape(len(got), len(PATHS)))
    grammar.bias, grammar.weights = _logistic(x, np.array([r["toxic"] for r in got], float))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, list[float]]:
    """Newton steps; a ridge draws kinds of path without evidence to the prior of a plain match."""
    prior = np.r_[0.0, 1.0, 1.2, 0.3, 0.3, 1.0]
    a = np.c_[np.ones(len(x)), x]
    w = prior.copy()
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    r = np.r_[1e-3, np.full(x.shape[1], ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - r * (w - prior) * (np.arange(len(w)) > 0)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(r)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), np.maximum(w[1:], 0.0).tolist()


def score_texts(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score per row. One scan, no shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_text_rows(batches):
            yield batch_of(out, [ids, [grammar.score(t or "") for t in texts]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below threshold, all columns kept; a null text is kept."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 512):
                part = [t is None or grammar.score(t) < threshold for t in texts.slice(at, 512).to_pylist()]
                yield batch.slice(at, 512).filter(pa.array(part, pa.bool_()))

    return docs.mapInArrow(lean(run), schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    grammar = learn(docs, read_table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return score_texts(docs, grammar).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
