"""Language identification: unigram pieces of a fixed public vocabulary, summed over all segmentations of a text.

A word is a run of letters, lowered, cut after MOST_LETTERS; it starts with the vocabulary's mark of a word's start. Each
language gives each piece a probability, and a word has the sum, over all ways to cut it into pieces, of the products of
their probabilities: the forward algorithm takes it from left to right in one pass. A text's likelihood is the product
over its words; with the languages' shares of documents it gives a posterior, whose greatest is the prediction and the score.

Probabilities are learned by expectation-maximisation over the words of all learning documents, counted by language: a round
runs forward and backward over the table of distinct words, and its expected counts of pieces are summed by group. They
are summed in whole 65536ths, so neither partitions nor their order change the model. The model is a row of the vocabulary's
length for each language, whatever the size of the corpus.

Only documents whose crc32(doc_id as text) mod 3 is not 1 are learned from, and those only with text and lang; lang, source
and doc_id are no inputs of a prediction.

Defined cases: "und" and score 0 for a null text, a text without letter, and any text where no language is learned; letters
outside of the vocabulary have a probability of their own; a null id is not held out (its remainder is null) and not learned
from; of equal posteriors the first language by code points; repeated rows are predicted alike (and learned from as often);
texts are read whole, whatever their length; other columns are passed by; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_of, give_back, id_text_rows, lean, read_table, scratch

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
MOST_LETTERS = 64
ROUNDS, PRIOR = 3, 0.1
#: Expected counts are whole parts of so many; a letter outside of the vocabulary has this probability at least.
PARTS, LEAST_OTHER = 1 << 16, 1e-5
#: Probabilities are taken times SCALE a character, so that products of 64 stay within doubles.
SCALE = 54.6
#: Distinct words in memory before they are written; words in one pass of the forward algorithm; bytes of a task's table of known words.
HELD_WORDS, PASS_WORDS, KNOWN_BYTES = 400_000, 4096, 64 << 20

_RUN = re.compile(rf"[^\W\d_]{{1,{MOST_LETTERS}}}")
_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_EXPECTED = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("parts", pa.int64())])
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def words_of(text: str | None) -> list[str]:
    """Runs of letters and of what counts as one in a word; the latter alone are no word (see is_word)."""
    return _RUN.findall(text.lower()) if text else []


def is_word(word: str) -> bool:
    return word.isalpha() or any(unicodedata.category(c)[0] == "L" for c in word)


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a public sentencepiece model that lower-case words can be made of. path: its file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p and p == p.lower() and all(c == MARK and not k or c.isalpha() for k, c in enumerate(p)))


class Pieces:
    """A trie of pieces as sorted arcs: keys of (node, letter), where they lead, and the piece that ends at each node or -1. A letter outside of it is piece len(names)."""

    def __init__(self, names: list[str]):
        self.names = names
        letters = sorted({c for p in names for c in p})
        self.letter = {c: i for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        ends = {}
        for k, p in enumerate(names):
            at = 0
            for c in p:
                at = children[at].setdefault(self.letter[c], len(children))
                if at == len(children):
                    children.append({})
            ends[at] = k
        arcs = sorted((node * (len(letters) + 1) + c, to) for node, out in enumerate(children) for c, to in out.items())
        self.keys, self.to = np.array([k for k, _ in arcs], np.int64), np.array([to for _, to in arcs], np.int32)
        self.piece = np.full(len(children), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())

    @functools.cached_property
    def code(self) -> np.ndarray:
        """The number of each code point's letter."""
        out = np.full(0x110000, len(self.letter), np.int32)
        out[[ord(c) for c in self.letter]] = list(self.letter.values())
        return out

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes that letters lead to, or -1."""
        key = node.astype(np.int64) * (len(self.letter) + 1) + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, from, to, piece) of every piece that fits into a word, by place of its end, and the words' lengths with the mark."""
        n = np.array([len(w) + 1 for w in words])
        codes = np.full((len(words), int(n.max())), -1, np.int32)
        other = len(self.letter)
        points = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(codes.shape[1]) < n[:, None]] = self.code[points]
        word, start = np.nonzero(codes >= 0)
        node, found = np.zeros(len(word), np.int32), []
        lone = codes[word, start] == other
        found.append((word[lone], start[lone], start[lone] + 1, np.full(lone.sum(), len(self.names), np.int32)))
        at = start
        while len(word):
            live = at < n[word]
            word, start, at, node = word[live], start[live], at[live], node[live]
            node = self.step(node, codes[word, at])
            live = node >= 0
            word, start, at, node = word[live], start[live], at[live] + 1, node[live]
            ends = self.piece[node] >= 0
            found.append((word[ends], start[ends], at[ends], self.piece[node[ends]]))
        word, start, end, piece = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((word, end))
        return word[order], start[order], end[order], piece[order], n


def _ends(end: np.ndarray) -> Iterator[tuple[int, slice]]:
    places, at = np.unique(end, return_index=True)
    for j, a, b in zip(places.tolist(), at.tolist(), [*at[1:].tolist(), len(end)]):
        yield j, slice(a, b)


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to the rows of into; rows are sorted."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    into[rows[first]] += np.add.reduceat(values, first, axis=0)


def forward(pieces: Pieces, table: np.ndarray, words: list[str]) -> tuple[np.ndarray, tuple]:
    """Sums over segmentations up to each place of each word, one column a language. table: probabilities times SCALE a character, a row a piece."""
    arcs = word, start, end, piece, n = pieces.arcs(words)
    sums = np.zeros((int(n.max()) + 1, len(words), table.shape[1]))
    sums[0] = 1
    for j, s in _ends(end):
        _add(sums[j], word[s], sums[start[s], word[s]] * table[piece[s]])
    return sums, arcs


def log_probs(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(words), table.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of like length share a pass
    for at in range(0, len(order), PASS_WORDS):
        some = order[at : at + PASS_WORDS]
        sums, (_, _, _, _, n) = forward(pieces, table, [words[i] for i in some])
        out[some] = np.log(np.maximum(sums[n, np.arange(len(some))], 1e-300)) - (n * np.log(SCALE))[:, None]
    return out


def expected(pieces: Pieces, table: np.ndarray, words: list[str], counts: np.ndarray, into: np.ndarray) -> None:
    """Adds to into the expected number of each piece in words of one language, in PARTS. table: one column."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), PASS_WORDS):
        some = order[at : at + PASS_WORDS]
        sums, (word, start, end, piece, n) = forward(pieces, table, [words[i] for i in some])
        sums, p = sums[:, :, 0], table[:, 0]
        back = np.zeros_like(sums)
        back[n, np.arange(len(some))] = 1
        for j, s in reversed(list(_ends(end))):
            np.add.at(back, (start[s], word[s]), back[j, word[s]] * p[piece[s]])
        whole = np.maximum(sums[n, np.arange(len(some))], 1e-300)
        share = sums[start, word] * p[piece] * back[end, word] / whole[word]
        np.add.at(into, piece, np.rint(share * counts[some][word] * PARTS).astype(np.int64))


@dataclass
class Model:
    """langs in order, their log shares of documents, and the table of piece probabilities, a column each."""

    langs: list[str]
    log_share: np.ndarray
    table: np.ndarray


def _with_marks(names: list[str]) -> list[str]:
    """Every letter of the vocabulary, and the mark, as pieces, so that any of their words has a segmentation."""
    return sorted(set(names) | {c for p in names for c in p} | {MARK})


def _scaled(names: list[str], p: np.ndarray) -> np.ndarray:
    lengths = np.array([*map(len, names), 1])
    return p * (SCALE ** lengths)[:, None]


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over docs, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items() if is_word(w)]
            held.clear()
            return batch_of(_COUNTS, zip(*rows) if rows else [[], [], []])

        for langs, texts in id_text_rows(batches, 64):
            for lang, text in zip(langs, texts):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield out()
        yield out()

    found = docs.select("lang", "text").mapInArrow(lean(run), "lang string, word string, n long")
    return scratch(found.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")


def _round(counts: DataFrame, pieces: Pieces, langs: list[str], table: np.ndarray) -> np.ndarray:
    """Expected numbers of pieces under table: one row a piece, one column a language."""
    number = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            words, n = np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
            for i in np.unique(of).tolist():
                into = sums.setdefault(i, np.zeros(len(table), np.int64))
                expected(pieces, table[:, i : i + 1], words[of == i].tolist(), n[of == i], into)
        for i, into in sums.items():
            at = np.flatnonzero(into)
            yield batch_of(_EXPECTED, [np.full(len(at), i), at, into[at]])

    parts = counts.mapInArrow(lean(run), "lang int, piece int, parts long")
    out = np.zeros((len(table), len(langs)))
    for r in parts.groupBy("lang", "piece").agg(F.sum(F.col("parts").cast("decimal(38,0)")).alias("parts")).toLocalIterator():
        out[r["piece"], r["lang"]] = float(r["parts"]) / PARTS
    return out


def learn(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> tuple[Pieces, Model]:
    """The model of docs (lang, text) with neither null. Its size depends on the vocabulary and the number of languages."""
    pieces = Pieces(_with_marks(vocabulary(path)))
    docs = docs.where("text is not null and lang is not null")
    shares = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(shares)
    size = len(pieces.names) + 1
    model = Model(langs, np.log(np.array([shares[x] for x in langs], float) / max(1, sum(shares.values()))), np.full((size, len(langs)), 1 / size))
    if langs:
        counts = count_words(docs)
        for _ in range(rounds):
            n = _round(counts, pieces, langs, _scaled(pieces.names, model.table)) + PRIOR
            model.table = n / n.sum(axis=0)
            model.table[-1] = np.maximum(model.table[-1], LEAST_OTHER)
    return pieces, model


class Reader:
    """Log probabilities of texts by language; keeps those of words that it has seen."""

    def __init__(self, pieces: Pieces, model: Model):
        self.pieces, self.model, self.table = pieces, model, _scaled(pieces.names, model.table)
        self.most = max(PASS_WORDS, KNOWN_BYTES // (8 * max(1, len(model.langs)) + 120))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.real = np.zeros((0, len(self.model.langs))), np.zeros(0, bool)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of each text, and whether it has a word."""
        words = [words_of(t) for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        distinct = set(flat)
        if len(self.known) + len(distinct) > self.most:
            self.clear()
        fresh = sorted(distinct.difference(self.known))
        if fresh:
            real = np.array([is_word(w) for w in fresh])
            self.known |= {w: len(self.rows) + i for i, w in enumerate(fresh)}
            self.rows = np.concatenate([self.rows, np.where(real[:, None], log_probs(self.pieces, self.table, fresh), 0)])
            self.real = np.concatenate([self.real, real])
        sums, has = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), bool)
        if flat:
            index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            sizes = np.array([*map(len, words)])
            some = np.flatnonzero(sizes)
            at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            sums[some] = np.add.reduceat(self.rows[index], at, axis=0)
            has[some] = np.logical_or.reduceat(self.real[index], at)
        return sums, has


def predict(docs: DataFrame, pieces: Pieces, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(pieces, model)
        for ids, texts in id_text_rows(batches, 64):
            if not model.langs:
                yield batch_of(_PREDICTED, [ids, ["und"] * len(ids), [0.0] * len(ids)])
                continue
            logs, has = reader.read(texts)
            logs = logs + model.log_share
            logs -= logs.max(axis=1, keepdims=True)
            post = np.exp(logs)
            post /= post.sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            yield batch_of(_PREDICTED, [ids, [model.langs[b] if h else "und" for b, h in zip(best, has)], np.where(has, post[np.arange(len(best)), best], 0.0)])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out, predicted for all."""
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    pieces, model = learn(docs.where(~held), path)
    return predict(docs, pieces, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return languages(read_table(spark, sf_dir, "documents"))
