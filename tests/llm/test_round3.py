"""Language identification, phrase collocations and valid-time enrichment against plain versions of their definitions."""

import datetime as dt
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import collocations, language_id, valid_time
from quarrylake.llm.queries import ORACLE_SQL, QUERIES

# language identification


@pytest.fixture(scope="module")
def pieces():
    return language_id.Pieces(language_id._with_marks(language_id.vocabulary()))


def plain_log_prob(names, p, word):
    """Sum over all cuts of the marked word, by recursion over its first piece."""
    number = {n: i for i, n in enumerate(names)}
    text = language_id.MARK + word
    sums = [0.0] * len(text) + [1.0]
    letters = {c for n in names for c in n}
    for i in reversed(range(len(text))):
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in number:
                sums[i] += p[number[text[i:j]]] * sums[j]
            elif j == i + 1 and text[i] not in letters:
                sums[i] += p[-1] * sums[j]
    return math.log(sums[0])


def test_forward_sums_all_segmentations(pieces):
    g = np.random.default_rng(1)
    table = g.random((len(pieces.names) + 1, 2)) * 1e-3 + 1e-6
    words = ["the", "übergrößen", "x", "漢字the", "nandthisor", "éa", "a" * 64, "国" * 64]
    got = language_id.log_probs(pieces, language_id._scaled(pieces.names, table), words)
    for w, row in zip(words, got):
        assert np.allclose(row, [plain_log_prob(pieces.names, table[:, k], w) for k in (0, 1)], atol=1e-6), w


def test_expected_counts_cover_each_word(pieces):
    table = np.full((len(pieces.names) + 1, 1), 1e-3)
    into = np.zeros(len(pieces.names) + 1, np.int64)
    language_id.expected(pieces, language_id._scaled(pieces.names, table), ["thing", "ünd", "漢"], np.array([5, 1, 2]), into)
    lengths = np.array([*map(len, pieces.names), 1])
    assert abs((into * lengths).sum() / language_id.PARTS - (6 * 5 + 4 + 2 * 2)) < 0.01  # each letter of each word is in one piece


def test_language_id_held_out(spark, small):
    got = QUERIES["op11_language_id"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id").collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97


def test_language_id_edges(spark):
    schema = "doc_id long, text string, lang string, source string, score double, word string"
    rows = [(i, f"the thing and other {i}", "en", "a", 1.0, "w") for i in range(2, 20)] + [(i, f"das ding und andere {i}", "de", "a", 1.0, "w") for i in range(20, 40)]
    odd = [(100, None, "en", None, 0.0, None), (101, "", "en", None, 0.0, None), (102, "12 ² _ ...", None, "b", 0.0, None), (103, "das ding", None, "b", 0.0, None), (None, "the thing", "de", "b", 0.0, None), (104, "the " * 60_000, None, "b", 0.0, None), (105, "z" * 500, "en", None, 0.0, None)]
    docs = spark.createDataFrame(rows + odd + rows[:1], schema)
    got = language_id.languages(docs.repartition(3)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) + 1
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (100, 101, 102))
    assert by[103]["lang_pred"] == "de" and by[104]["lang_pred"] == "en" and by[None]["held_out"] is None and by[None]["lang_pred"] == "en"
    again = {r["doc_id"]: r["score"] for r in language_id.languages(docs.coalesce(1)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}  # partitions change nothing
    none = language_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert language_id.languages(docs.limit(0)).count() == 0


# collocations


def plain_collocations(rows, least, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = defaultdict(list)
    candidates = {key: n for key, n in f.items() if len(key[1]) > 1 and n >= least}
    longest = Counter()
    for (lang, w), n in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i : i + k]] = max(longest[lang, w[i : i + k]], n)
    for (lang, w), a in candidates.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if 100 * longest[lang, w] < 80 * a:
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


def phrases(seed, n):
    r = random.Random(seed)
    words = ["the", "New", "york", "of", "stadt", "émile", "x-y", "#1", "漢字", "a_b", "Z", "run"]
    fixed = ["new york city hall", "the art of", "émile zola", "x-y  z\trun"]
    out = []
    for _ in range(n):
        text = "".join(r.choice([*(w + " " for w in words), r.choice(fixed) + r.choice([" ", ", ", "\n"]), ". ", "\r", "\t"]) for _ in range(r.randrange(60)))
        out.append((r.choice(["en", "de", None, "en"]), r.choice([text, text, None, "", " \n"]) if r.random() < 0.1 else text))
    return out


@pytest.mark.parametrize("ranges", [{}, {"range_bytes": 2000}, {"range_bytes": 500, "most_ranges": 5}])
def test_collocations_against_plain(spark, ranges):
    rows = phrases(4, 400)
    docs = spark.createDataFrame([(i, t, lang, 7) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long").repartition(3)
    got = {tuple(r) for r in collocations.collocations(docs, least=5, top=25, **ranges).collect()}
    assert got == plain_collocations(rows, 5, 25) and len(got) > 40


def test_collocations_hot_pair_and_long_text(spark):
    r = random.Random(2)
    long_ = " ".join("hot pair " + r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(20_000))
    rows = [("en", long_), ("en", long_), ("en", "hot pair"), (None, "hot pair " * 40)]
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    got = {tuple(r) for r in collocations.collocations(docs, range_bytes=20_000).collect()}
    assert got == plain_collocations(rows, 30, 2000)


def test_collocations_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "a b", "de")], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0


def test_tries_round_trip():
    texts = pa.array(["b a. a b c d e", None, "a b c d", "", "ab b,b", " x"])
    words, windows, text = collocations.word_windows(texts)
    name = ["", *(w.decode() for w in words.to_pylist())]
    assert [" ".join(name[i] for i in w if i) for w in windows.T] == ["b a", "a", "a b c d", "b c d e", "c d e", "d e", "e", "a b c d", "b c d", "c d", "d", "ab b", "b", "b", "x"]
    assert text.tolist() == [0] * 7 + [2] * 4 + [4] * 3 + [5]
    leaves, counts = collocations.sorted_leaves(windows, None, len(words))
    back = collocations.unpack_trie(collocations.pack_trie(words, leaves, counts))
    again = [" ".join(["", *(w.decode() for w in back[0].to_pylist())][i] for i in w if i) for w in back[1].T]
    assert again == sorted(set(again), key=str.split) and dict(zip(again, back[2].tolist())) == Counter(" ".join(name[i] for i in w if i) for w in windows.T)


def test_scores_of_more_than_64_bits(spark):
    n = 9 * 10**15
    row = spark.createDataFrame([(n, n, n - 1)], "a long, l long, r long").select(F.expr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))")).first()
    assert row[0] == 2_000_000 * n // (2 * n - 1)


# valid-time enrichment


def plain_enrichment(sales, changes, batches=10):
    """The contract, batch by batch, over Python lists."""
    low = dt.datetime.min
    number = lambda day: max(0, min(batches - 1, (day - 19723) * batches // 152))
    day = lambda t: (t.date() - dt.date(1970, 1, 1)).days
    s_in, c_in = defaultdict(list), defaultdict(list)
    for s in sales:
        s_in[number(day(s["arrived_at"])) if s["arrived_at"] else batches - 1].append(s)
    for c in {tuple(sorted(c.items(), key=str)): c for c in changes}.values():
        if c["valid_at"]:
            c_in[number(day(c["valid_at"]) + zlib.crc32(str(c["change_id"]).encode()) % 4) if c["change_id"] is not None else batches - 1].append(c)
    order = lambda c: (c["valid_at"], *((x is not None, x or 0) for x in (c["seq"], c["change_id"])))
    held, waiting, out, tops = defaultdict(list), [], [], [None, None]

    def emit(s, batch):
        mine = held[s["client_id"]] if s["client_id"] is not None else []
        got = [c for c in mine if s["sold_at"] and c["valid_at"] <= s["sold_at"]]
        c = max(got, key=order) if got else None
        cents = math.floor(100 * c["balance"] + 0.5) if c and c["balance"] is not None else None
        out.append(("sale", s["sale_id"], batch, len(mine), c and c["change_id"], cents, c and c["op"]))

    for b in range(batches):
        marks = [t - dt.timedelta(hours=36) if t else low for t in tops]
        h = min(marks)
        for c in c_in[b]:
            if c["valid_at"] < marks[1]:
                out.append(("late", c["change_id"], b, None, None, None, None))
            else:
                held[c["client_id"]].append(c)
        both = waiting + s_in[b]
        goes = lambda s: s["sold_at"] is None or s["sold_at"] < h
        for s in filter(goes, both):
            emit(s, b)
        waiting = [s for s in both if not goes(s)]
        for versions in held.values():
            behind = sorted((c for c in versions if c["valid_at"] <= h), key=order)
            for c in behind[:-1]:
                versions.remove(c)
        tops = [max([*([t] if t else []), *(x for x in new if x)], default=None) for t, new in zip(tops, ([s["sold_at"] for s in s_in[b]], [c["valid_at"] for c in c_in[b]]))]
    for s in waiting:
        emit(s, batches)
    return Counter(out)


SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, batch int"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, kind string"


def shop(seed, n_sales, n_changes, hot=0.4):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(seconds=r.randrange(150 * 86400), microseconds=r.choice([0, 0, 1, 999_999, 1000]))
    client = lambda: 7 if r.random() < hot else r.choice([*range(8), None])
    sales, changes = [], []
    for i in range(n_sales):
        at = when()
        sold = None if r.random() < 0.02 else at - dt.timedelta(days=r.choice([0, 0, 0, 1, 3, 20])) if r.random() < 0.9 else at + dt.timedelta(days=5)
        sales.append({"sale_id": i, "client_id": client(), "status": "x", "total": 1.0, "sold_at": sold, "arrived_at": at if i % 97 else None, "priority": 1, "batch": 3})
    for i in range(n_changes):
        at = when().replace(minute=0, second=0, microsecond=0) if r.random() < 0.5 else when()
        changes.append({"change_id": i if r.random() < 0.99 else None, "client_id": client(), "seq": r.choice([0, 1, 2, None]), "op": r.choice(["I", "U", "D", None]), "valid_at": at if r.random() < 0.97 else None, "source": "s", "segment": None, "city": "c", "balance": None if r.random() < 0.1 else round(r.uniform(-1000, 9999), 2), "kind": "x"})
    return sales + [dict(s) for s in sales[:3]], changes + [dict(c) for c in changes[:20]]


COLUMNS = ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]


@pytest.mark.parametrize("seed, batches, kw", [(1, 4, {}), (2, 5, {"heavy_share": 10**9})])
def test_enrichment_against_plain(spark, seed, batches, kw):
    """heavy_share of the second: no client is cut into slices (none has a row of so many)."""
    sales, changes = shop(seed, 500, 400)
    cut = {} if not kw else {"heavy_share": 1}
    got = valid_time.enriched(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), batches, **cut)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == plain_enrichment(sales, changes, batches)


def test_enrichment_without_rows(spark):
    sales, changes = shop(3, 40, 0)
    s, c = spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES)
    got = valid_time.enriched(s, c, 2)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == plain_enrichment(sales, changes, 2)
    assert valid_time.enriched(s.limit(0), c, 1).count() == 0


@pytest.mark.parametrize("name", ["op12_collocations", "op13_sale_versions"])
def test_matches_sql(name, spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "sales", "client_changes"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert Counter(tuple(r) for r in QUERIES[name](spark, small).select(*cols).collect()) == Counter(want.fetchall())
