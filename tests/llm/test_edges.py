"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylake.llm import ctph, html_template, line_dedup, mixing, ngram_join, packing, pseudo_lm, quality_gbt, secret_scan, toxicity

WORDS = "alpha beta gamma delta stone river cloud moss fern oak pine hill lake wind rain sun moon star".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows():
    long_ = prose(99, 30_000)
    base = [(1, prose(1, 60), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"), (5, long_, "de", "b"), (6, prose(1, 60), "en", None), (7, "x", "en", "a"), (7, "x", "en", "a"), (None, prose(3, 30), "en", "b"), (9, prose(4, 50) + "\n" + prose(5, 70) + "\n\nend", None, "a"), (10, prose(6, 9) + "\n" + prose(5, 70), "fr", "c")]
    return [(i, t, lang, s, len(t or ""), "u", 5, "k", [1], "x") for i, t, lang, s in base]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, u string, size int, bin string, class array<int>, __id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")


def verdicts(d, labels):
    return quality_gbt.quality_verdicts(d, quality_gbt.train(d, labels))


def scores(d, labels):
    return toxicity.score_texts(d, toxicity.learn(d, labels))


def lm(d, labels):
    n = pseudo_lm.count_words(d)
    return pseudo_lm.score(d, n, pseudo_lm.train(d, n))


ROW_OPS = {"quality": verdicts, "ngram": lambda d, _: ngram_join.ngram_components(d), "lines": lambda d, _: line_dedup.dedup_lines(d), "passages": lambda d, _: line_dedup.dedup_passages(d), "lm": lm, "mixture": lambda d, _: mixing.mixture(d), "toxicity": scores, "ctph": lambda d, _: ctph.fingerprints(d), "secrets": lambda d, _: secret_scan.scan_secrets(d)}


@pytest.mark.parametrize("name", ROW_OPS)
def test_one_row_each(name, docs, none, labels):
    assert ROW_OPS[name](docs, labels).count() == len(rows())
    assert ROW_OPS[name](none, labels).count() == 0


def test_lm_edges(docs, labels):
    got = {r["doc_id"]: r for r in lm(docs.where("doc_id <> 7"), labels).collect()}
    assert all(got[i]["score"] == 0 and got[i]["mean_log_prob"] is None and got[i]["n_words"] == 0 for i in (2, 3, 4))
    assert got[1]["score"] == got[6]["score"] < 0 and got[5]["n_words"] == 30_000


def test_packing_edges(docs, none):
    got = packing.pack(docs).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 1  # an empty text is its end mark
    assert len([r for r in got if r["doc_id"] == 7]) == 2
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("dedup", [line_dedup.dedup_lines, line_dedup.dedup_passages])
def test_line_dedup_keeps_columns(docs, dedup):
    out = dedup(docs)
    assert out.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (10, prose(6, 9)) in kept and (2, None) in kept
    assert sum(1 for i, t in kept if i == 9 and prose(5, 70) in t) == 1


def test_mix_keeps_columns(docs, none):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixture(docs.where("doc_id is not null and doc_id <> 7")).collect()}
    assert taken[2] == 0 and taken[3] == 0
    assert out.where("doc_id = 2").count() == 1
    assert mixing.mix(none).count() == 0


MIXES = {
    "null among words": [(1, "a b c", "x"), (2, None, "x"), (3, "d e", "y")],
    "a source without words": [(1, "a b c", "x"), (2, "", "y"), (3, " \n", "y"), (4, "d", None)],
    "no words": [(1, None, "x"), (2, "", None), (None, " ", "y")],
    "ids lacking or repeated": [(None, "a b", "x"), (None, "a b c d", "x"), (None, None, "x"), (4, "p q r", "y"), (4, "p q r", "y"), (4, "s", None)],
    "nothing": [],
}


@pytest.mark.parametrize("case", MIXES)
def test_mixing_edges_against_sql(spark, case):
    import duckdb

    from quarrylake.llm.queries import ORACLE_SQL

    rows = MIXES[case]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(ORACLE_SQL["op5_mixing"]).fetchall()
    cols = [c[0] for c in con.description]
    found = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2))
    assert sorted(str(tuple(r)) for r in found.select(*cols).collect()) == sorted(map(str, want))
    assert len(want) == len(rows) and mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() >= sum(not (t or "").split() for _, t, _ in rows)


def test_ngram_nulls(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert (2, 0, 2) in got and (3, 0, 3) in got and (6, 56, 1) in got and (7, 1, 7) in got
    assert ngram_join.keep_first(docs).where("doc_id = 6").count() == 0
    assert ngram_join.keep_first(docs).columns == docs.columns


def test_toxic_drop_keeps_columns(docs, labels):
    out = toxicity.drop_toxic(docs, toxicity.Grammar({"x": 8.0}, {}, -3.0, [3.0] * 5))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.select("doc_id").collect()} == {1, 2, 3, 4, 5, 6, None, 9, 10}
    strict = toxicity.drop_toxic(docs, toxicity.Grammar({}, {}, 5.0))
    assert [r["doc_id"] for r in strict.collect()] == [2]  # a null text has nothing to reject


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", None, 1), (2, None, "", 1), (3, "http://a.b/d", "<p>x<p", 1), (3, "http://a.b/d", "<p>x<p", 1), (None, "nonsense", "<article>" + "<p>y" * 3000, 1)], "page_id long, url string, html string, host int")
    for name in ("container", "fixed", "slot", "spared", "path", "token"):
        pages = pages.withColumn(name, F.lit(7))
    got = sorted(((r["page_id"] or 0, r["text"]) for r in html_template.extract(pages).collect()), key=str)
    assert (1, "") in got and (2, "") in got and got.count((3, "x")) == 2 and (0, "\n".join("y" * 3000)) in got
    assert html_template.extract(pages.limit(0)).count() == 0
