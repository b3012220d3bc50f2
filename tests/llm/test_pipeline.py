"""The pipeline's stages take effect, keep clean documents and the columns of documents."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from quarrylake.llm import bpe, line_dedup, mixing, ngram_join, toxicity


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]

    clean = stage["toxicity"](spark, docs, small).cache()
    g = toxicity.learn(docs, labels)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in rows.items() if g.score(r["text"]) < 0.3}
    assert clean.columns == docs.columns

    cut = stage["line_dedup"](spark, clean, small).cache()
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_passages(clean).collect()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t for i, t in want.items() if t or not rows[i]["text"]}
    assert cut.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    one = stage["ngram_join"](spark, cut, small).cache()
    first = {r["doc_id"] for r in ngram_join.ngram_components(cut).where("component_id = doc_id").collect()}
    assert {r["doc_id"] for r in one.collect()} == first and one.columns == docs.columns

    mixed = stage["mixing"](spark, one, small).cache()
    sizes = {r["doc_id"]: len(r["text"].split()) for r in one.collect()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixture(one).collect()}
    n = Counter(r["doc_id"] for r in mixed.collect())
    assert all(n[i] * s == taken[i] for i, s in sizes.items() if s) and mixed.columns == docs.columns

    packed = stage["packing"](spark, mixed, small).collect()
    t = bpe.word_bpe(bpe.default_path())
    want = Counter()
    for r in mixed.collect():
        ids = np.array([*t.encode([r["text"]])[0], 0], "<u4")
        want.update((r["doc_id"], k, zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == want


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def odd_documents(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, bin string, __id string"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "b", "x") for i, t, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows_go_through(spark, tmp_path):
    words = lambda a, n: " ".join(f"w{a}x{k}" for k in range(n))
    rows = [(1, words(1, 80), "a"), (2, None, "a"), (3, "", None), (4, " \n ", "b"), (None, words(5, 40), "a"), (6, words(1, 80), "b"), (7, words(7, 30), None), (7, words(8, 30), None), (9, words(9, 5000), "a")]
    odd_documents(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "bin", "__id"]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in got} >= {1, 2, 3, 7, 9} and 6 not in {r["doc_id"] for r in got}


def test_nothing_goes_through(spark, tmp_path):
    odd_documents(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
