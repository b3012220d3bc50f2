"""Round 4: a search without cuts."""

from quarrylake.queries import QUERIES


def test_refreshed_index_ranks_all_documents(spark, tmp_path):
    """The best document is the 301st of either term, and a query's forty common terms count as much as its rare ones."""
    rows = [(i, "alpha alpha alpha" if i <= 300 else "beta beta beta") for i in range(1, 601)] + [(601, "alpha beta")]
    many = " ".join(f"common{k}" for k in range(40))
    rows += [(700 + i, f"{many} alpha") for i in range(3)] + [(800 + k, f"rare{k}") for k in range(32)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    asked = [(1, "alpha beta"), (2, f"{many} " + " ".join(f"rare{k}" for k in range(32)))]
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    best = {}
    for r in QUERIES["index_refresh_topk"](spark, str(tmp_path)).orderBy("query_id", "score").collect():
        best[r["query_id"]] = r["uri"]
    assert best[1].endswith("/601") and best[2].rsplit("/", 1)[1] in {"700", "701", "702"}
