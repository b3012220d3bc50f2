"""Steps whose work once grew faster than their input: plain results, and records moved while a common key grows."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from quarrylake.operators import bounded as B, graph as G, recall as R, routed as RT, traversal as T, vector_index as V


def moved(spark, run):
    """The records that stages moved through shuffles while run() went on."""
    sc = spark.sparkContext

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()).iterator()
        n = 0
        while stages.hasNext():
            n += stages.next().shuffleWriteRecords()
        return n

    before = total()
    out = run()
    return total() - before, out


@contextmanager
def broadcast_limit(spark, size):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plain_tiers(refs, look):
    out = {}
    for r in {x[0] for x in refs}:
        out[r] = (None, 0, None)
        for tier in range(4):
            met = {s for x, self_id, relation, tiers in refs if x == r and tier < len(tiers) for k, s in look if k in tiers[tier] and not (relation == "overrides" and s == self_id)}
            if met:
                out[r] = (tier, len(met), min(met) if len(met) == 1 else None)
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tiers_of_many_keys(spark, seed):
    r = random.Random(seed)
    key = lambda: f"k{r.randrange(9)}"
    look = [(key(), f"s{r.randrange(5)}") for _ in range(14)]
    refs = [(f"r{i % 65}", r.choice([None, "s0", "s1", "s2"]), r.choice(["calls", "overrides"]), [[key() for _ in range(r.randrange(4))] for _ in range(r.randrange(4))]) for i in range(80)]
    got = G.tiered_resolution(spark.createDataFrame(refs, "reference_id string, self_id string, relation string, tiers array<array<string>>"), spark.createDataFrame(look, "lookup_key string, symbol_id string"))
    assert {x["reference_id"]: (x["tier"], x["matches"], x["target_id"]) for x in got.collect()} == plain_tiers(refs, look)


def test_tiers_do_not_multiply(spark):
    n = 2000
    refs = spark.range(n).select(F.col("id").cast("string").alias("reference_id"), F.col("id").cast("string").alias("self_id"), F.lit("overrides").alias("relation"), F.expr("array(array('a'), array('a', 'b'))").alias("tiers"))
    look = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lookup_key"), F.col("id").cast("string").alias("symbol_id"))
    records, rows = moved(spark, lambda: G.tiered_resolution(refs, look).groupBy("tier", "matches").count().collect())
    assert {tuple(x) for x in rows} == {(0, n // 2, n // 2), (0, n // 2 - 1, n // 2)} and records < 40 * n


def test_locators_do_not_multiply(spark):
    n = 2000
    c = spark.range(n).select("id", F.lit("x").alias("name"))
    s = spark.range(n).select(F.col("id").alias("symbol_id"), F.lit("x").alias("name"))
    records, rows = moved(spark, lambda: R.locator_counts(c, s, ["name"]).groupBy("matches", "first").count().collect())
    assert [tuple(x) for x in rows] == [(n, 0, n)] and records < 4 * n


def test_lane_and_routes_of_copies(spark):
    """Copies of queries and of symbols meet once: places go to the least ids, and records grow with both, not with their product."""
    frame, n = spark.createDataFrame, 300
    posts = [(i % 2, i, t, w) for i in range(n) for t, w in (("x", 5), ("y", 1))] + [(0, n, "x", 7), (0, n, "y", 1), (1, n + 1, "y", 9)]
    terms = frame([(q, t) for q in range(n) for t in ("x", "y")], "query_id long, term string").unionByName(frame([(n, "y")], "query_id long, term string"))
    rt = frame([(f"p{p}", i, t, w) for p, i, t, w in posts], "projection string, node_id long, term string, weight int")
    nodes = frame([(f"p{i % 2}", i, i < 10) for i in range(n + 2)], "projection string, node_id long, exported boolean")
    members = frame([(0, "p0"), (1, "p1")], "ordinal int, projection string")
    records, rows = moved(spark, lambda: RT.lexical_lane(terms, members, rt, nodes, 3, 5).collect())
    of = lambda q: [(r["ordinal"], r["node_id"], r["matched_terms"], r["matched_weight"]) for r in sorted(rows, key=lambda r: r["catalog_rank"]) if r["query_id"] == q]
    assert of(7) == of(n - 1) == [(0, 300, 2, 8), (0, 0, 2, 6), (0, 2, 2, 6), (1, 1, 2, 6), (1, 3, 2, 6)]
    assert of(n) == [(1, 301, 1, 9), (0, 0, 1, 1), (0, 2, 1, 1), (0, 4, 1, 1), (1, 1, 1, 1)] and records < 60 * n
    post = rt.select(F.col("projection").alias("repository"), F.col("node_id").alias("symbol_id"), "term", "weight")
    bridges = frame([(0, "p0", 300, "p1", 1)], "id long, source_repository string, source_symbol long, target_repository string, target_symbol long")

    def routed():
        cards, receipts = RT.search(terms, post, members.select(F.col("projection").alias("repository")), bridges, evidence_cards=3, per_repository=3)
        return cards.collect(), receipts.collect()

    records, (cards, receipts) = moved(spark, routed)
    best = lambda q: [(r["repository"], r["symbol_id"], r["score"], r["relationships"]) for r in sorted(cards, key=lambda r: r["position"]) if r["query_id"] == q]
    assert best(7) == best(n - 1) == [("p0", 300, 8, 1), ("p1", 1, 6, 1), ("p0", 0, 6, 0)] and len(receipts) == n + 1
    assert best(n) == [("p1", 301, 9, 0), ("p0", 0, 1, 0), ("p1", 1, 1, 1)] and records < 80 * n


def test_bridges_do_not_multiply(spark):
    """Imports that are alike meet the exports once; equal ids add up."""
    n = 1000
    imports = spark.range(n).select(F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("repository"), F.lit("p").alias("identity"), F.when(F.col("id") % 4 == 0, "1").alias("version"), (F.col("id") % (n - 1)).alias("import_id"))
    exports = spark.range(50).select(F.lit("p").alias("identity"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("repository"), F.when(F.col("id") == 0, "1").otherwise("2").alias("version"), F.lit("s").alias("symbol_id"))
    records, rows = moved(spark, lambda: G.bridges(imports, exports).groupBy("state", "candidates", "producer").count().collect())
    assert {tuple(r) for r in rows} == {("bridge", 50, "x0", n // 4), ("ambiguous-producer", 50, None, 3 * n // 4)} and records < 4 * n


@pytest.mark.parametrize("mode", ["path", "impact"])
def test_searches_of_a_hub(spark, mode):
    """Searches from one hub meet as many of its edges as their budget, at the first level and the second."""
    n = 1500
    ends = [F.lit("hub"), F.lpad(F.col("id").cast("string"), 4, "0")]
    a, b = ends if mode == "path" else ends[::-1]
    edges = spark.range(n).select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), a.alias("source_id"), b.alias("target_id"), F.lit("local").alias("kind"))
    door = ["door", "hub"] if mode == "path" else ["hub", "door"]
    edges = edges.unionByName(spark.createDataFrame([("d", *door, "local")], "id string, source_id string, target_id string, kind string"))
    searches = spark.range(n).select(F.col("id").alias("search_id"), F.when(F.col("id") % 2 == 0, "hub").otherwise("door").alias("start"), F.when(F.col("id") < 2, "0002").alias("target"))
    records, (receipts, steps) = moved(spark, lambda: (lambda t: (t.receipts.collect(), t.steps.orderBy("search_id", "step").collect()))(B.traverse(edges, searches, 3, 5, mode)))
    assert {tuple(r)[1:] for r in receipts if r["search_id"] > 1} == {("edge-limit", 5, 1, 6, 1, 5, 0), ("edge-limit", 5, 2, 6, 2, 5, 0)} and len(receipts) == n
    assert [r["edge_id"] for r in steps if r["search_id"] < 2] == (["e0002", "d", "e0002"] if mode == "path" else ["e0000", "e0001", "e0002", "d", "e0000", "e0001", "e0002"])
    assert records < 10 * n


@pytest.mark.parametrize("seed", range(2))
def test_nearest_bases(spark, seed):
    r = random.Random(seed)
    parents = spark.createDataFrame([(a, b) for a in range(1, 60) for b in {r.randrange(60), r.randrange(a)}], "commit long, parent long")
    heads = spark.createDataFrame([(h,) for h in range(30, 64)], "head long")
    some = spark.createDataFrame([(c,) for c in r.sample(range(64), 9)], "commit long")
    want = {tuple(x) for x in B.preferred_base(B.commit_distances(parents, heads), some).collect()}
    assert {tuple(x) for x in B.nearest_bases(parents, heads, some).collect()} == want and any(x[2] > 1 for x in want)


def test_nearest_bases_of_a_line(spark):
    """A long history with many heads: rows grow with the commits, not with heads times ancestors."""
    n = 600
    parents = spark.range(1, n).select(F.col("id").alias("commit"), (F.col("id") - F.when(F.col("id") % 3 == 0, 3).otherwise(1)).alias("parent"))
    heads, some = spark.range(n).select(F.col("id").alias("head")), spark.range(0, n, 3).select(F.col("id").alias("commit"))
    records, rows = moved(spark, lambda: B.nearest_bases(parents, heads, some).groupBy("distance", "candidates").count().collect())
    assert {tuple(x) for x in rows} == {(d, 1, n // 3) for d in range(3)} and records < 40 * n


def test_components_of_random_graphs(spark):
    """Roots as of a plain union, stars and chains among them."""
    r = random.Random(5)
    pairs = [(f"{r.randrange(90):02}", f"{r.randrange(90):02}") for _ in range(50)] + [("00", f"s{i}") for i in range(40)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    ids = sorted({f"{i:02}" for i in range(90)} | {x for p in pairs for x in p})
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame
    got = T.components(frame(pairs, "source_id string, target_id string"), frame([(i,) for i in ids], "id string"))
    assert {x["id"]: x["root"] for x in got.collect()} == root


def test_pools_of_many_queries(spark):
    """Queries that ask for one term share its pool: postings are cut once, and copies are told apart by address."""
    n = 400
    frame = spark.createDataFrame
    terms = spark.range(n).select(F.col("id").alias("query_id"), F.lit("x").alias("term"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("u"), F.lpad((n - F.col("id")).cast("string"), 4, "0")).alias("uri"), F.when(F.col("id") < 2, "same").otherwise(F.col("id").cast("string")).alias("logical_key"), F.lit(5).cast("long").alias("length"))
    postings = docs.select("doc_id", F.lit("x").alias("term"), F.lit(1).alias("field_weight"), F.when(F.col("doc_id") == 9, 3).otherwise(1).cast("long").alias("tf"), F.lit(1).cast("long").alias("n"))
    frequency = frame([("x", n - 1)], "term string, frequency long")
    for rows in (postings, postings.withColumn("length", F.lit(5).cast("long"))):
        records, pools = moved(spark, lambda: R.term_pools(terms, rows, docs, "doc_id", per_term=3, frequency=frequency).collect())
        assert {tuple(sorted(x["uri"] for x in pools if x["query_id"] == q)) for q in range(n)} == {("u0001", "u0002", "u0391")} and len(pools) == 3 * n and records < 12 * n
    assert [tuple(r) for r in R.document_frequency(postings, docs, "doc_id").collect()] == [("x", n - 1)]


def test_frequency_of_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a")], "doc_id long, logical_key string")
    postings = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x"), (5, "y"), (3, "y"), (2, "z")], "doc_id long, term string")
    assert {tuple(r) for r in R.document_frequency(postings, docs, "doc_id").collect()} == {("x", 2), ("y", 2), ("z", 1)}


def test_texts_move_and_not_their_terms(spark):
    """Terms are counted where their text is; wanted ones alone are counted, if named."""
    n = 40
    text = " ".join(f"w{i} dealt-out reCall" for i in range(50))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("w1 Plain’s").alias("title"), F.lit("Src").alias("project"))
    records, rows = moved(spark, lambda: R.weighted_terms(docs, "doc_id", {"title": 3}, "text", "project").collect())
    one = {r["term"]: (r["field_weight"], r["tf"], r["n"]) for r in rows if r["doc_id"] == 7}
    assert len(one) == 48 and one["recall"] == one["re call"] == one["dealt"] == one["dealt-out"] == one["out"] == (1, 50, 50) and one["w10"] == (1, 1, 1) and one["plain's"] == one["plain"] == (3, 1, 0) and one["src"] == (1, 1, 0)
    assert len(rows) == n * len(one) and records <= 4 * n
    records, rows = moved(spark, lambda: R.weighted_terms(docs, "doc_id", {"title": 3}, "text", "project", spark.createDataFrame([("recall",), ("src",)], "term string")).collect())
    assert {tuple(r)[1:] for r in rows} == {("recall", 1, 50, 50), ("src", 1, 1, 0)} and len(rows) == 2 * n and records <= 4 * n


def test_vectors_meet_many_cells_in_slices():
    """A batch of any size against the most cells: a worker's memory is that of a slice, and no row is lost."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v, centres = unit(g.normal(size=(3000, 8))), unit(g.normal(size=(V.MOST_CELLS, 8)))
    rows = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 8).cast(pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), rows, pa.array(np.full(3000, -2.0))], names=["query_id", "v", "floor"])
    numbers, ones = np.arange(len(centres), dtype=np.int32), np.ones(len(centres), np.int32)
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    near, most, met, held = [], 0, np.zeros((3000, len(centres)), bool), 0
    for b in V._placed([batch], "query_id", centres):
        near += zip(b.column("query_id").to_pylist(), b.column("cell").to_pylist())
    for b in V._asked([batch], numbers, ones, centres, np.zeros(len(centres)), 2, True):
        q, c = b.column("query_id").to_numpy(), b.column("cell").to_numpy()
        assert not met[q, c].any()
        met[q, c] = True
        most, held = max(most, b.num_rows * 8), max(held, pa.total_allocated_bytes() - before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near == list(enumerate((v @ centres.T).argmax(axis=1)))
    assert (met.sum(axis=1) == len(centres) - 2).all()
    assert most <= V.MOST_AT_ONCE and peak < 150e6 and held < 60e6


def test_changes_do_not_multiply(spark):
    """References of one alias with many symbols, brought up to date: records grow with the references, not with them times the symbols."""
    n = 1500
    of = lambda k: spark.range(k).select(F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("file"), F.lit("a").alias("lookup_key"), F.col("id").cast("string").alias("symbol_id"))
    aliases = spark.createDataFrame([("g", "a", "b")], "file string, alias_of string, alias string")
    refs = spark.range(2 * n).select(F.lit("r").alias("file"), F.col("id").alias("reference_id"), F.lit(None).cast("string").alias("self_id"), F.lit("calls").alias("relation"), F.expr("array(array('none'), array(if(id % 2 = 0, 'b', 'c')))").alias("tiers"))
    old, new = B.Sources(of(n), aliases, refs), B.Sources(of(n - 1), aliases, refs)
    files = spark.createDataFrame([("f49",)], "file string")

    def run():
        got, receipt = B.resolve_changes(old, new, files, T.written(B.resolved(old), "resolved"), 0.6)
        return receipt["mode"], sorted(map(tuple, got.groupBy("tier", "matches").count().collect()), key=str)

    records, told = moved(spark, run)
    assert told == ("incremental", [(1, n - 1, n), (None, 0, n)]) and records < 60 * n


@pytest.mark.parametrize("seed", range(3))
def test_unions_of_shared_symbols(spark, seed):
    """Sets of keys whose symbols are partly the same, a null one too."""
    r = random.Random(seed)
    held = {f"k{i}": {r.choice(["a", "b", "c", "d", "e", "f", None]) for _ in range(r.randrange(1, 6))} for i in range(8)}
    held |= {f"k{i}'": held[f"k{i}"] for i in range(8)}
    look = [(k, s) for k, symbols in held.items() for s in symbols]
    sets = {tuple(sorted(r.sample(sorted(held), r.randrange(2, 5)))) for _ in range(60)}
    got = G._unions(spark.createDataFrame([(list(k),) for k in sets], "keys array<string>"), spark.createDataFrame(look, "lookup_key string, symbol_id string"))
    want = {}
    for keys in sets:
        union = set().union(*(held[k] for k in keys))
        known = union - {None}
        want[keys] = (len(union), len(known), min(known, default=None), max(known, default=None))
    assert {tuple(x["keys"]): (x["rows"], x["n"], x["low"], x["high"]) for x in got.collect()} == want


def test_sets_of_keys_do_not_multiply(spark):
    """Every two of 40 keys of 50 symbols each, which are under an alias of their key too."""
    n, of = 40, 50
    look = spark.range(2 * n * of).select(F.concat(F.when(F.col("id") < n * of, "k").otherwise("a"), (F.col("id") % n).cast("string")).alias("lookup_key"), (F.col("id") % (n * of)).cast("string").alias("symbol_id"))
    refs = [(f"{x}{i}{y}{j}", None, "calls", [[f"{x}{i}", f"{y}{j}"]]) for x in "ka" for y in "ka" for i in range(n) for j in range(i + 1)]
    frame = spark.createDataFrame(refs, "reference_id string, self_id string, relation string, tiers array<array<string>>")
    with broadcast_limit(spark, "-1"):
        records, rows = moved(spark, lambda: G.tiered_resolution(frame, look).groupBy("matches").count().collect())
    assert {tuple(x) for x in rows} == {(of, 4 * n), (2 * of, len(refs) - 4 * n)} and records < 12 * len(refs) + 4 * 2 * n * of


def test_changes_move_no_keys_of_references(spark):
    """Nothing is small enough for broadcasts but the lookup's keys: of references that an update does not reach only ids move, and twice at most."""
    n = 30000
    of = lambda k: spark.range(k).select(F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("file"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("lookup_key"), F.col("id").cast("string").alias("symbol_id"))
    aliases = spark.createDataFrame([("g", "k1", "b")], "file string, alias_of string, alias string")
    refs = spark.range(n).select(F.concat(F.lit("r"), (F.col("id") % 10).cast("string")).alias("file"), F.col("id").alias("reference_id"), F.lit(None).cast("string").alias("self_id"), F.lit("calls").alias("relation"), F.expr("array(array(concat('own', id), concat('other', id)), array(if(id % 10 < 3, concat('k', id % 50), 'none')))").alias("tiers"))
    old, new = B.Sources(of(50), aliases, refs), B.Sources(of(49), aliases, refs.where("file <> 'r3' or reference_id % 20 = 3"))
    files = spark.createDataFrame([("f4",), ("r3",)], "file string")
    with broadcast_limit(spark, "9k"):
        records, told = moved(spark, lambda: sorted(map(tuple, B.resolve_changes(old, new, files, T.written(B.resolved(old), "resolved"))[0].groupBy("tier", "matches").count().collect()), key=str))
    assert told == [(1, 1, 3 * n // 10), (None, 0, n - 3 * n // 10 - n // 20)]
    assert records < 3.5 * n
