"""Budgeted traversal, base selection, incremental resolution, excerpts and the indexes against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.operators import bounded as B, recall_index as RI, vector_index as V
from quarrylake.queries import recall_queries as RQ

EDGES = "id string, source_id string, target_id string, kind string"


def plain_traverse(edges, start, target, max_depth, max_edges, mode, ready):
    """One search, edge by edge."""
    end = (1, 2) if mode == "path" else (2, 1)
    out = defaultdict(list)
    for e in sorted({e for e in edges if e[1] and e[2]}, key=lambda e: (e[3] != "local", e[0], e[end[1]])):
        out[e[end[0]]].append(e)
    seen, parent, frontier, scanned, expanded, kinds, steps = {start: 0}, {}, [start], 0, 0, {"local": 0, "bridge": 0}, []
    if start == target:
        return "target-found", 0, 0, 1, 0, 0, 0, []
    if start not in ready:
        return "unready-start", 0, 0, 1, 0, 0, 0, []

    def tell(reason, path):
        return reason, scanned, expanded, len(seen), max(seen.values()), kinds["local"], kinds["bridge"], path

    while frontier:
        if scanned >= max_edges:
            break
        frontier.sort(key=lambda n: (seen[n], n))
        at = frontier.pop(0)
        if seen[at] >= max_depth:
            continue
        expanded += 1
        for e in out[at][: max_edges - scanned]:
            scanned += 1
            to = e[end[1]]
            if to not in ready:
                continue
            kinds[e[3]] += 1
            steps.append(e[0])
            if to not in seen:
                seen[to], parent[to] = seen[at] + 1, (at, e[0])
                frontier.append(to)
            if to == target:
                path, n = [], to
                while n != start:
                    path.insert(0, parent[n][1])
                    n = parent[n][0]
                return tell("target-found", path if mode == "path" else steps)
    reason = "edge-limit" if scanned >= max_edges else "depth" if max(seen.values()) >= max_depth else "exhaustion"
    return tell(reason, [] if mode == "path" else steps)


@pytest.mark.parametrize("mode, max_depth, max_edges", [("path", 3, 12), ("path", 6, 60), ("impact", 3, 9), ("impact", 5, 200), ("path", 1, 2)])
def test_traverse_against_plain(spark, mode, max_depth, max_edges):
    r = random.Random(max_edges)
    nodes = [f"n{i}" for i in range(30)]
    edges = [(f"e{i}", r.choice([*nodes, None]) if i % 9 == 0 else r.choice(nodes), r.choice(nodes[:28]), r.choice(["local", "local", "bridge"])) for i in range(45)]
    edges += [(f"h{i}", "n0", f"n{i % 30}", "local") for i in range(40)] + edges[:3]  # a hub, and rows that come twice
    ready = set(nodes) - {"n3", "n9"}
    searches = [(i, r.choice(nodes), r.choice([*nodes, None])) for i in range(40)] + [(100, "n3", "n1"), (101, "n5", "n5"), (102, "nowhere", "n1"), (103, "n0", "n29")]
    t = B.traverse(spark.createDataFrame(edges, EDGES), spark.createDataFrame(searches, "search_id long, start string, target string"), max_depth, max_edges, mode, spark.createDataFrame([(n,) for n in [*ready, "nowhere"]], "id string"))
    steps = defaultdict(list)
    for x in sorted(t.steps.collect(), key=lambda x: (x["search_id"], x["step"])):
        steps[x["search_id"]].append(x["edge_id"])
    got = {x["search_id"]: (*x[1:], steps[x["search_id"]]) for x in t.receipts.collect()}
    want = {s: plain_traverse(edges, a, b, max_depth, max_edges, mode, ready | {"nowhere"}) for s, a, b in searches}
    assert got == want
    if (mode, max_depth, max_edges) == ("path", 3, 12):
        assert {x[0] for x in want.values()} == {"target-found", "unready-start", "edge-limit", "depth", "exhaustion"}


def test_commit_distances(spark):
    parents = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("e", "d"), ("e", "a"), ("x", "x")]
    got = B.commit_distances(spark.createDataFrame(parents, "commit string, parent string"), spark.createDataFrame([("e",), ("x",), ("lone",)], "head string"))
    assert {tuple(r) for r in got.collect()} == {("e", "e", 0), ("e", "d", 1), ("e", "a", 1), ("e", "b", 2), ("e", "c", 2), ("x", "x", 0), ("lone", "lone", 0)}
    base = lambda *s: {tuple(r) for r in B.preferred_base(got, spark.createDataFrame([(x,) for x in s], "commit string")).collect()}
    assert base("b") == {("e", 2, 1, "b")} and base("b", "c", "x") == {("e", 2, 2, None), ("x", 0, 1, "x")} and base("a", "d", "b") == {("e", 1, 2, None)}
    assert B.commit_distances(spark.createDataFrame(parents, "commit string, parent string"), spark.createDataFrame([("e",)], "head string"), 1).count() == 3


def random_sources(spark, r, old=None):
    """Sources, or an edit of one or two files of old: the rows as lists, and the changed files."""
    files = [f"f{i}" for i in range(8)]
    key = lambda: f"k{r.randrange(14)}"
    rows = {
        "defs": lambda f: [(f, key(), f"{f}#{r.randrange(3)}") for _ in range(r.randrange(4))],
        "alias": lambda f: [(f, key(), key()) for _ in range(r.randrange(2))],
        "refs": lambda f: [(f, f"{f}:{i}", f"{f}#0", r.choice(["calls", "overrides"]), [[key()], [key(), key()]][: r.randrange(1, 3)]) for i in range(r.randrange(4))],
    }
    changed = files if old is None else r.sample(files, r.randrange(1, 3))
    out = {k: ([x for x in old[k] if x[0] not in changed] if old else []) + [x for f in changed for x in make(f)] for k, make in rows.items()}
    schemas = {"defs": "file string, lookup_key string, symbol_id string", "alias": "file string, alias_of string, alias string", "refs": "file string, reference_id string, self_id string, relation string, tiers array<array<string>>"}
    return out, B.Sources(*(spark.createDataFrame(out[k], schemas[k]) for k in schemas)), spark.createDataFrame([(f,) for f in changed], "file string")


@pytest.mark.parametrize("seed", range(4))
def test_incremental_resolution(spark, seed):
    r = random.Random(seed)
    rows, old, _ = random_sources(spark, r)
    _, new, files = random_sources(spark, r, rows)
    before = B.resolved(old)
    want = sorted(map(tuple, B.resolved(new).collect()))
    for most in (1.0, 0.0):
        got, receipt = B.resolve_changes(old, new, files, before, most)
        assert sorted(map(tuple, got.collect())) == want
        assert receipt["mode"] == ("incremental" if most or not receipt["affected"] else "fallback") and receipt["affected"] <= receipt["references"] + 4


def test_reference_of_two_files(spark):
    """One of a reference's two files no longer has it: it is resolved anew, by what the other asks for."""
    frame = spark.createDataFrame
    defs = frame([("d", "k", "s1"), ("d", "l", "s2")], "file string, lookup_key string, symbol_id string")
    aliases = frame([], "file string, alias_of string, alias string")
    refs = [("f", 1, None, "calls", [["k"]]), ("g", 1, None, "calls", [["none"], ["l"]]), ("g", 2, None, "calls", [["l"]]), ("f", 3, None, "calls", [["k"]])]
    old, new = (B.Sources(defs, aliases, frame(x, "file string, reference_id long, self_id string, relation string, tiers array<array<string>>")) for x in (refs, refs[1:3]))
    got, receipt = B.resolve_changes(old, new, frame([("f",)], "file string"), B.resolved(old))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.resolved(new).collect())) == [(1, 1, 1, "s2"), (2, 0, 1, "s2")]
    assert receipt == {"mode": "incremental", "affected": 1, "references": 2}


def plain_ranges(rows, files=3, ranges=2, lines=24):
    out = set()
    for q in {r[0] for r in rows}:
        mine = [(p, h, s, min(e, s + lines - 1), rank, ref, t or e > s + lines - 1) for i, p, h, s, e, rank, ref, t in rows if i == q and s >= 1 and e >= s]
        safe = {p for p in {m[0] for m in mine} if len({m[1] for m in mine if m[0] == p}) == 1}
        for p in sorted(safe, key=lambda p: (min(m[4] for m in mine if m[0] == p), p))[:files]:
            merged = []
            for _, _, s, e, rank, ref, t in sorted((m for m in mine if m[0] == p), key=lambda m: (m[2], m[3], m[4])):
                if not merged or s > merged[-1][1]:
                    merged.append([s, e, rank, {ref}, t])
                    continue
                last = merged[-1]
                natural = max(last[1], e)
                end = min(natural, last[0] + lines - 1)
                merged[-1] = [last[0], end, min(last[2], rank), last[3] | {ref}, last[4] or t or end < natural]
            out |= {(q, p, s, e, rank, ",".join(sorted(refs)), t) for s, e, rank, refs, t in sorted(merged, key=lambda m: (m[2], m[0]))[:ranges]}
    return out


def test_source_ranges(spark):
    r = random.Random(1)
    rows = [(r.randrange(6), f"p{r.randrange(5)}", "h" if r.random() < 0.97 else "other", s := r.randrange(-2, 200), s + r.randrange(-1, 60), r.randrange(50), f"r{r.randrange(9)}", r.random() < 0.1) for _ in range(300)]
    schema = "query_id long, path string, content_hash string, start_line long, end_line long, rank long, ref string, truncated boolean"
    got = {tuple(x) for x in B.source_ranges(spark.createDataFrame(rows, schema)).collect()}
    assert got == plain_ranges(rows) and len(got) > 20


# vector index


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    g = np.random.default_rng(4)
    centres = g.normal(size=(12, 16))
    v = centres[g.integers(0, 12, 1200)] + 0.35 * g.normal(size=(1200, 16))
    v[:400] = centres[0] + 0.05 * g.normal(size=(400, 16))  # a cell with a third of all rows
    v[1100:1120] = v[1100]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    return v, df, V.build(df, f"file://{tmp_path_factory.mktemp('v')}/index", cells=20, block_rows=100)


def plain_top(v, ids, k, minimum=-1.0):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = set()
    for q in ids:
        s = np.round(u @ u[q], 6)
        s[q] = -9
        out |= {(q, int(i), float(s[i])) for i in sorted(range(len(v)), key=lambda i: (-s[i], i))[:k] if s[i] >= minimum}
    return out


@pytest.mark.parametrize("k, minimum, probes", [(10, -1.0, 1), (10, 0.9, 2), (3, -1.0, 20)])
def test_vector_search_exact(cloud, k, minimum, probes):
    v, df, index = cloud
    ids = list(range(0, 1200, 20)) + [1101]
    q = df.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), "v")
    got = {(r[0], r[1], round(r[2], 6)) for r in V.search(index, q, k, minimum, probes, exact=True, same_id=False, block_rows=100).collect()}
    assert got == plain_top(v, ids, k, minimum)


def test_vector_search_recall(spark, small, cloud):
    v, df, index = cloud
    ids = list(range(0, 1200, 7))
    q = df.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), "v")
    want = {x[:2] for x in plain_top(v, ids, 10)}
    got = V.search(index, q, 10, same_id=False, block_rows=100)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert len({(r[0], r[1]) for r in got.collect()} & want) / len(want) >= 0.9
    sample = lambda name: {tuple(r)[:2] for r in RQ.QUERIES[name](spark, small).collect()}
    exact = sample("vector_topk")
    assert len(sample("vector_index_topk") & exact) / len(exact) >= 0.9


def test_vector_index_rejects(spark, tmp_path):
    make = lambda rows: V.build(spark.createDataFrame(rows, "vec_id long, v array<double>"), f"file://{tmp_path}/x")
    for rows in ([(1, [0.0, 0.0])], [(1, [1.0, float("nan")])], [(1, None)], [(1, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(None, [1.0])]):
        with pytest.raises(ValueError):
            make(rows)
    empty = V.build(spark.createDataFrame([], "vec_id long, v array<double>"), f"file://{tmp_path}/empty")
    assert V.search(empty, spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>"), 3, exact=True).count() == 0


# recall index


def index_rows(index):
    return sorted(map(tuple, index.postings().select("doc_id", "term", "field_weight", "tf", "n").collect())), sorted(map(tuple, index.frequency().select("term", "frequency").collect())), sorted(tuple(r) for r in index.documents.select("doc_id", "uri", "logical_key", "length", "digest", "buckets").collect())


def test_recall_index_refresh(spark, small, tmp_path):
    from quarrylake.adapters import recall_docs

    docs = recall_docs(spark, small).where("doc_id < 60").cache()
    first = RI.build(docs.where("doc_id < 50"), f"file://{tmp_path}/a", RQ._postings, buckets=64)
    changed = docs.where("doc_id <> 7").withColumn("text", F.when(F.col("doc_id") == 3, "few new words zyx").otherwise(F.col("text"))).withColumn("title", F.when(F.col("doc_id") == 3, "few new words zyx").otherwise(F.col("title")))
    small_step = changed.where("doc_id < 50")
    second = RI.refresh(first, small_step, RQ._postings)
    third = RI.refresh(second, changed, RQ._postings)
    assert index_rows(second) == index_rows(RI.build(small_step, f"file://{tmp_path}/b", RQ._postings, buckets=64))
    assert index_rows(third) == index_rows(RI.build(changed, f"file://{tmp_path}/c", RQ._postings, buckets=64))
    assert len({first.generation, second.generation, third.generation}) == 3
    assert RI.refresh(third, changed, RQ._postings) is third and RI.RecallIndex.open(spark, f"file://{tmp_path}/a").manifest == third.manifest
    # only buckets of terms that came or went were written
    tiny = RI.refresh(third, changed.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(900).cast("long")).withColumn("text", F.lit("solitary")).withColumn("title", F.lit("")).withColumn("project", F.lit("x"))), RQ._postings)
    written = [b for b, g in tiny.manifest.items() if g == tiny.number]
    assert written == tiny.buckets_of(spark.createDataFrame([("solitary",)], "term string")) and len(written) == 1


def test_recall_index_unfinished_refresh(spark, small, tmp_path):
    """A refresh that died before its manifest leaves the one before in force."""
    from quarrylake.adapters import recall_docs

    docs = recall_docs(spark, small).where("doc_id < 10")
    index = RI.build(docs, f"file://{tmp_path}/d", RQ._postings, buckets=16)
    (tmp_path / "d" / "manifest" / "g=1").mkdir()
    assert RI.RecallIndex.open(spark, f"file://{tmp_path}/d").number == index.number == 0


def test_routed_stops_and_pages(spark):
    """Each stop reason, skipped members, bridge ends, and pages that join to the whole answer."""
    from quarrylake.operators import routed as R

    repos = [f"r{i:02}" for i in range(30)]
    posts = [(r, f"{r}:a", "x", 9 - i % 9) for i, r in enumerate(repos)] + [("r03", "r03:b", "y", 1), ("r20", "r20:b", "z", 1), ("r20", "r20:b", "x", 1), ("r25", "r25:c", "lone", 3)]
    terms = [(1, "x"), (2, "y"), (3, "z"), (3, "x"), (4, "nothing"), (5, "y"), (5, "lone"), (6, "lone")]
    usable = [(r,) for r in repos if r != "r03"]
    bridges = [(0, "r25", "r25:c", "r01", "r01:a"), (1, "r25", "r25:c", "r03", "r03:b")]
    frame = spark.createDataFrame
    cards, receipts = R.search(frame(terms, "query_id long, term string"), frame(posts, "repository string, symbol_id string, term string, weight int"), frame(usable, "repository string"), frame(bridges, "id long, source_repository string, source_symbol string, target_repository string, target_symbol string"), evidence_cards=5)
    got = {r["query_id"]: (r["routes"], r["selected"], r["stop_reason"]) for r in receipts.collect()}
    assert got[1] == (30, 8, "result-budget") and got[2] == (1, 1, "exhaustion") and got[4] == (0, 0, "exhaustion") and got[5] == (2, 2, "exhaustion")
    assert got[3][2] == "sufficient-evidence" or got[3][2] == "work-budget"
    assert got[6] == (1, 1, "sufficient-evidence")
    of = lambda q: [(r["symbol_id"], r["score"], r["relationships"]) for r in sorted(cards.where(F.col("query_id") == q).collect(), key=lambda r: r["position"])]
    assert of(6) == [("r25:c", 3, 1), ("r01:a", 0, 1)] and len(of(1)) == 5 and [s for s, _, _ in of(3)] == ["r20:b"]
    paged = R.paged(cards, F.lit(2), 5)
    rows = sorted(paged.where("query_id = 1").collect(), key=lambda r: r["position"])
    assert [r["page"] for r in rows] == [1, 1, 2, 2, 3]
    seen, page = [], paged.where("page = 1")
    for number in (2, 3, 4):
        seen += [(r["query_id"], r["position"], r["symbol_id"]) for r in page.collect()]
        rest = R.continued(paged, R.continuation(page))
        page = rest.where(F.col("page") == number)
    assert sorted(seen) == sorted((r["query_id"], r["position"], r["symbol_id"]) for r in cards.collect())


def test_health_cursors(spark):
    from quarrylake.operators import memory as M

    f = spark.createDataFrame([(f"u{i}", "relation-target", ["high", "low", "medium"][i % 3], "d") for i in range(7)] + [("u1", "relation-target", "low", "d")], "uri string, category string, severity string, detail string")
    r = spark.createDataFrame([("u1", "body")], "uri string, body string")
    seen, cursor = [], None
    for size in (3, 3, 1):
        page, cursor = M.health_page([f], r, 3, cursor)
        rows = sorted(page.collect(), key=lambda x: x["position"])
        assert len(rows) == size
        seen += [(x["position"], x["severity"], x["uri"]) for x in rows]
        if size == 3:
            with pytest.raises(ValueError):
                M.health_page([f], r.withColumn("body", F.lit("other")), 3, cursor)
    assert cursor is None and seen == [(k + 1, s, u) for k, (s, u) in enumerate([("high", "u0"), ("high", "u3"), ("high", "u6"), ("medium", "u2"), ("medium", "u5"), ("low", "u1"), ("low", "u4")])]
    for bad in ("7:x", "nonsense", "0:" + M.health_digest(f, r)):
        with pytest.raises(ValueError):
            M.health_page([f], r, 3, bad)
