"""Hand-built fixtures: semantics that the sample tables do not show."""

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import scores as S, text as X, versions as V
from quarrylake.operators import graph as G, memory as M, recall as R, traversal as T
from quarrylake.plans import predicates as P
from quarrylake.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    lex = lambda t: one(spark, X.lexical_terms(F.lit(t)))
    assert lex("fooBar") == ["foobar", "foo bar"]
    assert lex("a-b_c x-ray") == ["x-ray", "ray"] or lex("x-ray") == ["x-ray", "ray"]
    assert lex("well–known don’t") == ["well-known", "well", "known", "don't", "don"]
    assert lex("Їж ab ж") == ["їж"]
    assert one(spark, X.exact_terms(F.lit("where is the RecallIndex v2 parser of the recall index"))) == ["RecallIndex", "parser", "recall", "index"]
    assert one(spark, X.snippet(F.lit("a \n b" + "c" * 300))).endswith("…")
    assert one(spark, X.natural_key(F.lit("a10"))) > one(spark, X.natural_key(F.lit("a9")))


def test_slug(spark):
    slug = X.uri_slug(F.lit("mem://x/Mobile-alerting-Spec.md#2"))
    assert one(spark, slug) == "mobile-alerting-spec"
    assert one(spark, X.slug_names_term(slug, F.lit("spec"))) and not one(spark, X.slug_names_term(F.lit("design-respec-notes"), F.lit("spec")))


def test_scopes(spark):
    d = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("b",)], "u string")
    hit = lambda s: [r["u"] for r in d.where(P.uri_scope(F.col("u"), s)).orderBy("u").collect()]
    assert hit(["a"]) == hit(["a/"]) == ["a", "a/b"] and hit([]) == hit(None) == ["a", "a/b", "ab", "b"] and hit(["", " "]) == []
    assert P.normalize_scope("./A\\b/../C/") == "a/c" and P.ancestors("a/b") == ["a", "a/b"]
    assert P.derive_policy("the approved and canonical coding guidance")["kind"] == "approved"
    assert P.derive_policy("not the approved guidance")["kind"] == "all" and P.derive_policy("x", workset=[])["kind"] == "none"


def test_overlay(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, v string")
    own = spark.createDataFrame([("2", "B")], "id string, v string")
    gone = spark.createDataFrame([("3",)], "id string")
    assert sorted(map(tuple, G.effective(own, base, gone).collect())) == [("1", "a"), ("2", "B")]


def test_validity_rules(spark):
    now, end = F.lit("2025-01-01 00:00:00").cast("timestamp"), F.lit("2025-01-01 00:00:00").cast("timestamp")
    assert one(spark, P.valid_now(now, F.lit(None).cast("timestamp"), end)) and one(spark, P.expired(now, end))


def test_feedback_clamps_after_every_event(spark):
    rows = [(i, "applied", "u", f"2025-01-01 00:0{i}:00") for i in range(6)] + [(7, "wrong", "u", "2025-01-01 00:09:00"), (8, "wrong", "u", "2025-01-02 00:00:00")]
    e = spark.createDataFrame(rows, "event_id long, action string, uri string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = M.feedback_scores(e, F.lit("2025-01-02 00:00:00").cast("timestamp")).first()["score"]
    w, d = {"applied": 0.3, "wrong": -0.5}, 0.0
    from datetime import datetime

    for _, a, _, t in rows:
        age = (datetime(2025, 1, 2) - datetime.fromisoformat(t)).total_seconds() / 86400
        d = max(-1, min(1, d + w[a] * 2 ** (-age / 90)))
    assert got == round(d, 6) and got < 0.1


def test_paths(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "a", "x"), ("4", "x", "c"), ("5", "c", "a")], "id string, source_id string, target_id string")
    assert [(r["step"], r["id"]) for r in T.shortest_path(e, "a", "c").orderBy("step").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert T.shortest_path(e, "a", "nowhere").count() == 0 and T.shortest_path(e, "a", "a").count() == 1 and T.shortest_path(e, "a", "c", 1).count() == 0
    assert {r["id"]: r["depth"] for r in T.reach(e, spark.createDataFrame([("a",)], "id string"), 5).collect()} == {"a": 0, "b": 1, "x": 1, "c": 2}


def test_tiers(spark):
    refs = spark.createDataFrame([("r1", "s", "calls", [["k1"], ["k2"]]), ("r2", "s", "calls", [["k3"], ["k2"]]), ("r3", "t1", "overrides", [["k1"]]), ("r4", "s", "calls", [["none"]])], "reference_id string, self_id string, relation string, tiers array<array<string>>")
    look = spark.createDataFrame([("k1", "t1"), ("k2", "t2"), ("k3", "t3"), ("k3", "t4")], "lookup_key string, symbol_id string")
    got = {r["reference_id"]: (r["tier"], r["matches"], r["target_id"]) for r in G.tiered_resolution(refs, look).collect()}
    assert got == {"r1": (0, 1, "t1"), "r2": (0, 2, None), "r3": (None, 0, None), "r4": (None, 0, None)}


def test_bridges(spark):
    imports = spark.createDataFrame([("a", "p", "1", 1), ("a", "q", None, 2), ("a", "own", None, 3), ("a", "old", "9", 4)], "repository string, identity string, version string, import_id long")
    exports = spark.createDataFrame([("b", "p", "1", "s"), ("b", "q", "1", "s"), ("c", "q", "2", "s"), ("a", "own", "1", "s"), ("b", "own", "1", "s"), ("b", "old", "1", "s")], "repository string, identity string, version string, symbol_id string")
    assert {r["import_id"]: r["state"] for r in G.bridges(imports, exports).collect()} == {1: "bridge", 2: "ambiguous-producer", 4: "incompatible-package-version"}


def test_versions(spark):
    assert V.compare("1.2.3", "1.2.3-rc.1") == 1 and V.compare("1.2.3-2", "1.2.3-10") == -1 and V.compare("x", "1.0.0") is None
    for c, v, want in [("^1.2.0", "1.9.0", True), ("^1.2.0", "2.0.0", False), ("~1.2", "1.2.9", True), ("~1.2", "1.3.0", False), (">=1 <2 || 3.x", "3.4.5", True), ("1.0.0 - 2.0.0", "2.0.0", True), ("1.0 - 2.0", "1.5.0", False), ("^1.0.0", "1.5.0-beta.1", False), ("1.x", "1.2.3-rc.1", False), ("1.2.3-rc.1", "1.2.3-rc.1", True), ("1.2.3 || ", "1.2.3", False), (">=1.2, <2", "1.5.0", True), (">1.2", "1.2.1", True), ("<=1.2", "1.2.1", False), ("^0.0", "0.0.7", True), ("01.2", "1.2.0", False), ("weird!", "1.0.0", False), (None, "1.0.0", True), ("^0.2.3", "0.3.0", False), ("<1.0.0", "0.9.0", True), (">1.2.3", "1.2.3", False), ("", "1.0.0", False)]:
        assert V.satisfies(c, v) is want, (c, v)
    d = spark.createDataFrame([("^1.0.0", "1.5.0"), ("^1.0.0", "2.0.0")], "a string, b string")
    assert [r["x"] for r in d.select(V.npm_compatible("a", "b").alias("x")).collect()] == [True, False]


def test_contradictions(spark):
    rows = [("a", "p", "The cache layer is not enabled on production hosts."), ("b", "p", "The cache layer is enabled on production hosts."), ("c", "p", "Something else entirely is here."), ("d", "q", "The cache layer is enabled on production hosts.")]
    got = M.contradictions(spark.createDataFrame(rows, "uri string, project string, body string")).collect()
    assert [(r["denied_uri"], r["stated_uri"], r["similarity_milli"]) for r in got] == [("a", "b", 1000)]


def test_path_class(spark):
    want = {"docs/a.ts": "documentation", "src/readme.md": "documentation", "src/tests/a.ts": "test", "src/a.spec.ts": "test", "src/a.ts": "implementation", "a\\fixtures\\b.py": "test", "tests": "implementation"}
    d = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r["p"]: r["c"] for r in d.select("p", X.path_class(F.col("p")).alias("c")).collect()} == want


def test_policy_order(spark):
    names = ("membership", "grant", "share", "project", "capability", "write_kind", "attestation")
    d = spark.createDataFrame([(True, True, False, True, False, True, True), (True,) * 7, (None,) * 7], ", ".join(f"{n} boolean" for n in names))
    assert [r["decision"] for r in M.policy_decision(d).collect()] == ["deny-share", "allow", "deny-membership"]


def test_identity_and_freshness(spark):
    c = spark.createDataFrame([("i", "u1", True, True, False), ("j", "u2", True, True, False), ("j", "u3", True, True, False), ("k", "u4", False, True, False), ("l", "u5", True, True, True)], "identity string, uri string, active boolean, in_scope boolean, conflict boolean")
    assert {r["identity"]: r["state"] for r in M.identity_state(c, ["s"]).collect()} == {"i": "resolved", "j": "ambiguous", "k": "not-found", "l": "ambiguous"}
    assert {r["state"] for r in M.identity_state(c, []).collect()} == {"not-found"}
    s = spark.createDataFrame([("a", "1", "1", False, "ready"), ("b", "1", "2", False, "ready"), ("c", "1", "1", True, "ready")], "project string, commit string, head string, dirty boolean, state string")
    assert {r["project"]: r["freshness"] for r in M.freshness(s).collect()} == {"a": "fresh", "b": "stale", "c": "unknown"}


def test_memory_documents_round_trip(spark):
    text = "MEMORY\nkind: durable\nstatus: active\nproject: p\nkeywords: a, b\n\nThe body\n\nkind: not a field"
    d = readers.parse_memory(spark.createDataFrame([("u", text)], "uri string, content string"))
    r = d.first()
    assert (r["document"], r["kind"], r["project"], r["keywords"], r["topic"]) == ("memory", "durable", "p", ["a", "b"], None) and r["body"].startswith("The body")
    assert readers.parse_memory(sinks.format_memory(d)).first() == r if hasattr(sinks, "format_memory") else readers.parse_memory(readers.format_memory(d)).first() == r


def test_chunks():
    text = "# A\n" + "line of text\n" * 400 + "## B\nshort\n"
    chunks = readers.chunk_text(text, 1000, 100)
    assert all(text[s : s + len(c)] == c and len(c) <= 1000 for _, s, c in chunks) and chunks[-1][0] == "## B"
    covered = set()
    for _, s, c in chunks:
        covered.update(range(s, s + len(c)))
    assert covered == set(range(len(text)))


def test_extractors(spark):
    f = spark.createDataFrame([("src/a.ts", "export class Foo {}\nexport function bar() {}\nimport x from './b'\n// WHY: because"), ("b.py", "class K:\n    def m(self):\n        pass\nfrom os.path import join"), ("package.json", '{"name": "n", "version": "1.0.0", "dependencies": {"d": "^1"}}')], "path string, content string")
    assert sorted((r["kind"], r["name"]) for r in readers.extract_symbols(f).collect()) == [("class", "Foo"), ("class", "K"), ("function", "bar"), ("function", "m")]
    assert sorted(r["module"] for r in readers.extract_imports(f).collect()) == ["./b", "os.path"]
    assert readers.rationale_markers(f).first()["text"] == "because"
    m = readers.manifest_components(f).first()
    assert (m["root"], m["name"], m["dependencies"]) == ("", "n", {"d": "^1"})
    assert {r["key"] for r in readers.schema_fields(f).collect()} == {"name", "version", "dependencies"}
    assert sorted(r["entry"] for r in readers.directory_listing(f).collect()) == ["b.py", "package.json", "src"]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "b.txt").write_bytes(b"a\x00b")
    got = {r["uri"].rsplit("/", 1)[1]: (r["excluded"], r["content"]) for r in readers.scan_files(spark, f"file://{tmp_path}/in").collect()}
    assert got == {"a.txt": (None, "hello"), "b.txt": ("binary", None)}
    s = spark.createDataFrame([("n<1", "x&y"), ("n2", "z")], "id string, name string")
    e = spark.createDataFrame([("e", "n<1", "n2"), ("open", "n2", None)], "id string, source_id string, target_id string")
    sinks.write_graph(s, e, f"file://{tmp_path}/g", "graphml")
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/g").collect()]
    assert len(lines) == 3 and any("n&lt;1" in x and "x&amp;y" in x for x in lines)
    files = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, content string")
    assert sinks.bundle_digest(sinks.bundle_plan(files)).first() == sinks.bundle_digest(sinks.bundle_plan(files.orderBy(F.desc("path")))).first()
    with pytest.raises(Exception, match="duplicate path"):
        sinks.bundle_plan(files.union(files)).collect()


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, S.l2_normalize(a)) == [0.6, 0.8] and one(spark, S.cosine(a, F.transform(a, lambda x: -x))) == -1.0
    assert one(spark, S.squash(F.lit(0.4))) == 0.4 and one(spark, S.squash(F.lit(float("nan")))) == 0.0 and one(spark, S.squash(F.lit(5.0))) > 0.99
    assert one(spark, S.global_score(F.lit(1), F.lit(1), F.lit(1), F.lit(True), F.lit(True))) == 1.0
    assert one(spark, S.quantile_at(F.array(*[F.lit(i) for i in range(1, 11)]), 0.5)) == 6


def test_write_checks(spark):
    old = spark.createDataFrame([("u", 2, "i"), ("v", 1, "j")], "uri string, generation int, identity string")
    new = spark.createDataFrame([("u", 2, "i"), ("v", 2, "j")], "uri string, generation int, identity string")
    assert [r["uri"] for r in M.violations_head(old, new).collect()] == ["u"]
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    assert [r["id"] for r in M.violations_immutable(a, spark.createDataFrame([("1", "x"), ("2", "z")], "id string, v string"), ["v"]).collect()] == ["2"]


def test_plans():
    assert P.split_budget(10, 4) == [3, 3, 2, 2] and P.physical_limit(10) == 256 and P.physical_limit(10_000) == 4096
    assert P.parse_endpoint("a/b.ts#Foo") == {"path": "a/b.ts", "symbol": "Foo"} and P.parse_endpoint("cgs_1") == {"id": "cgs_1"}
    assert [list(b) for b in P.expansion_batches(10)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert not P.refresh_required(False, True, True, "g", "g") and P.refresh_required(False, True, True, "g", "h")


def test_scan_is_pruned(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = docs.where(P.uri_scope(F.col("source"), ["src1"])).select("doc_id", "source")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "StringStartsWith(source,src1/)" in plan


def test_keyset(spark):
    d = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    assert [tuple(r) for r in R.keyset_page(d, ["a", "b"], (1, 1), 2).collect()] == [(1, 2), (2, 0)]
    assert [tuple(r) for r in R.mixed_keyset(d, [("a", False), ("b", True)], (1, 1), 2).collect()] == [(1, 0), (2, 2)]


def test_whole_graph_components_and_communities(spark, small):
    from quarrylake import adapters
    from quarrylake.queries import QUERIES

    def least_of(nodes, pairs):
        at = {n: n for n in nodes}

        def find(n):
            while at[n] != n:
                at[n] = at[at[n]]
                n = at[n]
            return n

        for a, b in pairs:
            for n in (a, b):
                at.setdefault(n, n)
            a, b = find(a), find(b)
            at[max(a, b)] = min(a, b)
        return {n: find(n) for n in nodes}

    symbols = adapters.symbols(spark, small).select("id", "path").collect()
    edges = adapters.edges(spark, small).where("target_id is not null").select("source_id", "target_id", "relation").collect()
    ids = {r["id"] for r in symbols}
    want = least_of(ids, [(e["source_id"], e["target_id"]) for e in edges])
    assert {r["id"]: r["root"] for r in QUERIES["components"](spark, small).collect()} == want
    first = {}
    for r in symbols:
        first[r["path"]] = min(r["id"], first.get(r["path"], r["id"]))
    ties = [(r["id"], first[r["path"]]) for r in symbols] + [(e["source_id"], e["target_id"]) for e in edges if e["relation"] in G.COHESIVE]
    assert {r["id"]: r["community"] for r in QUERIES["communities"](spark, small).collect()} == least_of(ids, ties)


def test_exact_scopes(spark):
    from quarrylake.plans import predicates as P

    asked = spark.createDataFrame([("What is the Status of the writing style?", "p"), ("post mortem of the on-call", None), ("where was I left", "p"), ("anything", None), (None, "p"), ("astonished tones", "p")], "q string, project string")
    rows = asked.select(P.scope_intents(F.col("q")).alias("i"), P.exact_scopes(F.col("q"), F.col("project"), "b", "agents", "repos", "ext", True).alias("s")).collect()
    assert [r["i"] for r in rows] == [["preferences", "handoffs"], ["incidents"], ["handoffs"], [], [], []]
    assert rows[0]["s"] == ["b/preferences", "b/handoffs/active/p", "b/shared", "ext", "b/handoffs/archived"]
    assert rows[1]["s"] == ["b/incidents/active", "b/shared", "ext", "b/incidents/archived"]
    assert rows[3]["s"] == ["b/preferences", "b/durable/projects", "b/handoffs/active", "b/incidents/active", "b/shared", "agents", "repos", "ext", "b/durable/archived", "b/handoffs/archived", "b/incidents/archived"]
    assert rows[4]["s"][1] == "b/durable/projects/p"
