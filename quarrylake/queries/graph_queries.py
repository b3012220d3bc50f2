"""Graph queries over the business tables as nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import edges, read, snapshot_symbols, sql, symbols
from ..functions import text as X, versions as V
from ..operators import graph as G, traversal as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


_EFFECTIVE = "effective AS (SELECT * FROM overlay_symbols UNION ALL SELECT * FROM base_symbols b WHERE b.id NOT IN (SELECT id FROM overlay_symbols) AND b.id NOT IN (SELECT id FROM tombstones))"


@query(sql("symbols snapshot", f"WITH {_EFFECTIVE} SELECT id, name, path, exported FROM effective"))
def effective_snapshot(spark, d):
    base, overlay, gone = snapshot_symbols(spark, d)
    return G.effective(overlay, base, gone).select("id", "name", "path", "exported")


@query(sql("symbols", "SELECT language, kind, count(*) AS count FROM symbols GROUP BY ALL"))
def symbol_counts(spark, d):
    return G.symbol_counts(symbols(spark, d))


@query(sql("edges", """SELECT provenance, relation, count(*) AS count, CAST(sum(CASE WHEN confidence < 0 OR confidence > 1 THEN 1 ELSE 0 END) AS BIGINT) AS confidence_invalid, round(sum(greatest(0.0, least(1.0, confidence))), 3) AS confidence_total, min(greatest(0.0, least(1.0, confidence))) AS lowest_confidence,
  CAST(sum(CASE WHEN confidence >= 0.9::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS confidence_high, CAST(sum(CASE WHEN confidence >= 0.6::DOUBLE AND confidence < 0.9::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS confidence_medium, CAST(sum(CASE WHEN confidence < 0.6::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS confidence_low,
  CAST(sum(CASE WHEN source_id IS NULL OR target_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_endpoint_count, CAST(sum(CASE WHEN source_id = target_id THEN 1 ELSE 0 END) AS BIGINT) AS self_loop_count,
  CAST(sum(CASE WHEN confidence < 0 OR confidence > 1 OR confidence < CASE provenance WHEN 'declared' THEN 0.9::DOUBLE WHEN 'resolved' THEN 0.9::DOUBLE WHEN 'syntactic' THEN 0.7::DOUBLE WHEN 'heuristic' THEN 0.45::DOUBLE WHEN 'model' THEN 0.35::DOUBLE END THEN 1 ELSE 0 END) AS BIGINT) AS review_finding_count
FROM edges GROUP BY provenance, relation"""))
def edge_audit(spark, d):
    return G.edge_audit(edges(spark, d)).withColumn("confidence_total", F.round("confidence_total", 3))


@query(sql("edges", "SELECT provenance, relation, round(confidence, 6) AS confidence, CASE WHEN source_id IS NULL AND target_id IS NULL THEN 'unresolved' WHEN source_id IS NULL THEN 'source_missing' WHEN target_id IS NULL THEN 'target_missing' WHEN source_id = target_id THEN 'self_loop' ELSE 'resolved' END AS endpoint_state, count(*) AS count FROM edges GROUP BY ALL"))
def edge_histogram(spark, d):
    return G.edge_histogram(edges(spark, d))


@query(sql("symbols snapshot", f"WITH {_EFFECTIVE} SELECT path, exported, count(*) AS count FROM effective GROUP BY ALL"))
def overlay_delta_counts(spark, d):
    base, overlay, gone = snapshot_symbols(spark, d)
    prior = base.groupBy("path", "exported").agg(F.count("*").alias("count"))
    affected = overlay.select("id").unionByName(gone).distinct()
    return G.delta_counts(prior, base.join(affected, "id", "left_semi"), overlay, ["path", "exported"])


_SCOPE = "CASE WHEN path LIKE 'docs/%' OR path LIKE '%.md' THEN 'documentation' WHEN coalesce(package_name, '') <> '' THEN package_name ELSE split_part(path, '/', 1) END"


@query(sql("symbols", f"SELECT {_SCOPE} AS scope, count(*) AS symbol_count, count(DISTINCT path) AS file_count, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM symbols GROUP BY 1"))
def scope_rollup(spark, d):
    return G.scope_rollup(symbols(spark, d))


@query(sql("symbols edges", f"WITH s AS (SELECT id, {_SCOPE} AS scope FROM symbols) SELECT a.scope AS source_scope, b.scope AS target_scope, provenance, relation, count(*) AS count, max(confidence) AS max_confidence FROM edges e JOIN s a ON a.id = e.source_id JOIN s b ON b.id = e.target_id WHERE a.scope <> b.scope GROUP BY ALL"))
def scope_edges(spark, d):
    return G.scope_edges(edges(spark, d), symbols(spark, d))


@query(sql("symbols edges", "SELECT a.package_name AS source, b.package_name AS target, relation, count(*) AS count, round(max(confidence), 6) AS confidence FROM edges e JOIN symbols a ON a.id = e.source_id JOIN symbols b ON b.id = e.target_id GROUP BY ALL"))
def component_edges(spark, d):
    s = symbols(spark, d).select("id", "package_name")
    j = edges(spark, d).join(s.select(F.col("id").alias("source_id"), F.col("package_name").alias("source")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("package_name").alias("target")), "target_id")
    return j.groupBy("source", "target", "relation").agg(F.count("*").alias("count"), F.round(F.max("confidence"), 6).alias("confidence"))


@query(sql("edges", "SELECT id, source_id, target_id, relation FROM (SELECT DISTINCT * FROM edges WHERE source_id IN ('nation:3', 'customer:7', 'order:5') OR target_id IN ('nation:3', 'customer:7', 'order:5'))"))
def adjacency_both(spark, d):
    f = spark.createDataFrame([("nation:3",), ("customer:7",), ("order:5",)], "id string")
    return G.adjacency(edges(spark, d), f).select("id", "source_id", "target_id", "relation")


_PRIORITY = "CASE provenance WHEN 'declared' THEN 1 WHEN 'resolved' THEN 2 WHEN 'syntactic' THEN 3 WHEN 'heuristic' THEN 4 ELSE 5 END, confidence DESC, relation, id"


@query(sql("edges", f"WITH ends AS (SELECT source_id AS node, * FROM edges WHERE source_id IS NOT NULL UNION ALL SELECT target_id AS node, * FROM edges WHERE target_id IS NOT NULL AND target_id IS DISTINCT FROM source_id) SELECT node, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {_PRIORITY}) AS rank FROM ends) WHERE rank <= 3"))
def representative_edges(spark, d):
    return G.representative_edges(edges(spark, d), symbols(spark, d), 3).select("node", "id", F.col("rank").cast("long").alias("rank"))


@query(sql("symbols", "SELECT path, id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY exported DESC, qualified_name, id) AS r FROM symbols WHERE starts_with(path, 'app/') OR starts_with(path, 'docs/')) WHERE r <= 5"))
def symbols_by_path(spark, d):
    s = symbols(spark, d)
    paths = s.where(F.col("path").startswith("app/") | F.col("path").startswith("docs/")).select("path").distinct()
    return G.symbols_by_path(s, paths, 5).select("path", "id")


@query(sql("symbols", "SELECT id, exact_rank FROM (SELECT *, CASE WHEN name = 'order33' THEN 0 WHEN qualified_name = 'order33' THEN 1 WHEN lower(name) = 'order33' THEN 2 WHEN lower(qualified_name) = 'order33' THEN 3 END AS exact_rank FROM symbols) WHERE exact_rank IS NOT NULL"))
def exact_symbol_rank(spark, d):
    return G.exact_symbols(symbols(spark, d), "order33").select("id", "exact_rank")


def _references(spark, d):
    """Each order refers to its part names, then its customer; a third of them first to a shared segment."""
    o = read(spark, d, "orders")
    tier1 = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("seg"), (F.col("o_custkey") % 40).cast("string")))).otherwise(F.array(F.lit("nothing")))
    return o.select(F.col("o_orderkey").alias("reference_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("self_id"), F.when(F.col("o_orderkey") % 5 == 0, "overrides").otherwise("calls").alias("relation"), F.array(tier1, F.array(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")))).alias("tiers"))


@query("""WITH refs AS (SELECT o_orderkey AS reference_id, 'customer:' || o_custkey AS self_id, CASE WHEN o_orderkey % 5 = 0 THEN 'overrides' ELSE 'calls' END AS relation, CASE WHEN o_orderkey % 3 = 0 THEN 'seg' || (o_custkey % 40) ELSE 'nothing' END AS k0, 'cust' || o_custkey AS k1 FROM orders),
  lookup AS (SELECT 'seg' || (c_custkey % 60) AS lookup_key, 'customer:' || c_custkey AS symbol_id FROM customer UNION ALL SELECT 'cust' || c_custkey, 'customer:' || c_custkey FROM customer),
  m AS (SELECT reference_id, 0 AS tier, symbol_id FROM refs JOIN lookup ON k0 = lookup_key WHERE NOT (relation = 'overrides' AND symbol_id = self_id) UNION ALL SELECT reference_id, 1, symbol_id FROM refs JOIN lookup ON k1 = lookup_key WHERE NOT (relation = 'overrides' AND symbol_id = self_id)),
  t AS (SELECT reference_id, tier, count(DISTINCT symbol_id) AS matches, min(symbol_id) AS symbol_id FROM m GROUP BY ALL)
SELECT r.reference_id, t.tier, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN symbol_id END AS target_id FROM refs r LEFT JOIN (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY reference_id ORDER BY tier) = 1) t ON r.reference_id = t.reference_id""")
def tiered_resolution(spark, d):
    c = read(spark, d, "customer")
    sym = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("symbol_id")
    lookup = c.select(F.concat(F.lit("seg"), (F.col("c_custkey") % 60).cast("string")).alias("lookup_key"), sym).unionByName(c.select(F.concat(F.lit("cust"), F.col("c_custkey").cast("string")).alias("lookup_key"), sym))
    return G.tiered_resolution(_references(spark, d), lookup).select("reference_id", "tier", "matches", "target_id")


@query("""WITH imports AS (SELECT 'r' || (p_size % 10) AS repository, p_brand || '/' || p_type AS identity, p_partkey AS import_id, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size % 5 AS VARCHAR) END AS version FROM part),
  exports AS (SELECT DISTINCT 'r' || (10 + p_size % 3) AS repository, p_brand || '/' || p_type AS identity, CAST(p_size % 5 AS VARCHAR) AS version, 'x' || (p_size % 15) AS symbol_id FROM part),
  n AS (SELECT i.repository, i.identity, import_id, count(*) AS candidates, count(CASE WHEN coalesce(i.version = e.version, true) THEN 1 END) AS fitting, min(CASE WHEN coalesce(i.version = e.version, true) THEN e.repository END) AS producer, max(CASE WHEN e.repository = i.repository THEN 1 ELSE 0 END) AS local FROM imports i JOIN exports e USING (identity) GROUP BY ALL)
SELECT repository, identity, import_id, CASE WHEN fitting = 1 THEN 'bridge' WHEN fitting > 1 THEN 'ambiguous-producer' ELSE 'incompatible-package-version' END AS state, CASE WHEN fitting > 1 THEN fitting ELSE candidates END AS candidates, CASE WHEN fitting = 1 THEN producer END AS producer FROM n WHERE local = 0""")
def bridge_resolution(spark, d):
    p = read(spark, d, "part")
    identity = F.concat_ws("/", "p_brand", "p_type").alias("identity")
    imports = p.select(F.concat(F.lit("r"), (F.col("p_size") % 10).cast("string")).alias("repository"), identity, F.col("p_partkey").alias("import_id"), F.when(F.col("p_partkey") % 4 == 0, (F.col("p_size") % 5).cast("string")).alias("version"))
    exports = p.select(F.concat(F.lit("r"), (F.lit(10) + F.col("p_size") % 3).cast("string")).alias("repository"), identity, (F.col("p_size") % 5).cast("string").alias("version"), F.concat(F.lit("x"), (F.col("p_size") % 15).cast("string")).alias("symbol_id")).distinct()
    return G.bridges(imports, exports)


@query("""WITH v AS (SELECT p_partkey, p_size % 3 AS a, p_partkey % 4 AS b, p_partkey % 7 AS c, p_size % 2 AS x, p_partkey % 5 AS y, p_size % 11 = 0 AS pre, p_partkey % 6 AS shape FROM part),
  t AS (SELECT *, a * 10000 + b * 100 + c AS ver, x * 10000 + y * 100 AS low FROM v)
SELECT p_partkey, CASE WHEN pre THEN false WHEN shape = 0 THEN ver >= low AND ver < CASE WHEN x > 0 THEN (x + 1) * 10000 WHEN y > 0 THEN (y + 1) * 100 ELSE 1 END WHEN shape = 1 THEN ver >= low AND ver < low + 100 WHEN shape = 2 THEN ver > low AND ver <= 20000 WHEN shape = 3 THEN a = x
  WHEN shape = 4 THEN ver >= low AND ver <= 20102 ELSE a = 0 OR ver >= 20000 END AS fits FROM t""")
def npm_compatibility(spark, d):
    n = lambda c: c.cast("string")
    a, b, c, x, y = F.col("p_size") % 3, F.col("p_partkey") % 4, F.col("p_partkey") % 7, F.col("p_size") % 2, F.col("p_partkey") % 5
    base = F.concat_ws(".", n(x), n(y), F.lit("0"))
    version = F.concat(F.concat_ws(".", n(a), n(b), n(c)), F.when(F.col("p_size") % 11 == 0, "-rc.1").otherwise(""))
    shapes = (F.concat(F.lit("^"), base), F.concat(F.lit("~ "), base), F.concat(F.lit(">"), base, F.lit(", <= 2.0.0")), F.concat(n(x), F.lit(".x")), F.concat(base, F.lit(" - 2.1.2")))
    constraint = F.lit("0.* || >=2")
    for k, shape in enumerate(shapes):
        constraint = F.when(F.col("p_partkey") % 6 == k, shape).otherwise(constraint)
    return read(spark, d, "part").select("p_partkey", V.npm_compatible(constraint, version).alias("fits"))


@query("""WITH v AS (SELECT p_partkey, p_size % 3 AS a, p_partkey % 4 AS b, p_size % 4 AS pre, p_size % 2 AS x, p_partkey % 3 AS y, p_partkey % 5 AS other FROM part), k AS (SELECT p_partkey, (a, b, CASE WHEN pre = 0 THEN 99 ELSE pre + 8 END) AS l, (x, y, CASE WHEN other = 0 THEN 99 ELSE other + 8 END) AS r FROM v)
SELECT p_partkey, CASE WHEN l > r THEN 1 WHEN l < r THEN -1 ELSE 0 END AS comparison FROM k""")
def semver_comparison(spark, d):
    n = lambda c: c.cast("string")
    pre = lambda c: F.when(c == 0, "").otherwise(F.concat(F.lit("-rc."), n(c + 8)))
    left = F.concat(n(F.col("p_size") % 3), F.lit("."), n(F.col("p_partkey") % 4), F.lit(".0"), pre(F.col("p_size") % 4))
    right = F.concat(n(F.col("p_size") % 2), F.lit("."), n(F.col("p_partkey") % 3), F.lit(".0"), pre(F.col("p_partkey") % 5))
    return read(spark, d, "part").select("p_partkey", V.semver_compare(left, right).alias("comparison"))


@query("""WITH rows AS (SELECT CAST(s_nationkey AS BIGINT) AS ordinal, l_partkey AS node_id, l_linenumber % 2 = 0 AS exported, CAST(l_linenumber % 3 AS BIGINT) AS lane_priority FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  one AS (SELECT ordinal, node_id, max(exported) AS exported, min(lane_priority) AS lane_priority FROM rows GROUP BY ALL), fair AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY lane_priority, exported DESC, node_id) <= 6)
SELECT ordinal, node_id, exported, lane_priority, row_number() OVER (ORDER BY lane_priority, exported DESC, ordinal, node_id) AS catalog_rank FROM fair ORDER BY catalog_rank LIMIT 80""")
def workset_exact_lane(spark, d):
    l, s = read(spark, d, "lineitem"), read(spark, d, "supplier")
    rows = l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").cast("long").alias("ordinal"), F.col("l_partkey").alias("node_id"), (F.col("l_linenumber") % 2 == 0).alias("exported"), (F.col("l_linenumber") % 3).cast("long").alias("lane_priority"))
    return G.workset_lane(rows, 6, 80).select("ordinal", "node_id", "exported", "lane_priority", F.col("catalog_rank").cast("long").alias("catalog_rank"))


@query(r"""WITH t AS (SELECT p_brand AS repository, p_partkey AS id, list_slice(list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[\p{L}\p{N}_$.-]{2,}')), 1, 1000) AS terms FROM part),
  c AS (SELECT repository, id, round(0.5::DOUBLE + (id % 89) / 200.0::DOUBLE + len(terms) / 100.0::DOUBLE, 6) AS score FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY score DESC, id) AS rn FROM c),
  lead AS (SELECT repository, row_number() OVER (ORDER BY score DESC, id) AS k FROM r WHERE rn = 1)
SELECT repository, id, score, row_number() OVER (ORDER BY CASE WHEN rn = 1 AND k <= 4 THEN 0 ELSE 1 END, score DESC, id) AS position FROM r JOIN lead USING (repository) ORDER BY position LIMIT 60""")
def diversity_rank(spark, d):
    cards = read(spark, d, "part").select(F.col("p_brand").alias("repository"), F.col("p_partkey").alias("id"), F.round(F.lit(0.5) + (F.col("p_partkey") % 89) / 200.0 + F.size(X.normalized_terms(F.col("p_name"))) / 100.0, 6).alias("score"))
    return G.diversity_first(cards, limit=60).select("repository", "id", "score", F.col("position").cast("long").alias("position"))


@query("""WITH RECURSIVE links AS (SELECT 'r' || n_regionkey AS alias_of, 'n' || n_nationkey AS alias FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
  reach(root, key) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT r.root, l.alias FROM reach r JOIN links l ON l.alias_of = r.key) SELECT root, key FROM reach""")
def reexport_closure(spark, d):
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    link = lambda t, p, a, q, b: read(spark, d, t).select(named(p, a).alias("alias_of"), named(q, b).alias("alias"))
    links = link("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(link("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(link("orders", "c", "o_custkey", "o", "o_orderkey")).unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey"))
    return T.alias_closure(links, read(spark, d, "region").select(named("r", "r_regionkey").alias("key")))


@query(sql("edges", """RECURSIVE walk(id, depth) AS (SELECT 'order:1', 0 UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_id = w.id WHERE w.depth < 3 AND e.target_id IS NOT NULL) SELECT id, min(depth) AS depth FROM walk GROUP BY id"""))
def bfs_reach(spark, d):
    return T.reach(edges(spark, d), spark.createDataFrame([("order:1",)], "id string"), 3).select("id", "depth")


@query(sql("edges", """RECURSIVE walk(id, depth, path) AS (SELECT 'order:1', 0, ['order:1'] UNION ALL SELECT e.target_id, w.depth + 1, list_append(w.path, e.target_id) FROM walk w JOIN edges e ON e.source_id = w.id WHERE w.depth < 6 AND e.target_id IS NOT NULL),
  best AS (SELECT path FROM walk WHERE id = (SELECT 'nation:' || c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey = 1) ORDER BY depth, path LIMIT 1)
SELECT CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS step, unnest(path) AS id FROM best"""))
def bfs_path(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderkey = 1"), F.col("c_custkey") == F.col("o_custkey"))
    to = c.select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))).first()
    return T.shortest_path(edges(spark, d), "order:1", to[0] if to else "", 6).select("step", "id")


@query(sql("edges", """RECURSIVE walk(id, depth) AS (SELECT 'nation:3', 0 UNION SELECT e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.id WHERE w.depth < 3 AND e.source_id IS NOT NULL) SELECT id, min(depth) AS depth FROM walk WHERE id <> 'nation:3' GROUP BY id"""))
def impact_reverse(spark, d):
    return T.impact(edges(spark, d), spark.createDataFrame([("nation:3",)], "id string"), 3).select("id", "depth")


@query()
def components(spark, d):
    """The whole graph; a recursive query would list each pair of a component, so tests compare it with a union-find."""
    return T.components(edges(spark, d), symbols(spark, d))


@query()
def communities(spark, d):
    """Components over cohesive relations and files, of the whole graph; tests compare it with a union-find."""
    return T.communities(edges(spark, d), symbols(spark, d), G.COHESIVE)


@query(sql("symbols edges", """WITH ends AS (SELECT source_id AS id, 0 AS i FROM edges WHERE target_id IS NOT NULL AND source_id <> target_id UNION ALL SELECT target_id, 1 FROM edges WHERE target_id IS NOT NULL AND source_id <> target_id),
  deg AS (SELECT id, count(*) AS degree, CAST(sum(i) AS BIGINT) AS incoming FROM ends GROUP BY id), lim AS (SELECT avg(degree) + 2 * stddev_pop(degree) AS h, avg(degree) + 4 * stddev_pop(degree) AS g FROM deg)
SELECT deg.id, qualified_name, degree, incoming, CASE WHEN degree >= g THEN 'god-node' ELSE 'hub' END AS level FROM deg JOIN symbols USING (id), lim WHERE degree >= h"""))
def hubs(spark, d):
    return G.hubs(edges(spark, d), symbols(spark, d))


@query(sql("symbols edges", """WITH c AS (SELECT id, package_name AS community FROM symbols), j AS (SELECT e.id, least(a.community, b.community) AS low, greatest(a.community, b.community) AS high, greatest(0.0, least(1.0, confidence)) AS cc FROM edges e JOIN c a ON a.id = e.source_id JOIN c b ON b.id = e.target_id WHERE a.community <> b.community),
  s AS (SELECT low, high, id, round(cc / count(*) OVER (PARTITION BY low, high), 6) AS score FROM j) SELECT low, high, id, score FROM s QUALIFY row_number() OVER (PARTITION BY low, high ORDER BY score DESC, id) = 1"""))
def surprising_links(spark, d):
    return G.surprising_links(edges(spark, d), symbols(spark, d).select("id", F.col("package_name").alias("community")))


@query(sql("edges", """SELECT source_id AS center, 'outgoing' AS direction, relation, count(DISTINCT target_id) AS members, min(target_id) AS first_member FROM edges WHERE target_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT target_id) >= 5
UNION ALL SELECT target_id, 'incoming', relation, count(DISTINCT source_id), min(source_id) FROM edges WHERE target_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source_id) >= 5"""))
def relationship_groups(spark, d):
    return G.relationship_groups(edges(spark, d), 5)


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def except_mismatch(spark, d):
    a, b = read(spark, d, "customer").select(F.col("c_custkey").alias("k")), read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).union(b.subtract(a))


@query(sql("symbols", "SELECT path FROM (SELECT DISTINCT path FROM symbols WHERE starts_with(path, 'app/') OR starts_with(path, 'src/Brand#1/') OR path = 'tests/3.py') ORDER BY path LIMIT 129"))
def prefix_range_join(spark, d):
    return G.prefix_range(symbols(spark, d), spark.createDataFrame([("app",), ("src/Brand#1",), ("tests/3.py",)], "root string"), 128)


@query(sql("symbols", "SELECT path, CASE WHEN starts_with(path, 'src/nation/') THEN 'nation' WHEN starts_with(path, 'src/') THEN 'source' WHEN starts_with(path, 'app/') THEN 'app' END AS project FROM (SELECT DISTINCT path FROM symbols)"))
def project_attribution(spark, d):
    roots = spark.createDataFrame([("src", "source", "source"), ("src/nation", "source", "nation"), ("app", "project", "app")], "root string, kind string, project string")
    return G.nearest_prefix(symbols(spark, d).select("path").distinct(), roots)


@query(sql("symbols", r"""WITH f AS (SELECT id, unnest([struct_pack(v := name, w := 5), struct_pack(v := qualified_name, w := 4), struct_pack(v := path, w := 3), struct_pack(v := package_name, w := 3)]) AS x FROM symbols),
  t AS (SELECT id, x.w AS w, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(x.v, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[\p{L}\p{N}_$.-]{2,}'))) AS term FROM f)
SELECT id, term, max(w) AS weight FROM t GROUP BY ALL"""))
def symbol_terms(spark, d):
    return G.symbol_terms(symbols(spark, d))


@query(sql("symbols", "SELECT path, CASE WHEN path LIKE 'docs/%' OR path LIKE '%.md' THEN 'documentation' WHEN path LIKE 'tests/%' THEN 'test' ELSE 'implementation' END AS path_class, CASE WHEN path LIKE 'docs/%' OR path LIKE '%.md' THEN 0.55::DOUBLE WHEN path LIKE 'tests/%' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM (SELECT DISTINCT path FROM symbols)"))
def path_classes(spark, d):
    none = F.array().cast("array<string>")
    return symbols(spark, d).select("path").distinct().select("path", X.path_class(F.col("path")).alias("path_class"), X.path_multiplier(F.col("path"), none).alias("multiplier"))
