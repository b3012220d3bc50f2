"""Graph snapshots: overlays, counts, scopes, adjacency, resolution, bridges, worksets and analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores as S, text as X
from .recall import numbered, term_top_k
from .traversal import written

COHESIVE = ("contains", "declares", "exports", "extends", "implements", "overrides", "reexports")
# Provenance order and the least confidence that needs no review.
PROVENANCE_ORDER = ("declared", "resolved", "syntactic", "heuristic", "model")
REVIEW_BELOW = {"declared": 0.9, "resolved": 0.9, "syntactic": 0.7, "heuristic": 0.45, "model": 0.35}
HIGH, MEDIUM = 0.9, 0.6


def effective(current: DataFrame, base: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """A snapshot over its base: its own rows, and base rows neither overridden nor deleted."""
    kept = base.join(current.select(key), key, "left_anti").join(deleted.select(key), key, "left_anti")
    return current.unionByName(kept.select(*current.columns))


def edge_priority() -> list:
    return [F.array_position(X.strings(PROVENANCE_ORDER), F.col("provenance")), F.desc("confidence"), "relation", "id"]


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def edge_audit(edges: DataFrame) -> DataFrame:
    """Counts by provenance and relation: clamped confidence, bands, endpoints, loops and rows for review. One aggregate."""
    c = F.col("confidence")
    bad = (c < 0) | (c > 1)
    least = F.lit(None).cast("double")
    for name, value in REVIEW_BELOW.items():
        least = F.when(F.col("provenance") == name, value).otherwise(least)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return edges.groupBy("provenance", "relation").agg(
        F.count("*").alias("count"), n(bad).alias("confidence_invalid"), F.round(F.sum(clamped(c)), 6).alias("confidence_total"), F.min(clamped(c)).alias("lowest_confidence"),
        n(c >= HIGH).alias("confidence_high"), n((c >= MEDIUM) & (c < HIGH)).alias("confidence_medium"), n(c < MEDIUM).alias("confidence_low"),
        n(F.col("source_id").isNull() | F.col("target_id").isNull()).alias("unresolved_endpoint_count"), n(F.col("source_id") == F.col("target_id")).alias("self_loop_count"), n(bad | (c < least)).alias("review_finding_count"),
    )


def endpoint_state() -> Column:
    s, t = F.col("source_id"), F.col("target_id")
    return F.when(s.isNull() & t.isNull(), "unresolved").when(s.isNull(), "source_missing").when(t.isNull(), "target_missing").when(s == t, "self_loop").otherwise("resolved")


def edge_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("provenance", "relation", F.round("confidence", 6).alias("confidence"), endpoint_state().alias("endpoint_state")).agg(F.count("*").alias("count"))


def symbol_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("language", "kind").agg(F.count("*").alias("count"))


def delta_counts(prior: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Counts kept up to date: prior counts, minus rows that went, plus rows that came."""
    parts = prior.select(*keys, "count").unionByName(removed.groupBy(*keys).agg((-F.count("*")).alias("count"))).unionByName(added.groupBy(*keys).agg(F.count("*").alias("count")))
    return parts.groupBy(*keys).agg(F.sum("count").alias("count")).where("count <> 0")


def scope_of(path: Column, package: Column) -> Column:
    """documentation paths together, else the package, else the first path segment."""
    return F.when(X.path_class(path) == "documentation", "documentation").when(F.coalesce(package, F.lit("")) != "", package).otherwise(F.substring_index(path, "/", 1))


def scope_rollup(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(scope_of(F.col("path"), F.col("package_name")).alias("scope")).agg(F.count("*").alias("symbol_count"), F.countDistinct("path").alias("file_count"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def scope_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges between scopes with their number and greatest confidence."""
    s = symbols.select("id", scope_of(F.col("path"), F.col("package_name")).alias("scope"))
    joined = edges.join(s.select(F.col("id").alias("source_id"), F.col("scope").alias("source_scope")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("scope").alias("target_scope")), "target_id")
    return joined.where("source_scope <> target_scope").groupBy("source_scope", "target_scope", "provenance", "relation").agg(F.count("*").alias("count"), F.max("confidence").alias("max_confidence"))


def adjacency(edges: DataFrame, frontier: DataFrame, direction: str = "both", provenances: tuple | None = None) -> DataFrame:
    """Edges of the frontier's nodes (one column, id). A self-loop counts once."""
    rows = edges.where(F.col("provenance").isin(*provenances)) if provenances else edges
    out = rows.join(frontier.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    into = rows.join(frontier.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return {"outgoing": out, "incoming": into}.get(direction) if direction != "both" else out.unionByName(into.select(*out.columns)).distinct()


def representative_edges(edges: DataFrame, nodes: DataFrame, limit: int = 4) -> DataFrame:
    """The best edges of each node in either direction, 2 to 16 a node."""
    k = max(2, min(16, limit))
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node"), "*").where("node is not null")
    return term_top_k(ends.join(nodes.select(F.col("id").alias("node")), "node", "left_semi"), k, ["node"], edge_priority())


def symbols_by_path(symbols: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    return term_top_k(symbols.join(paths, "path", "left_semi"), limit, ["path"], [F.desc("exported"), "qualified_name", "id"])


def exact_symbols(symbols: DataFrame, name: str, limit: int = 500) -> DataFrame:
    """Exact name, then qualified name, then the same ignoring ASCII case; then exported, kind, name, path, id."""
    n = F.lit(name)
    rank = F.when(F.col("name") == n, 0).when(F.col("qualified_name") == n, 1).when(F.lower("name") == F.lower(n), 2).when(F.lower("qualified_name") == F.lower(n), 3)
    return symbols.withColumn("exact_rank", rank).where("exact_rank is not null").orderBy("exact_rank", F.desc("exported"), X.kind_order(F.col("kind")), "name", "path", "id").limit(max(0, min(limit, 500)))


def symbol_terms(symbols: DataFrame) -> DataFrame:
    """(id, term, weight): name 5, qualified name 4, path 3, package 3."""
    weighted = lambda c, w: F.transform(X.normalized_terms(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    parts = [weighted(c, w) for c, w in (("name", 5), ("qualified_name", 4), ("path", 3), ("package_name", 3))]
    return symbols.select("id", F.explode(F.concat(*parts)).alias("x")).groupBy("id", F.col("x.term").alias("term")).agg(F.max("x.w").alias("weight"))


def _unions(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(keys, rows, n, low, high): how many symbols are under any of a set's keys, the least and the greatest.

    Symbols that are under the same ones of all sets' keys are one class, and a set meets the classes of its keys, so work does
    not grow with sets times symbols. A class is its number of keys, the least of them and two xors of 64-bit hashes of them: a
    wrong number needs two different sets of keys with all four alike.
    """
    keys = sets.select(F.explode("keys").alias("lookup_key")).distinct()
    under, key = Window.partitionBy("symbol_id"), F.col("lookup_key")
    marks = [F.count(key), F.min(key), F.bit_xor(F.xxhash64(key)), F.bit_xor(F.xxhash64(F.lit("other"), key))]
    classed = pairs.join(keys, "lookup_key", "left_semi").withColumn("class", F.struct(*[m.over(under).alias(f"m{i}") for i, m in enumerate(marks)]))
    told = classed.groupBy("lookup_key", "class").agg(F.count("*").alias("rows"), F.count("symbol_id").alias("n"), F.min("symbol_id").alias("low"), F.max("symbol_id").alias("high"))
    # a symbol is in one class, so the least one names it
    classes = written(told.drop("class"), "lookup-classes")
    met = sets.select("keys", F.explode("keys").alias("lookup_key")).join(classes, "lookup_key").drop("lookup_key").distinct()
    return met.groupBy("keys").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def tiered_resolution(references: DataFrame, lookup: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(reference_id, tiers array<array<string>>, self, relation) -> (reference_id, tier, matches, target_id).

    The first tier with a match decides: one target resolves, several leave the reference ambiguous and later tiers
    are not tried. An overrides reference does not match itself.

    References meet a row a key (how many symbols, the least and the greatest), never a key's symbols. Tiers of which two or
    more keys are known need the union of these: it is made once for each set of keys, however many references ask for it.
    Rows of one reference_id are one reference; only where such rows disagree in whom they leave out are symbols met one by one.
    only (reference_id): the references to resolve, if not all; what they ask for and is known meets them, not the references' rows.
    """
    pairs = written(lookup.select("lookup_key", "symbol_id").distinct(), "lookup")
    told = [F.count("*").alias("rows"), F.count("symbol_id").alias("n"), F.min("symbol_id").alias("low"), F.max("symbol_id").alias("high")]
    known = written(pairs.groupBy("lookup_key").agg(*told), "lookup-keys")
    tiers = references.select("reference_id", F.when(F.col("relation") == "overrides", F.struct("self_id")).alias("left_out"), F.posexplode("tiers").alias("tier", "keys"))
    asked = tiers.select("reference_id", "left_out", "tier", F.explode(F.array_distinct("keys")).alias("lookup_key"))
    ids = references.select("reference_id")
    if only is not None:
        asked, ids = asked.join(known.select("lookup_key"), "lookup_key", "left_semi").join(only, "reference_id", "left_semi"), ids.join(only, "reference_id", "left_semi")
    left, all_ = F.count("left_out"), F.count("*")
    odd = (left > 0) & ((left < all_) | ~F.min("left_out").eqNullSafe(F.max("left_out")))
    met = asked.join(known, "lookup_key").groupBy("reference_id", "tier").agg(F.array_sort(F.collect_set("lookup_key")).alias("keys"), F.max("rows").alias("rows"), F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("left_out").alias("left_out"), odd.alias("odd"))
    met = written(met, "lookup-tiers")
    one, some = met.where("not odd and size(keys) = 1").drop("keys", "odd"), met.where("not odd and size(keys) > 1").select("reference_id", "tier", "left_out", "keys")
    union = _unions(written(some.select("keys").distinct(), "lookup-sets"), pairs)
    found = one.unionByName(some.join(union, "keys").drop("keys"))
    # an overrides reference whose own symbol is under one of the tier's keys: one match less
    asks = met.where("not odd and left_out is not null").select("reference_id", "tier", "left_out", F.explode("keys").alias("lookup_key"))
    own = asks.join(pairs, (asks["lookup_key"] == pairs["lookup_key"]) & F.col("left_out.self_id").eqNullSafe(F.col("symbol_id")), "left_semi").select("reference_id", "tier").distinct()
    over = found.where("left_out is not null").join(own.withColumn("own", F.lit(1)), ["reference_id", "tier"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    found = found.where("left_out is null").withColumn("own", F.lit(0)).unionByName(over).where("rows > own")
    itself = F.col("left_out.self_id")
    matches = F.col("n") - F.when(itself.isNotNull(), F.col("own")).otherwise(0)
    only_one = F.when((F.col("own") == 1) & F.col("low").eqNullSafe(itself), F.col("high")).otherwise(F.col("low"))
    by_tier = found.select("reference_id", "tier", matches.alias("matches"), only_one.alias("symbol_id"))
    disagree = written(met.where("odd").select("reference_id", "tier"), "lookup-odd")
    if not disagree.isEmpty():
        plain = asked.join(known.select("lookup_key"), "lookup_key", "left_semi").join(disagree, ["reference_id", "tier"], "left_semi").join(pairs, "lookup_key").where("left_out is null or not symbol_id <=> left_out.self_id")
        by_tier = by_tier.unionByName(plain.groupBy("reference_id", "tier").agg(F.countDistinct("symbol_id").alias("matches"), F.min("symbol_id").alias("symbol_id")))
    first = by_tier.groupBy("reference_id").agg(F.min(F.struct("tier", "matches", "symbol_id")).alias("m"))
    return ids.join(first, "reference_id", "left").select("reference_id", F.col("m.tier").alias("tier"), F.coalesce("m.matches", F.lit(0)).alias("matches"), F.when(F.col("m.matches") == 1, F.col("m.symbol_id")).alias("target_id"))


def bridges(imports: DataFrame, exports: DataFrame, compatible: Column | None = None) -> DataFrame:
    """(repository, identity, version) imports against exports of other repositories: bridge, ambiguous or incompatible.

    An import that its own repository exports is left to local resolution. Imports that agree in all but import_id meet the
    exports once; compatible may use any other column of theirs, version and producer_version among them.
    """
    ex = exports.select("identity", F.col("repository").alias("producer"), F.col("version").alias("producer_version"), F.col("symbol_id").alias("producer_symbol"))
    alike = [c for c in imports.columns if c != "import_id"]
    fits = compatible if compatible is not None else F.coalesce(F.col("version") == F.col("producer_version"), F.lit(True))
    told = imports.select(*alike).distinct().join(ex, "identity").groupBy(*alike).agg(F.max(F.when(F.col("producer") == F.col("repository"), 1).otherwise(0)).alias("local"), F.count("*").alias("candidates"), F.count(F.when(fits, 1)).alias("fitting"), F.min(F.when(fits, F.col("producer"))).alias("producer"))
    told = written(told.withColumnsRenamed({c: f"_{c}" for c in alike}), "imports-alike")
    j = imports.join(told, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]))
    n = j.groupBy("repository", "identity", "import_id").agg(F.max("local").alias("local"), F.sum("candidates").alias("candidates"), F.sum("fitting").alias("fitting"), F.min("producer").alias("producer"))
    state = F.when(F.col("fitting") == 1, "bridge").when(F.col("fitting") > 1, "ambiguous-producer").otherwise("incompatible-package-version")
    return n.where("local = 0").select("repository", "identity", "import_id", state.alias("state"), F.when(F.col("fitting") > 1, F.col("fitting")).otherwise(F.col("candidates")).alias("candidates"), F.when(F.col("fitting") == 1, F.col("producer")).alias("producer"))


def workset_lane(rows: DataFrame, per_member: int, limit: int) -> DataFrame:
    """(ordinal, node_id, exported, lane_priority): best row a node, per_member fair places a member, then one catalog order.

    The last window has no partition; its input is per_member rows a member at most.
    """
    one = rows.groupBy("ordinal", "node_id").agg(F.max("exported").alias("exported"), F.min("lane_priority").alias("lane_priority"))
    fair = one.withColumn("member_rank", F.row_number().over(Window.partitionBy("ordinal").orderBy("lane_priority", F.desc("exported"), "node_id"))).where(F.col("member_rank") <= per_member)
    cut = fair.orderBy("lane_priority", F.desc("exported"), "ordinal", "node_id").limit(limit)
    return cut.withColumn("catalog_rank", F.row_number().over(Window.orderBy("lane_priority", F.desc("exported"), "ordinal", "node_id")))


def diversity_first(cards: DataFrame, repositories: int = 4, limit: int | None = None) -> DataFrame:
    """The best card of each of the leading repositories first, then the rest by score; the first limit of them.

    Without a limit the order is numbered over written, sorted partitions, so that no task sees all cards.
    """
    best = cards.withColumn("rn", F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("score"), "id"))).where("rn = 1")
    lead = best.orderBy(F.desc("score"), "id").limit(repositories).select("id", "repository", F.lit(0).alias("first"))
    rows = cards.join(lead, ["id", "repository"], "left").withColumn("first", F.coalesce("first", F.lit(1)))
    order = ["first", F.desc("score"), "id"]
    if limit is None:
        return numbered(rows, order).drop("first")
    return rows.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order))).drop("first")


def hubs(edges: DataFrame, symbols: DataFrame, spread: float = 2.0, god: float = 4.0) -> DataFrame:
    """Nodes whose degree is spread (hub) or god deviations above the mean. Loops and open ends do not count.

    The reference's own thresholds are not known; these are mean + k deviations, hub below god node.
    """
    e = edges.where("source_id is not null and target_id is not null and source_id <> target_id")
    ends = e.select(F.col("source_id").alias("id"), F.lit(0).alias("i")).unionByName(e.select(F.col("target_id").alias("id"), F.lit(1).alias("i")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("i").alias("incoming"))
    limits = degree.agg((F.avg("degree") + spread * F.stddev_pop("degree")).alias("hub_at"), (F.avg("degree") + god * F.stddev_pop("degree")).alias("god_at"))
    rows = degree.crossJoin(limits).where("degree >= hub_at")  # limits is one row
    return rows.join(symbols.select("id", "qualified_name"), "id").select("id", "qualified_name", "degree", "incoming", F.when(F.col("degree") >= F.col("god_at"), "god-node").otherwise("hub").alias("level"))


def surprising_links(edges: DataFrame, community: DataFrame) -> DataFrame:
    """The strongest edge between each two communities: surprise is confidence over the number of edges between them."""
    c = community.select("id", "community")
    j = edges.join(c.select(F.col("id").alias("source_id"), F.col("community").alias("c1")), "source_id").join(c.select(F.col("id").alias("target_id"), F.col("community").alias("c2")), "target_id").where("c1 <> c2")
    j = j.withColumn("low", F.least("c1", "c2")).withColumn("high", F.greatest("c1", "c2"))
    strength = clamped(F.col("confidence"))
    best = j.groupBy("low", "high").agg(F.min_by("id", F.struct((-F.round(strength, 12)).alias("c"), "id")).alias("id"), F.max(strength).alias("c"), F.count("*").alias("n"))
    return best.select("low", "high", "id", F.round(F.col("c") / F.col("n"), 6).alias("score"))


def relationship_groups(edges: DataFrame, least: int) -> DataFrame:
    """Fan-outs and fan-ins of one relation with least members or more; members are counted, not gathered."""
    e = edges.where("source_id is not null and target_id is not null")
    fan = lambda center, other, direction: e.groupBy(F.col(center).alias("center"), F.lit(direction).alias("direction"), "relation").agg(F.countDistinct(other).alias("members"), F.min(other).alias("first_member"))
    return fan("source_id", "target_id", "outgoing").unionByName(fan("target_id", "source_id", "incoming")).where(F.col("members") >= least)


def prefix_range(files: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """Files below any requested root, at most limit, one row more telling of overflow. Segments of each path are probed by equality, so no nested loop is needed."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hit = files.select("path", F.explode(steps).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct()
    return hit.orderBy("path").limit(limit + 1)


def nearest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path -> the project whose root is its longest ancestor, source roots before project roots."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hits = paths.select("path", F.explode(steps).alias("root")).join(roots, "root")
    best = hits.groupBy("path").agg(F.min(F.struct(F.when(F.col("kind") == "source", 0).otherwise(1).alias("k"), (-F.length("root")).alias("l"), F.col("project"))).alias("b"))
    return paths.join(best, "path", "left").select("path", F.col("b.project").alias("project"))


def components_summary(labels: DataFrame) -> DataFrame:
    return labels.groupBy("root").agg(F.count("*").alias("size"))
