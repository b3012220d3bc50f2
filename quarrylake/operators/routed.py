"""Queries over many repositories in two stages: a router ranks repositories, the best are searched in batches until there is evidence.

All queries of a batch go through the stages together: the router joins terms with a catalog of a row a repository and
term; each phase then searches, for the queries that still want evidence, only the repositories it has just selected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .recall import term_top_k
from .traversal import written

#: Repositories of each phase; the last number holds for all later ones.
SCHEDULE = (4, 4, 16)
#: A route is ambiguous where the first repository outside of the first phase has this share (in tenths) of the best score.
AMBIGUOUS_TENTHS = 8


def catalog_of(postings: DataFrame) -> DataFrame:
    """(repository, term, weight, symbols): the router's catalog of postings (repository, symbol_id, term, weight)."""
    return postings.groupBy("repository", "term").agg(F.max("weight").alias("weight"), F.countDistinct("symbol_id").alias("symbols"))


def route(terms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, repository, score, rank, ambiguous): repositories that know a term (query_id, term), best first."""
    met = terms.distinct().join(catalog, "term").groupBy("query_id", "repository").agg(F.sum(F.col("weight") * 100 + F.least(F.col("symbols"), F.lit(99))).cast("long").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "repository")
    ranked = met.withColumn("rank", F.row_number().over(rank))
    whole = Window.partitionBy("query_id")
    best, next_ = F.max("score").over(whole), F.max(F.when(F.col("rank") == SCHEDULE[0] + 1, F.col("score"))).over(whole)
    return ranked.withColumn("ambiguous", F.coalesce(next_ * 10 >= best * AMBIGUOUS_TENTHS, F.lit(False)))


def leaders(terms: DataFrame) -> DataFrame:
    """(query_id, leader): the least query with the same set of terms. Queries that ask alike are answered once."""
    sets = terms.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("term"))).alias("set"))
    return sets.join(sets.groupBy("set").agg(F.min("query_id").alias("leader")), "set").select("query_id", "leader")


@dataclass
class Held:
    """What symbols hold, once for all symbols that hold the same: sets (*by, class, rows array of structs with term and weight), members (*by, class, symbol: the first keep of a class)."""

    sets: DataFrame
    members: DataFrame


def held_by(postings: DataFrame, by: list[str], symbol: str, columns: list[str], keep: int) -> Held:
    """Classes of symbols with the same postings. A search that wants the best keep symbols a group needs keep of a class at most: its symbols differ by their ids alone."""
    rows = postings.groupBy(*by, symbol).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    named = written(rows.select(*by, symbol, F.md5(F.to_json("rows").cast("binary")).alias("class"), "rows"), "held")
    members = term_top_k(named.select(*by, "class", symbol), keep, [*by, "class"], [symbol]).drop("rank")
    return Held(written(named.groupBy(*by, "class").agg(F.any_value("rows").alias("rows"), F.min(symbol).alias("least")), "held-sets"), written(members, "held-members"))


def deep_cards(selected: DataFrame, terms: DataFrame, held: Held, per_repository: int) -> DataFrame:
    """(query_id, repository, symbol_id, score): symbols of selected repositories (query_id, repository) that have all of a query's terms.

    A query meets a repository's classes by the term that fewest of them have, and tests these for the rest.
    """
    asked = terms.distinct().groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("wants"), F.count("*").alias("wanted")).where("size(wants) = wanted")
    post = held.sets.select("repository", "class", "least", "rows", F.explode(F.array_distinct(F.col("rows.term"))).alias("term"))
    sizes = post.groupBy("repository", "term").agg(F.count("*").alias("n"))
    rarest = selected.join(asked, "query_id").select("query_id", "repository", "wanted", F.explode("wants").alias("term")).join(sizes, ["repository", "term"])
    rarest = rarest.groupBy("query_id", "repository").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count("*").alias("met"), F.first("wanted").alias("wanted")).where("met = wanted").join(asked.select("query_id", "wants"), "query_id")
    score = F.aggregate(F.filter("rows", lambda x: F.array_contains("wants", x["term"])), F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    hits = rarest.join(post, ["repository", "term"]).where(F.size(F.array_except("wants", F.col("rows.term"))) == 0).select("query_id", "repository", "class", "least", score.alias("score"))
    best = term_top_k(hits, per_repository, ["query_id", "repository"], [F.desc("score"), "least"]).drop("rank", "least")
    cards = best.join(held.members, ["repository", "class"]).select("query_id", "repository", "symbol_id", "score")
    return term_top_k(cards, per_repository, ["query_id", "repository"], [F.desc("score"), "symbol_id"]).drop("rank")


def search(terms: DataFrame, postings: DataFrame, usable: DataFrame, bridges: DataFrame, evidence_cards: int = 12, per_repository: int = 8, phases: int = 8) -> tuple[DataFrame, DataFrame]:
    """(cards, receipts) of queries (query_id, term) over postings (repository, symbol_id, term, weight).

    usable (repository): members that may be searched; others are routed to, but skipped. bridges (id, source_repository,
    source_symbol, target_repository, target_symbol) join repositories. Phases go on while a query has no card; after the first card
    an ambiguous route gets one more phase, if it is in its first. Why a query stopped: sufficient-evidence, result-budget (as
    many cards as asked for, and repositories left), work-budget (ambiguous and repositories left), exhaustion (no card, none
    left), phase-limit (after phases of them).

    Cards come best first, the best of each of the four leading repositories before all others; then the other ends of bridges
    at these cards, where their repositories are usable. relationships counts a card's bridges between usable repositories.
    """
    of = written(leaders(terms), "leaders")
    terms = written(terms.distinct().join(of.where("query_id = leader").select("query_id"), "query_id", "left_semi"), "route-terms")
    held = held_by(postings, ["repository"], "symbol_id", ["term", "weight"], per_repository)
    routed = written(route(terms, catalog_of(postings)), "routed")
    queries = terms.select("query_id").distinct()
    counts = routed.groupBy("query_id").agg(F.count("*").alias("routes"), F.max("ambiguous").alias("ambiguous"))
    state = queries.join(counts, "query_id", "left").select("query_id", F.coalesce("routes", F.lit(0)).alias("routes"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.lit(0).cast("long").alias("cards"), F.lit(0).alias("selected"))
    state = written(state.withColumn("stop", F.when(F.col("routes") == 0, "exhaustion")), "route-state")
    found, low = None, 0
    for phase in range(phases):
        high = low + SCHEDULE[min(phase, len(SCHEDULE) - 1)]
        active = state.where("stop is null").select("query_id")
        batch = routed.join(active, "query_id").where((F.col("rank") > low) & (F.col("rank") <= high)).join(usable.select("repository").distinct(), "repository", "left_semi").select("query_id", "repository")
        cards = written(deep_cards(batch, terms, held, per_repository), "cards")
        found = cards if found is None else found.unionByName(cards)
        more = cards.groupBy("query_id").agg(F.count("*").alias("more"))
        n, left = F.col("cards") + F.coalesce("more", F.lit(0)), F.col("routes") > high
        expand = left & F.col("ambiguous")
        ended = F.when(n > 0, F.when(expand & F.lit(phase == 0), None).when(left & (n >= evidence_cards), "result-budget").when(expand & F.lit(phase > 0), "work-budget").otherwise("sufficient-evidence")).when(~left, "exhaustion")
        live = F.col("stop").isNull()
        state = state.join(more, "query_id", "left").select("query_id", "routes", "ambiguous", F.when(live, n).otherwise(F.col("cards")).alias("cards"), F.when(live, F.least(F.col("routes"), F.lit(high))).otherwise(F.col("selected")).cast("int").alias("selected"), F.when(live, ended).otherwise(F.col("stop")).alias("stop"))
        state, low = written(state, "route-state"), high
        if state.where("stop is null").isEmpty():
            break
    best = found.withColumn("own", F.row_number().over(Window.partitionBy("query_id", "repository").orderBy(F.desc("score"), "symbol_id")))
    lead = best.where("own = 1").withColumn("lead", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol_id"))).select("query_id", "repository", "lead")
    first = F.when((F.col("own") == 1) & (F.col("lead") <= 4), 0).otherwise(1)
    local = best.join(lead, ["query_id", "repository"]).select("query_id", "repository", "symbol_id", "score", first.alias("tier"))
    pairs = _usable_bridges(bridges, usable)
    ends = pairs.select(F.col("source_symbol").alias("at"), F.col("target_repository").alias("repository"), F.col("target_symbol").alias("symbol_id")).unionByName(pairs.select(F.col("target_symbol").alias("at"), F.col("source_repository").alias("repository"), F.col("source_symbol").alias("symbol_id")))
    other = local.select("query_id", F.col("symbol_id").alias("at")).join(ends, "at").select("query_id", "repository", "symbol_id").distinct().join(local.select("query_id", "symbol_id"), ["query_id", "symbol_id"], "left_anti")
    every = local.unionByName(other.select("query_id", "repository", "symbol_id", F.lit(0).cast("long").alias("score"), F.lit(2).alias("tier")))
    ranked = term_top_k(every, evidence_cards, ["query_id"], ["tier", F.desc("score"), "symbol_id"]).withColumnRenamed("rank", "position")
    degree = ends.groupBy(F.col("at").alias("symbol_id")).agg(F.count("*").alias("relationships"))
    cards = ranked.join(degree, "symbol_id", "left").select("query_id", "position", "repository", "symbol_id", "score", F.coalesce("relationships", F.lit(0)).alias("relationships"))
    told = state.select("query_id", "routes", "selected", F.coalesce("stop", F.lit("phase-limit")).alias("stop_reason"))
    of = of.withColumnRenamed("query_id", "asker").withColumnRenamed("leader", "query_id")
    each = lambda rows: rows.join(of, "query_id").drop("query_id").withColumnRenamed("asker", "query_id").select(*rows.columns)
    return each(written(cards, "route-cards")), each(told)


def _usable_bridges(bridges: DataFrame, usable: DataFrame) -> DataFrame:
    ok = usable.select("repository").distinct()
    out = bridges.join(ok.withColumnRenamed("repository", "source_repository"), "source_repository", "left_semi")
    return out.join(ok.withColumnRenamed("repository", "target_repository"), "target_repository", "left_semi")


def paged(cards: DataFrame, cost: Column, budget: int) -> DataFrame:
    """cards with their page: each page is the longest run of cards from the one before it on whose costs fit the budget (one card at least).

    The pages of a query one after the other are its unpaged answer. A query's cards are few (evidence_cards), so they are
    folded as one array.
    """
    rows = cards.withColumn("_c", cost.cast("long")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "_c"))).alias("x"))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = F.coalesce(last["spent"] + x["_c"] <= budget, F.lit(False))
        return F.concat(done, F.array(F.struct(x["position"].alias("position"), F.when(F.size(done) == 0, 1).when(same, last["page"]).otherwise(last["page"] + 1).cast("int").alias("page"), F.when(same, last["spent"] + x["_c"]).otherwise(x["_c"]).alias("spent"))))

    kind = "array<struct<position:int,page:int,spent:bigint>>"
    folded = rows.select("query_id", F.explode(F.aggregate("x", F.array().cast(kind), step)).alias("p"))
    return cards.join(folded.select("query_id", "p.position", "p.page"), ["query_id", "position"])


def continuation(page: DataFrame) -> DataFrame:
    """(query_id, cursor): where a page (rows of one page number a query) ends, as a token for the next."""
    return page.groupBy("query_id").agg(F.max("position").alias("p"), F.sha2(F.concat_ws("\x00", F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol_id"))), lambda x: x["symbol_id"])), 256).alias("d")).select("query_id", F.concat_ws(":", F.col("p").cast("string"), F.substring("d", 1, 16)).alias("cursor"))


def continued(cards: DataFrame, cursors: DataFrame) -> DataFrame:
    """The cards after a cursor of each query (query_id, cursor)."""
    return cards.join(cursors, "query_id").where(F.col("position") > F.split("cursor", ":")[0].cast("int")).drop("cursor")


_LANE = [("matched_terms", True), ("matched_weight", True), ("exported", True), ("ordinal", False), ("node_id", False)]


def lexical_lane(terms: DataFrame, members: DataFrame, routing_terms: DataFrame, symbols: DataFrame, per_member: int, limit: int, after: DataFrame | None = None) -> DataFrame:
    """Symbols of published members that have terms of a query, a page of limit a query.

    terms (query_id, term), members (ordinal, projection), routing_terms (projection, node_id, term, weight) and symbols (projection,
    node_id, exported). Most terms first, then their weight, then exported ones; per_member fair places a member; catalog_rank is the
    place among all of these. after (query_id and the columns of a page's last row): the next page.
    """
    of = written(leaders(terms), "leaders")
    asked = terms.distinct().join(of.where("query_id = leader").select("query_id"), "query_id", "left_semi")
    nodes = symbols.select("projection", "node_id", F.col("exported").cast("int").alias("exported"))
    held = held_by(routing_terms.join(members, "projection").join(nodes, ["projection", "node_id"]), ["ordinal"], "node_id", ["term", "weight", "exported"], per_member)
    met = asked.join(held.sets.select("ordinal", "class", "least", F.explode("rows").alias("x")).select("ordinal", "class", "least", "x.*"), "term")
    match = met.groupBy("query_id", "ordinal", "class").agg(F.max("exported").alias("exported"), F.count("*").alias("matched_terms"), F.sum("weight").alias("matched_weight"), F.first("least").alias("node_id"))
    order = [F.desc(c) if down else F.asc(c) for c, down in _LANE]
    best = term_top_k(match, per_member, ["query_id", "ordinal"], order).drop("rank", "node_id").join(held.members, ["ordinal", "class"]).drop("class")
    fair = written(term_top_k(best, per_member, ["query_id", "ordinal"], order).drop("rank"), "fair")
    fair = fair.withColumnRenamed("query_id", "leader").join(of, "leader").drop("leader")
    ranked = fair.withColumn("catalog_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))  # per_member rows a member
    if after is not None:
        last = after.select("query_id", *[F.col(c).alias(f"_{c}") for c, _ in _LANE])
        beyond, equal = F.lit(False), F.lit(True)
        for c, down in _LANE:
            beyond = beyond | (equal & ((F.col(c) < F.col(f"_{c}")) if down else (F.col(c) > F.col(f"_{c}"))))
            equal = equal & (F.col(c) == F.col(f"_{c}"))
        ranked = ranked.join(last, "query_id").where(beyond).drop(*[f"_{c}" for c, _ in _LANE])
    return term_top_k(ranked, limit, ["query_id"], ["catalog_rank"]).drop("rank")


def coverage(published: DataFrame, generations: DataFrame, members: DataFrame, projections: DataFrame) -> DataFrame:
    """(workset, declared, actual, ready, complete): whether a published generation has all its members, each with a ready projection.

    published (workset, generation), generations (generation, member_count, state), members (generation, ordinal, projection),
    projections (projection, state). A workset without a ready generation is not complete and declares none.
    """
    ready = projections.where("state = 'ready'").select("projection", F.lit(1).alias("ok")).distinct()
    counted = members.join(ready, "projection", "left").groupBy("generation").agg(F.count("*").alias("actual"), F.count("ok").alias("ready"))
    live = generations.where("state = 'ready'").select("generation", F.col("member_count").alias("declared"))
    rows = published.join(live, "generation", "left").join(counted, "generation", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    whole = F.col("declared").isNotNull() & (zero("actual") == F.col("declared")) & (zero("ready") == F.col("declared"))
    return rows.select("workset", "declared", zero("actual").alias("actual"), zero("ready").alias("ready"), whole.alias("complete"))
