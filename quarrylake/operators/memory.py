"""Memory hygiene, context health, lifecycles and hosted-mutation plans."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores as S, text as X
from ..plans.predicates import expired, valid_now
from .recall import numbered
from .traversal import written

# Days after which handoffs end, are reviewed or go at the latest.
TERMINAL_DAYS, REVIEW_DAYS, MAXIMUM_DAYS = 7, 14, 30
TERMINAL_WORDS = ("abandoned", "canceled", "cancelled", "closed", "complete", "completed", "done", "merged", "released", "resolved", "shipped", "superseded")
CONTRADICTION_MILLI = 550
SEVERITY = ("critical", "high", "medium", "low", "info")


def is_terminal(body: Column) -> Column:
    return body.rlike(r"(?im)^\s*(?:[-*]\s*)?(?:status|state)\s*:\s*(" + "|".join(TERMINAL_WORDS) + r")\b")


def is_pending(body: Column) -> Column:
    return body.rlike(r"(?im)^\s*(?:[-*]\s*)?(?:status|state)\s*:\s*(pending|open|blocked|in progress)\b|^\s*(?:[-*]\s*)?(?:pending|open|blockers?)\s*:\s*\S")


def comparable_body(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "))


def topic_slug(topic: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(topic), r"[^a-z0-9]+", "-"), "^-|-$", "")


def newest_first() -> list:
    """Newest; among equally new the one whose file name is its topic's slug; then by uri."""
    return [F.desc("updated_at"), F.when(X.uri_slug(F.col("uri")) == topic_slug(F.col("topic")), 0).otherwise(1), "uri"]


def compaction_plan(records: DataFrame, now: Column) -> DataFrame:
    """(uri, action, reason) for active records: archive, review, forget, keep or none.

    Expiry first, then the age rules of handoffs; what is left is compared inside (project, topic, kind): exact
    duplicates are forgotten but for one, older handoffs are archived, other overlaps are for review.
    """
    r = records.where("status = 'active'")
    age = (now.cast("long") - F.col("updated_at").cast("long")) / 86400.0
    handoff, pending, terminal = F.col("kind") == "handoff", is_pending(F.col("body")), is_terminal(F.col("body"))
    aged = (
        F.when(expired(now, F.col("valid_to")), F.struct(F.lit("archive").alias("action"), F.lit("expired").alias("reason")))
        .when(handoff & (age >= MAXIMUM_DAYS) & pending, F.struct(F.lit("review").alias("action"), F.lit("retention-deferred").alias("reason")))
        .when(handoff & (age >= MAXIMUM_DAYS), F.struct(F.lit("archive").alias("action"), F.lit("maximum-age").alias("reason")))
        .when(handoff & (age >= TERMINAL_DAYS) & terminal & ~pending, F.struct(F.lit("archive").alias("action"), F.lit("terminal").alias("reason")))
        .when(handoff & (age >= REVIEW_DAYS), F.struct(F.lit("review").alias("action"), F.lit("nonterminal").alias("reason")))
    )
    r = r.withColumn("aged", aged)
    first = r.where("aged is not null").select("uri", "aged.action", "aged.reason")
    rest = r.where("aged is null").withColumn("same", F.md5(comparable_body(F.col("body")).cast("binary")))
    group = ["project", "topic", "kind"]
    rest = rest.withColumn("copy", F.row_number().over(Window.partitionBy(*group, "same").orderBy(*newest_first()))).withColumn("copies", F.count("*").over(Window.partitionBy(*group, "same")))
    w = Window.partitionBy(*group)
    rest = rest.withColumn("bodies", F.sum(F.when(F.col("copy") == 1, 1).otherwise(0)).over(w)).withColumn("age_rank", F.row_number().over(w.orderBy(F.when(F.col("copy") == 1, 0).otherwise(1), *newest_first())))
    action = F.when(F.col("copy") > 1, "forget").when(F.col("bodies") == 1, F.when(F.col("copies") > 1, "keep").otherwise("none")).when(handoff & (F.col("age_rank") == 1), "keep").when(handoff, "archive").when(F.col("copies") > 1, "keep").otherwise("review")
    reason = F.when(F.col("copy") > 1, "exact-duplicate").when(F.col("bodies") == 1, F.when(F.col("copies") > 1, "duplicates-merged").otherwise("only")).when(handoff & (F.col("age_rank") == 1), "latest-handoff").when(handoff, "older-handoff").when(F.col("copies") > 1, "duplicates-merged").otherwise("overlapping")
    return first.unionByName(rest.select("uri", action.alias("action"), reason.alias("reason")))


def merge_review(records: DataFrame) -> DataFrame:
    """(project, topic, reasons) of groups with two records or more that differ in kind or in their durable bodies."""
    g = records.where("status = 'active'").groupBy("project", "topic").agg(F.count("*").alias("records"), F.countDistinct("kind").alias("kinds"), F.countDistinct(F.when(F.col("kind").isin("durable", "incident"), comparable_body(F.col("body")))).alias("bodies"))
    reasons = F.concat_ws(",", F.when(F.col("kinds") > 1, "kinds"), F.when(F.col("bodies") > 1, "bodies"))
    return g.where("records >= 2 and (kinds > 1 or bodies > 1)").select("project", "topic", "records", reasons.alias("reasons"))


def nudges(records: DataFrame) -> DataFrame:
    """Groups of 3 active records or more, projects of 10 active handoffs or more."""
    a = records.where("status = 'active'")
    g = a.groupBy("project", "topic", "kind").agg(F.count("*").alias("records")).where("records >= 3").select(F.concat_ws("/", "project", "topic", "kind").alias("target"), "records", F.lit("group").alias("nudge"))
    return g.unionByName(a.where("kind = 'handoff'").groupBy("project").agg(F.count("*").alias("records")).where("records >= 10").select(F.col("project").alias("target"), "records", F.lit("handoffs").alias("nudge")))


def finding(rows: DataFrame, category: str, severity: str, detail: Column) -> DataFrame:
    return rows.select("uri", F.lit(category).alias("category"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def validity_findings(records: DataFrame, now: Column) -> DataFrame:
    return finding(records.where(F.col("status") == "active").where(expired(now, F.col("valid_to"))), "validity-expired", "high", F.date_format("valid_to", "yyyy-MM-dd"))


def review_findings(records: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return finding(records.where(F.col("status") == "active").where(F.col("updated_at") < now - F.expr(f"interval {days} days")), "review-overdue", "low", F.date_format("updated_at", "yyyy-MM-dd"))


def relation_findings(records: DataFrame) -> DataFrame:
    """Relations whose target is missing or not active."""
    target = records.select(F.col("uri").alias("t"), F.col("status").alias("t_status"))
    j = records.where("status = 'active' and supersedes is not null").join(target, F.col("supersedes") == F.col("t"), "left")
    return finding(j.where("t is null or t_status <> 'active'"), "relation-target", "medium", F.concat(F.col("supersedes"), F.lit(":"), F.coalesce("t_status", F.lit("missing"))))


def duplicate_findings(records: DataFrame) -> DataFrame:
    a = records.where("status = 'active'").withColumn("same", F.md5(comparable_body(F.col("body")).cast("binary")))
    w = Window.partitionBy("project", "topic", "kind", "same")
    return finding(a.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(*newest_first()))).where("k > 1"), "duplicate", "low", F.col("n"))


def citation_findings(citations: DataFrame, files: DataFrame) -> DataFrame:
    """(uri, path, digest) against (path, digest): deleted, changed or unknown."""
    j = citations.join(files.select(F.col("path").alias("p"), F.col("digest").alias("d")), F.col("path") == F.col("p"), "left")
    state = F.when(F.col("digest").isNull(), "unknown").when(F.col("p").isNull(), "deleted").when(F.col("d") != F.col("digest"), "changed")
    return finding(j.withColumn("state", state).where("state is not null"), "citation", "medium", F.concat_ws(":", "path", "state"))


def health_report(findings: list[DataFrame]) -> DataFrame:
    """All findings, gravest first; health_page() has them with positions."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    order = F.array_position(X.strings(SEVERITY), F.col("severity"))
    return out.withColumn("severity_rank", order.cast("int")).orderBy("severity_rank", "category", "uri", "detail")


def health_digest(findings: DataFrame, records: DataFrame) -> str:
    """A digest of what a report was made of: findings, and records (uri, body); a sum of parts, so their order is nothing to it."""
    part = lambda *c: F.conv(F.substring(F.sha2(F.concat_ws("\x00", *c), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum(part(*c)), F.lit(0)).alias("s")).first() for df, c in ((findings, ("uri", "category", "severity", "detail")), (records, ("uri", F.coalesce("body", F.lit("")))))]
    return hashlib.sha256(":".join(str(x) for r in sums for x in r).encode()).hexdigest()[:40]


def health_page(findings: list[DataFrame], records: DataFrame, limit: int, after: str | None = None) -> tuple[DataFrame, str | None]:
    """A page of the report (position from 1) and the cursor of the next, None after the last.

    A cursor is a position and a digest of all findings and records; one of another state, or beyond the end, raises
    ValueError: the first page is to be asked for again. Repeated findings count once.
    """
    every = written(health_report(findings).dropDuplicates(["uri", "category", "detail"]), "findings")
    digest, total, start = health_digest(every, records), every.count(), 0
    if after is not None:
        place, _, seen = after.partition(":")
        if seen != digest or not place.isdigit() or not 0 < int(place) < total:
            raise ValueError("the cursor is of another state of the report; ask for the first page")
        start = int(place)
    order = ["severity_rank", "category", "uri", "detail"]
    page = numbered(every, order).where((F.col("position") > start) & (F.col("position") <= start + limit))
    return page, f"{start + limit}:{digest}" if start + limit < total else None


def storage_attribution(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot, classifier, files, source_bytes, symbol_rows, edge_rows, logical_bytes, bytes_per_symbol) and the share of a snapshot's bytes.

    symbols (snapshot, classifier, payload_bytes), edges likewise, files (snapshot, classifier, bytes).
    """
    keys = ["snapshot", "classifier"]
    part = lambda df, n, b: df.groupBy(*keys).agg(F.count("*").alias(n), F.sum(df.columns[-1]).alias(b))
    rows = part(files.select(*keys, "bytes"), "files", "source_bytes").join(part(symbols.select(*keys, "payload_bytes"), "symbol_rows", "_s"), keys, "full").join(part(edges.select(*keys, "payload_bytes"), "edge_rows", "_e"), keys, "full")
    rows = rows.na.fill(0, ["files", "source_bytes", "symbol_rows", "edge_rows", "_s", "_e"]).withColumn("logical_bytes", F.col("_s") + F.col("_e")).drop("_s", "_e")
    whole = rows.groupBy("snapshot").agg(F.sum("logical_bytes").alias("_all"))
    per = F.when(F.col("symbol_rows") > 0, F.round(F.col("logical_bytes") / F.col("symbol_rows"), 6))
    return rows.join(whole, "snapshot").withColumn("bytes_per_symbol", per).withColumn("share", F.when(F.col("_all") > 0, F.round(F.col("logical_bytes") / F.col("_all"), 6)).otherwise(0.0)).drop("_all")


def compaction_recommended(attribution: DataFrame, retired: DataFrame, ratio: float = 0.25, least_bytes: int = 1 << 20) -> DataFrame:
    """(repository, logical_bytes, reclaimable, recommended): whether the bytes of retired snapshots (repository, snapshot, active) are worth a rewrite."""
    rows = attribution.groupBy("snapshot").agg(F.sum("logical_bytes").alias("b")).join(retired, "snapshot").groupBy("repository").agg(F.sum("b").alias("logical_bytes"), F.sum(F.when(F.col("active"), 0).otherwise(F.col("b"))).alias("reclaimable"))
    return rows.withColumn("recommended", (F.col("reclaimable") >= least_bytes) & (F.col("reclaimable") >= ratio * F.col("logical_bytes")))


def health_summary(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """source -> findings and status: unknown before findings before clean."""
    n = findings.groupBy("source").agg(F.count("*").alias("findings"))
    status = F.when(F.col("unknown") > 0, "unknown").when(F.coalesce("findings", F.lit(0)) > 0, "findings").otherwise("clean")
    return sources.join(n, "source", "left").select("source", F.coalesce("findings", F.lit(0)).alias("findings"), status.alias("status"), F.when(status == "unknown", 2).when(status == "findings", 1).otherwise(0).alias("exit_code"))


def claims_of(records: DataFrame) -> DataFrame:
    c = records.select("uri", "project", F.posexplode(X.claims(F.col("body"))).alias("ordinal", "claim"))
    return c.withColumn("denied", X.is_denied(F.col("claim"))).withColumn("basis", X.basis_tokens(X.without_negation(F.col("claim"))))


def contradictions(records: DataFrame, milli: int = CONTRADICTION_MILLI) -> DataFrame:
    """Claims of two records of a project, one denied, alike by at least milli / 1000 of their words.

    A claim's rarest words block the join: two claims that are that alike share a word among the first n - ceil(t n)
    + 1 of each, in one order of words, so no cross join is needed.
    """
    c = claims_of(records).where(F.size("basis") > 0)
    df = c.select(F.explode("basis").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = c.select("uri", "project", "ordinal", F.size("basis").alias("size"), F.explode("basis").alias("w")).join(df, "w")
    words = words.withColumn("r", F.row_number().over(Window.partitionBy("uri", "ordinal").orderBy("n", "w")))
    lead = words.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * (milli - 0.5) / 1000.0) + 1).select("uri", "project", "ordinal", "w")
    keyed = c.select("uri", "ordinal", "denied", "basis", "claim")
    a = lead.join(keyed.where("denied"), ["uri", "ordinal"]).select("project", "w", F.col("uri").alias("denied_uri"), F.col("ordinal").alias("denied_ordinal"), F.col("basis").alias("b1"))
    b = lead.join(keyed.where("not denied"), ["uri", "ordinal"]).select("project", "w", F.col("uri").alias("stated_uri"), F.col("ordinal").alias("stated_ordinal"), F.col("basis").alias("b2"))
    pairs = a.join(b, ["project", "w"]).where("denied_uri <> stated_uri").dropDuplicates(["denied_uri", "denied_ordinal", "stated_uri", "stated_ordinal"])
    return pairs.withColumn("similarity_milli", X.similarity_milli(F.col("b1"), F.col("b2"))).where(F.col("similarity_milli") >= milli).select("denied_uri", "denied_ordinal", "stated_uri", "stated_ordinal", "similarity_milli")


def premise_state(records: DataFrame, now: Column) -> DataFrame:
    """unresolved, conflicted, historical or current, in this order of tests."""
    newer = records.where("status = 'active' and supersedes is not null").groupBy(F.col("supersedes").alias("uri")).agg(F.count("*").alias("superseders"))
    j = records.join(newer, "uri", "left").withColumn("superseders", F.coalesce("superseders", F.lit(0)))
    state = F.when(F.col("body") == "", "unresolved").when(F.col("superseders") > 1, "conflicted").when((F.col("status") != "active") | (F.col("superseders") == 1) | ~valid_now(now, F.lit(None).cast("timestamp"), F.col("valid_to")), "historical").otherwise("current")
    return j.select("uri", "superseders", state.alias("state"))


def one_hop(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """Links of the seeds in both directions, the target still in store."""
    links = records.where("supersedes is not null").select(F.col("uri").alias("source"), F.col("supersedes").alias("target"))
    links = links.join(records.select(F.col("uri").alias("target")), "target", "left_semi")
    s = seeds.select(F.col("uri").alias("seed"))
    out = links.join(s, F.col("source") == F.col("seed")).select("seed", F.lit("outgoing").alias("direction"), F.col("target").alias("neighbour"))
    return out.unionByName(links.join(s, F.col("target") == F.col("seed")).select("seed", F.lit("incoming").alias("direction"), F.col("source").alias("neighbour")))


def identity_state(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """(identity, uri, active, in_scope, conflict): resolved with exactly one, not-found with none, else ambiguous."""
    n = candidates.groupBy("identity").agg(F.count(F.when(F.col("active") & F.col("in_scope"), 1)).alias("matches"), F.max(F.col("conflict")).alias("conflict"), F.min(F.when(F.col("active") & F.col("in_scope"), F.col("uri"))).alias("uri"))
    state = F.when(F.lit(not scope) | (F.col("matches") == 0), "not-found").when((F.col("matches") == 1) & ~F.col("conflict"), "resolved").otherwise("ambiguous")
    return n.select("identity", "matches", state.alias("state"), F.when(state == "resolved", F.col("uri")).alias("uri"))


def mutation_plan(requests: DataFrame, heads: DataFrame, done: DataFrame) -> DataFrame:
    """(request_id, key, body_hash, uri, base_generation) -> replay, idempotency-conflict, stale-base or commit."""
    j = requests.join(done.select("key", F.col("body_hash").alias("old_hash")), "key", "left").join(heads.select("uri", F.col("generation").alias("head")), "uri", "left")
    plan = F.when(F.col("old_hash") == F.col("body_hash"), "replay").when(F.col("old_hash").isNotNull(), "idempotency-conflict").when(~F.col("base_generation").eqNullSafe(F.col("head")), "stale-base").otherwise("commit")
    return j.select("request_id", "uri", plan.alias("plan"), F.when(plan == "commit", F.coalesce("head", F.lit(0)) + 1).alias("next_generation"))


# (state, operation, next state) of handoffs.
LIFECYCLE = (("active", "complete", "completed"), ("active", "archive", "archived"), ("active", "expire", "expired"), ("completed", "archive", "archived"), ("completed", "reopen", "active"), ("archived", "restore", "active"), ("expired", "restore", "active"), ("expired", "archive", "archived"))


def transition(requests: DataFrame) -> DataFrame:
    """(id, state, operation) -> next state, or rejected."""
    table = requests.sparkSession.createDataFrame(list(LIFECYCLE), "state string, operation string, next string")
    return requests.join(table, ["state", "operation"], "left").select("id", "state", "operation", F.coalesce("next", F.lit("rejected")).alias("next"))


def policy_decision(requests: DataFrame) -> DataFrame:
    """The first denial in order, else allow. Columns are booleans of what the caller has."""
    order = ("membership", "grant", "share", "project", "capability", "write_kind", "attestation")
    out = F.lit("allow")
    for name in reversed(order):
        out = F.when(~F.coalesce(F.col(name), F.lit(False)), f"deny-{name}").otherwise(out)
    return requests.withColumn("decision", out)


def bounded_authority(asserted: Column, implied: Column, levels: tuple) -> Column:
    """An asserted value counts only up to the level that the place implies."""
    at = lambda c: F.array_position(X.strings(levels), c)
    return F.when((at(asserted) > 0) & (at(asserted) <= at(implied)), asserted).otherwise(implied)


def task_alignment(topic: Column, task: Column, query: Column) -> Column:
    """Topic words 3, task words 2, phrases of two words 3 times that; 0 without a phrase or two words."""
    words = lambda c: X.basis_tokens(c)
    seq = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3)
    pairs = lambda c: F.array_distinct(F.zip_with(seq(c), F.slice(seq(c), F.lit(2), F.greatest(F.size(seq(c)), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    one = F.size(F.array_intersect(words(topic), words(query))) * 3 + F.size(F.array_intersect(words(task), words(query))) * 2
    two = F.size(F.filter(F.array_intersect(pairs(topic), pairs(query)), lambda p: p.contains(" "))) * 9 + F.size(F.filter(F.array_intersect(pairs(task), pairs(query)), lambda p: p.contains(" "))) * 6
    shared = F.size(F.array_intersect(F.array_union(words(topic), words(task)), words(query)))
    return F.when((two > 0) | (shared >= 2), one + two).otherwise(0)


def freshness(snapshots: DataFrame) -> DataFrame:
    """(project, commit, head, dirty, state): unknown unless exactly one clean ready snapshot; then fresh or stale."""
    n = snapshots.groupBy("project").agg(F.count("*").alias("n"), F.max("dirty").alias("dirty"), F.max(F.col("state") != "ready").alias("unready"), F.max(F.col("commit") == F.col("head")).alias("equal"))
    return n.select("project", F.when((F.col("n") != 1) | F.col("dirty") | F.col("unready"), "unknown").when(F.col("equal"), "fresh").otherwise("stale").alias("freshness"))


def feedback_scores(events: DataFrame, now: Column) -> DataFrame:
    """uri -> decayed feedback, clamped to [-1, 1] after every event in time order.

    Clamped additions compose: a run of events is the map x -> min(hi, max(lo, x + s)), so a uri's events fold from
    parts of a minute, those into parts of a day, and those into the score: no more than a minute's events of a uri are one array.
    """
    w = events.select("uri", "ts", "event_id", (S.action_weight(F.col("action")) * S.decay((now.cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400.0)).alias("d"))
    fold = lambda rows, start, step: F.aggregate(rows, start, step)
    minute = w.groupBy("uri", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "d"))).alias("e"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))

    def step(acc: Column, x: Column) -> Column:
        clamp = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
        return F.struct((acc.s + x.d).alias("s"), clamp(acc.lo + x.d).alias("lo"), clamp(acc.hi + x.d).alias("hi"))

    def join(acc: Column, x: Column) -> Column:
        clamp = lambda v: F.greatest(x.p.lo, F.least(x.p.hi, v + x.p.s))
        return F.struct((acc.s + x.p.s).alias("s"), clamp(acc.lo).alias("lo"), clamp(acc.hi).alias("hi"))

    minutes = minute.select("uri", "minute", fold(F.col("e"), start, step).alias("p"))
    days = minutes.groupBy("uri", F.to_date("minute").alias("day")).agg(F.array_sort(F.collect_list(F.struct("minute", "p"))).alias("e"))
    parts = days.select("uri", "day", fold(F.col("e"), start, join).alias("p"))
    whole = parts.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("day", "p"))).alias("p"))
    score = F.aggregate("p", F.lit(0.0), lambda acc, x: F.greatest(x.p.lo, F.least(x.p.hi, acc + x.p.s)))
    return whole.select("uri", F.round(score, 6).alias("score"))


def feedback_counts(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    e = events if start is None else events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    e = e if end is None else e.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return e.agg(*[F.count(F.when(F.col("action") == a, 1)).alias(a) for a in sorted(S.ACTION_WEIGHTS)])


def value_report(events: DataFrame) -> DataFrame:
    """Per kind: events, sum, rate of the whole and median."""
    n = events.agg(F.count("*").alias("all"))
    g = events.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.round(F.median("value"), 6).alias("median"))
    return g.crossJoin(n).select("event_type", "events", "total", "median", F.round(F.col("events") / F.col("all"), 6).alias("share"))  # n is one row


def percentiles(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """p50, p95 and p99 as sorted[min(n - 1, floor(n q))]: equal values are counted first, and ranks are sums of counts.

    A group is cut into 1024 parts of its range, so that ranks are sums over the parts before and inside a part.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    edges = counts.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("n"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 1023)).otherwise(0).cast("int")
    placed = counts.join(edges, by).withColumn("_part", part)
    parts = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    order = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(before, [*by, "_part"]).withColumn("_end", F.col("_before") + F.sum("_n").over(inside))

    def pick(q: float) -> Column:
        k = F.least(F.col("n") - 1, F.floor(F.col("n") * q))
        return F.max(F.when((k >= F.col("_end") - F.col("_n")) & (k < F.col("_end")), F.col("_v")))

    return ranked.groupBy(*by).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), F.first("_lo").alias("least"), F.first("_hi").alias("most"), F.round(F.first("_sum") / F.first("n"), 6).alias("mean"))


def outbox_health(rows: DataFrame, attempts: int = 5) -> DataFrame:
    return rows.agg(F.count(F.when(F.col("attempts") >= attempts, 1)).alias("dead_letters"), F.count(F.when((F.col("attempts") < attempts) & ~F.col("done"), 1)).alias("pending"), F.min(F.when((F.col("attempts") < attempts) & ~F.col("done"), F.col("created_at"))).alias("oldest_pending"))


def retention(snapshots: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Keys with too many snapshots, a flagged one, or several that are too large together."""
    return snapshots.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("flagged").cast("int")).alias("flags"), F.sum("bytes").alias("bytes")).where((F.col("n") > most) | (F.col("flags") > 0) | ((F.col("n") > 1) & (F.col("bytes") > most_bytes)))


def due_jobs(jobs: DataFrame, cursor: str, concurrency: int) -> DataFrame:
    """Due jobs round robin over tenants, from the tenant after the cursor on."""
    rn = jobs.withColumn("turn", F.row_number().over(Window.partitionBy("tenant").orderBy("due_at", "job_id"))).where(F.col("turn") <= concurrency)
    return rn.orderBy("turn", F.when(F.col("tenant") > cursor, 0).otherwise(1), "tenant").limit(concurrency)


def violations_head(old: DataFrame, new: DataFrame) -> DataFrame:
    """Heads whose revision does not advance or whose identity changes; must be empty before a write."""
    j = new.join(old.select("uri", F.col("generation").alias("g0"), F.col("identity").alias("i0")), "uri")
    return j.where((F.col("generation") <= F.col("g0")) | ~F.col("identity").eqNullSafe(F.col("i0"))).select("uri", "g0", "generation")


def violations_immutable(old: DataFrame, new: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Rows of an append-only table that a write would change or drop; must be empty."""
    kept = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    j = old.join(kept, key, "left")
    same = F.col("_there")
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.where(~F.coalesce(same, F.lit(False))).select(key)
