"""Memory, feedback, operations and streaming-twin queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import NOW, feedback, memory_records, read, sql
from ..functions import scores as S, text as X
from ..operators import memory as M
from ..streaming import streams as ST

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


_NOW = f"TIMESTAMP '{NOW}'"
_SAME = r"md5(trim(regexp_replace(body, '\s+', ' ', 'g')))"
_PENDING = r"regexp_matches(body, '(?im)^\s*(?:[-*]\s*)?(?:status|state)\s*:\s*(pending|open|blocked|in progress)\b|^\s*(?:[-*]\s*)?(?:pending|open|blockers?)\s*:\s*\S')"
_TERMINAL = r"regexp_matches(body, '(?im)^\s*(?:[-*]\s*)?(?:status|state)\s*:\s*(" + "|".join(M.TERMINAL_WORDS) + r")\b')"
_NEWEST = r"updated_at DESC, CASE WHEN lower(split_part(uri, '/', 5)) = topic THEN 0 ELSE 1 END, uri"


@query(sql("memory_records", f"""WITH r AS (SELECT *, (epoch({_NOW}) - epoch(updated_at)) / 86400.0::DOUBLE AS age, kind = 'handoff' AS h, {_PENDING} AS pending, {_TERMINAL} AS terminal FROM memory_records WHERE status = 'active'),
  a AS (SELECT *, CASE WHEN valid_to <= {_NOW} THEN 'archive:expired' WHEN h AND age >= 30 AND pending THEN 'review:retention-deferred' WHEN h AND age >= 30 THEN 'archive:maximum-age' WHEN h AND age >= 7 AND terminal AND NOT pending THEN 'archive:terminal' WHEN h AND age >= 14 THEN 'review:nonterminal' END AS aged FROM r),
  rest AS (SELECT *, {_SAME} AS same FROM a WHERE aged IS NULL),
  c AS (SELECT *, row_number() OVER (PARTITION BY project, topic, kind, same ORDER BY {_NEWEST}) AS copy, count(*) OVER (PARTITION BY project, topic, kind, same) AS copies FROM rest),
  g AS (SELECT *, sum(CASE WHEN copy = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY project, topic, kind) AS bodies, row_number() OVER (PARTITION BY project, topic, kind ORDER BY CASE WHEN copy = 1 THEN 0 ELSE 1 END, {_NEWEST}) AS age_rank FROM c)
SELECT uri, split_part(aged, ':', 1) AS action, split_part(aged, ':', 2) AS reason FROM a WHERE aged IS NOT NULL
UNION ALL SELECT uri, CASE WHEN copy > 1 THEN 'forget' WHEN bodies = 1 AND copies > 1 THEN 'keep' WHEN bodies = 1 THEN 'none' WHEN h AND age_rank = 1 THEN 'keep' WHEN h THEN 'archive' WHEN copies > 1 THEN 'keep' ELSE 'review' END,
  CASE WHEN copy > 1 THEN 'exact-duplicate' WHEN bodies = 1 AND copies > 1 THEN 'duplicates-merged' WHEN bodies = 1 THEN 'only' WHEN h AND age_rank = 1 THEN 'latest-handoff' WHEN h THEN 'older-handoff' WHEN copies > 1 THEN 'duplicates-merged' ELSE 'overlapping' END FROM g"""))
def compaction_plan(spark, d):
    return M.compaction_plan(memory_records(spark, d), now())


@query(sql("memory_records", r"""WITH g AS (SELECT project, topic, count(*) AS records, count(DISTINCT kind) AS kinds, count(DISTINCT CASE WHEN kind IN ('durable', 'incident') THEN trim(regexp_replace(body, '\s+', ' ', 'g')) END) AS bodies FROM memory_records WHERE status = 'active' GROUP BY ALL)
SELECT project, topic, records, concat_ws(',', CASE WHEN kinds > 1 THEN 'kinds' END, CASE WHEN bodies > 1 THEN 'bodies' END) AS reasons FROM g WHERE records >= 2 AND (kinds > 1 OR bodies > 1)"""))
def merge_review(spark, d):
    return M.merge_review(memory_records(spark, d))


@query(sql("memory_records", "SELECT project || '/' || topic || '/' || kind AS target, count(*) AS records, 'group' AS nudge FROM memory_records WHERE status = 'active' GROUP BY project, topic, kind HAVING count(*) >= 3 UNION ALL SELECT project, count(*), 'handoffs' FROM memory_records WHERE status = 'active' AND kind = 'handoff' GROUP BY project HAVING count(*) >= 10"))
def hygiene_nudges(spark, d):
    return M.nudges(memory_records(spark, d))


@query(sql("memory_records", f"SELECT uri, 'validity-expired' AS category, 'high' AS severity, strftime(valid_to, '%Y-%m-%d') AS detail FROM memory_records WHERE status = 'active' AND valid_to <= {_NOW}"))
def validity_expired(spark, d):
    return M.validity_findings(memory_records(spark, d), now())


_RELATION = "SELECT r.uri, 'relation-target' AS category, 'medium' AS severity, supersedes || ':' || coalesce(t.status, 'missing') AS detail FROM memory_records r LEFT JOIN (SELECT uri AS u, status FROM memory_records) t ON r.supersedes = t.u WHERE r.status = 'active' AND r.supersedes IS NOT NULL AND (t.u IS NULL OR t.status <> 'active')"


@query(sql("memory_records", _RELATION))
def relation_findings(spark, d):
    return M.relation_findings(memory_records(spark, d))


@query(sql("memory_records", f"""WITH f AS ({_RELATION} UNION ALL SELECT uri, 'validity-expired', 'high', strftime(valid_to, '%Y-%m-%d') FROM memory_records WHERE status = 'active' AND valid_to <= {_NOW}
  UNION ALL SELECT uri, 'review-overdue', 'low', strftime(updated_at, '%Y-%m-%d') FROM memory_records WHERE status = 'active' AND updated_at < {_NOW} - INTERVAL 30 DAY
  UNION ALL SELECT uri, 'duplicate', 'low', CAST(n AS VARCHAR) FROM (SELECT uri, count(*) OVER (PARTITION BY project, topic, kind, {_SAME}) AS n, row_number() OVER (PARTITION BY project, topic, kind, {_SAME} ORDER BY {_NEWEST}) AS k FROM memory_records WHERE status = 'active') WHERE k > 1)
SELECT uri, category, severity, detail, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS severity_rank FROM f"""))
def health_report(spark, d):
    return M.health_report(_findings(memory_records(spark, d)))


def _findings(r):
    return [M.relation_findings(r), M.validity_findings(r, now()), M.review_findings(r, now()), M.duplicate_findings(r)]


@query("WITH every AS (" + ORACLE_SQL["health_report"] + "), n AS (SELECT *, row_number() OVER (ORDER BY severity_rank, category, uri, detail) AS position FROM every) SELECT * FROM n WHERE position > 7")
def health_pages(spark, d):
    """All pages but the first, seven findings each, by their cursors."""
    r = memory_records(spark, d)
    page, cursor = M.health_page(_findings(r), r, 7)
    out = page.where("false")
    while cursor is not None:
        page, cursor = M.health_page(_findings(r), r, 7 if out.isEmpty() else 10_000_000, cursor)
        out = out.unionByName(page)
    return out


def _storage(spark, d):
    """Nations' orders as snapshots: their items as edges, their parts as symbols, their customers as files."""
    o, l, c = (read(spark, d, t) for t in ("orders", "lineitem", "customer"))
    snapshot = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("snapshot"), F.col("o_orderpriority").alias("classifier"))
    items = l.join(snapshot, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = items.select("snapshot", "classifier", (F.col("l_linenumber") + 20).cast("long").alias("payload_bytes"))
    symbols = items.select("snapshot", "classifier", "l_partkey").distinct().select("snapshot", "classifier", (F.col("l_partkey") % 97 + 10).alias("payload_bytes"))
    files = snapshot.select("snapshot", "classifier", (F.col("o_orderkey") % 1000 + 1).alias("bytes"))
    return M.storage_attribution(symbols, edges, files)


_STORAGE = """s AS (SELECT o_orderkey, c_nationkey AS snapshot, o_orderpriority AS classifier FROM orders JOIN customer ON o_custkey = c_custkey),
  i AS (SELECT snapshot, classifier, l_partkey, CAST(l_linenumber + 20 AS BIGINT) AS b FROM lineitem JOIN s ON l_orderkey = o_orderkey),
  e AS (SELECT snapshot, classifier, count(*) AS edge_rows, sum(b) AS b FROM i GROUP BY ALL),
  y AS (SELECT snapshot, classifier, count(*) AS symbol_rows, sum(l_partkey % 97 + 10) AS b FROM (SELECT DISTINCT snapshot, classifier, l_partkey FROM i) GROUP BY ALL),
  f AS (SELECT snapshot, classifier, count(*) AS files, CAST(sum(o_orderkey % 1000 + 1) AS BIGINT) AS source_bytes FROM s GROUP BY ALL),
  a AS (SELECT snapshot, classifier, files, source_bytes, coalesce(symbol_rows, 0) AS symbol_rows, coalesce(edge_rows, 0) AS edge_rows, CAST(coalesce(y.b, 0) + coalesce(e.b, 0) AS BIGINT) AS logical_bytes FROM f LEFT JOIN y USING (snapshot, classifier) LEFT JOIN e USING (snapshot, classifier))"""


@query(f"WITH {_STORAGE} SELECT *, CASE WHEN symbol_rows > 0 THEN round(logical_bytes / symbol_rows::DOUBLE, 6) END AS bytes_per_symbol, CASE WHEN sum(logical_bytes) OVER (PARTITION BY snapshot) > 0 THEN round(logical_bytes / (sum(logical_bytes) OVER (PARTITION BY snapshot))::DOUBLE, 6) ELSE 0.0::DOUBLE END AS share FROM a")
def storage_by_classifier(spark, d):
    return _storage(spark, d)


@query(f"WITH {_STORAGE}, b AS (SELECT snapshot, sum(logical_bytes) AS b FROM a GROUP BY snapshot) SELECT n_regionkey AS repository, CAST(sum(b) AS BIGINT) AS logical_bytes, CAST(sum(CASE WHEN n_nationkey % 3 = 0 THEN b ELSE 0 END) AS BIGINT) AS reclaimable, sum(CASE WHEN n_nationkey % 3 = 0 THEN b ELSE 0 END) >= 5000 AND sum(CASE WHEN n_nationkey % 3 = 0 THEN b ELSE 0 END) >= 0.4::DOUBLE * sum(b) AS recommended FROM b JOIN nation ON n_nationkey = snapshot GROUP BY n_regionkey")
def compaction_advice(spark, d):
    """Regions as repositories; every third nation's snapshot is retired."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("snapshot"), F.col("n_regionkey").alias("repository"), (F.col("n_nationkey") % 3 != 0).alias("active"))
    return M.compaction_recommended(_storage(spark, d), n, 0.4, 5000)


@query(sql("memory_records", f"""WITH n AS (SELECT supersedes AS uri, count(*) AS superseders FROM memory_records WHERE status = 'active' AND supersedes IS NOT NULL GROUP BY 1)
SELECT r.uri, coalesce(superseders, 0) AS superseders, CASE WHEN body = '' THEN 'unresolved' WHEN superseders > 1 THEN 'conflicted' WHEN status <> 'active' OR superseders = 1 OR valid_to < {_NOW} THEN 'historical' ELSE 'current' END AS state FROM memory_records r LEFT JOIN n ON r.uri = n.uri"""))
def premise_state(spark, d):
    return M.premise_state(memory_records(spark, d), now())


@query(sql("memory_records", """WITH l AS (SELECT uri AS source, supersedes AS target FROM memory_records WHERE supersedes IN (SELECT uri FROM memory_records)), s AS (SELECT uri AS seed FROM memory_records)
SELECT seed, 'outgoing' AS direction, target AS neighbour FROM l JOIN s ON source = seed UNION ALL SELECT seed, 'incoming', source FROM l JOIN s ON target = seed"""))
def memory_one_hop(spark, d):
    r = memory_records(spark, d)
    return M.one_hop(r, r)


@query()
def claim_contradictions(spark, d):
    """Every other record restates or denies a claim of its topic's first turn."""
    r = memory_records(spark, d)
    first = F.element_at(X.claims(F.col("body")), 1)
    denied = F.when(F.col("generation") % 2 == 1, F.concat(F.lit("not "), first)).otherwise(first)
    base = r.where("generation = 0").select("project", "topic", F.col("body").alias("b0"))
    told = r.join(base, ["project", "topic"]).withColumn("body", F.when(F.col("generation") < 3, F.when(F.col("generation") % 2 == 1, F.concat(F.lit("not "), F.element_at(X.claims(F.col("b0")), 1))).otherwise(F.col("b0"))).otherwise(denied))
    return M.contradictions(told.where("body is not null"))


@query(sql("feedback", f"""WITH e AS (SELECT uri, event_id, ts, (CASE action WHEN 'applied' THEN 0.3::DOUBLE WHEN 'dismiss' THEN -0.25::DOUBLE WHEN 'pin' THEN 0.4::DOUBLE WHEN 'useful' THEN 0.15::DOUBLE WHEN 'wrong' THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END) * pow(2.0::DOUBLE, -greatest((epoch({_NOW}) - epoch(ts)) / 86400.0::DOUBLE, 0.0::DOUBLE) / 90.0::DOUBLE) AS d FROM feedback)
SELECT uri, round(list_reduce(list_prepend(0.0::DOUBLE, list(d ORDER BY ts, event_id)), lambda a, x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, a + x))), 6) AS score FROM e GROUP BY uri"""))
def feedback_decay(spark, d):
    return M.feedback_scores(feedback(spark, d), now())


@query(sql("feedback", "SELECT count(CASE WHEN action = 'applied' THEN 1 END) AS applied, count(CASE WHEN action = 'dismiss' THEN 1 END) AS dismiss, count(CASE WHEN action = 'pin' THEN 1 END) AS pin, count(CASE WHEN action = 'useful' THEN 1 END) AS useful, count(CASE WHEN action = 'wrong' THEN 1 END) AS wrong FROM feedback WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'"))
def feedback_counts(spark, d):
    return M.feedback_counts(feedback(spark, d), "2024-01-05 00:00:00")


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total, round(median(value), 6) AS median, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY event_type")
def value_report(spark, d):
    return M.value_report(read(spark, d, "events"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN k = least(n - 1, floor(n * 0.5::DOUBLE)) THEN value END) AS p50, max(CASE WHEN k = least(n - 1, floor(n * 0.95::DOUBLE)) THEN value END) AS p95, max(CASE WHEN k = least(n - 1, floor(n * 0.99::DOUBLE)) THEN value END) AS p99, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM r GROUP BY event_type""")
def benchmark_percentiles(spark, d):
    return M.percentiles(read(spark, d, "events"), ["event_type"], "value")


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS requests FROM events GROUP BY ALL")
def rate_limit_minute(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.rate_counts(e, ["event_type"]).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id % 25, event_type ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR epoch(ts) - epoch(b) >= 3600")
def dedupe_hour(spark, d):
    e = read(spark, d, "events").withColumn("u", F.col("user_id") % 25)
    return ST.drop_repeats_batch(e, ["u", "event_type"]).select("event_id", "user_id", "event_type")


@query("""WITH s AS (SELECT user_id % 10 AS u, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) + INTERVAL 45 SECOND > ts THEN 0 ELSE 1 END AS fresh, event_id FROM events),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY u ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT u, min(ts) AS started, max(ts) + INTERVAL 45 SECOND AS settled, count(*) AS changes FROM g GROUP BY u, k""")
def session_debounce(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 10).alias("u"), F.col("ts").cast("timestamp").alias("ts"))
    return ST.settle(e, ["u"]).select("u", F.col("started").cast("timestamp_ntz").alias("started"), F.col("settled").cast("timestamp_ntz").alias("settled"), "changes")


@query("SELECT count(CASE WHEN user_id % 7 >= 5 THEN 1 END) AS dead_letters, count(CASE WHEN user_id % 7 < 5 AND event_type <> 'purchase' THEN 1 END) AS pending, min(CASE WHEN user_id % 7 < 5 AND event_type <> 'purchase' THEN ts END) AS oldest_pending FROM events")
def outbox_health(spark, d):
    return M.outbox_health(read(spark, d, "events").select((F.col("user_id") % 7).alias("attempts"), (F.col("event_type") == "purchase").alias("done"), F.col("ts").alias("created_at")))


@query("SELECT user_id % 40 AS share, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, count(*) - 1 AS superseded FROM events GROUP BY 1")
def demand_latest(spark, d):
    return ST.latest_demand(read(spark, d, "events").withColumn("share", F.col("user_id") % 40), "share")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def retention_cap(spark, d):
    return ST.retain(read(spark, d, "events"), "2024-06-01 00:00:00", days=3650, most=300).select("event_id", "ts")


@query("""WITH r AS (SELECT event_id AS request_id, CAST(user_id % 60 AS VARCHAR) AS key, CAST(event_id % 3 AS VARCHAR) AS body_hash, user_id % 30 AS uri, CAST(event_id % 4 AS BIGINT) AS base_generation FROM events), done AS (SELECT CAST(i AS VARCHAR) AS key, CAST(i % 3 AS VARCHAR) AS old_hash FROM range(0, 20) t(i)), heads AS (SELECT i AS uri, i % 4 AS head FROM range(0, 25) t(i))
SELECT request_id, uri, plan, CASE WHEN plan = 'commit' THEN coalesce(head, 0) + 1 END AS next_generation FROM (SELECT r.*, head, CASE WHEN old_hash = body_hash THEN 'replay' WHEN old_hash IS NOT NULL THEN 'idempotency-conflict' WHEN base_generation IS DISTINCT FROM head THEN 'stale-base' ELSE 'commit' END AS plan FROM r LEFT JOIN done USING (key) LEFT JOIN heads USING (uri))""")
def mutation_plan(spark, d):
    r = read(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 60).cast("string").alias("key"), (F.col("event_id") % 3).cast("string").alias("body_hash"), (F.col("user_id") % 30).alias("uri"), (F.col("event_id") % 4).cast("long").alias("base_generation"))
    done = spark.range(20).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).cast("string").alias("body_hash"))
    heads = spark.range(25).select(F.col("id").alias("uri"), (F.col("id") % 4).alias("generation"))
    return M.mutation_plan(r, heads, done)


@query("""WITH r AS (SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' WHEN 2 THEN 'archived' ELSE 'expired' END AS state, CASE event_type WHEN 'view' THEN 'complete' WHEN 'click' THEN 'archive' WHEN 'error' THEN 'expire' WHEN 'purchase' THEN 'reopen' ELSE 'restore' END AS operation FROM events)
SELECT id, state, operation, coalesce(CASE state || '-' || operation WHEN 'active-complete' THEN 'completed' WHEN 'active-archive' THEN 'archived' WHEN 'active-expire' THEN 'expired' WHEN 'completed-archive' THEN 'archived' WHEN 'completed-reopen' THEN 'active' WHEN 'archived-restore' THEN 'active' WHEN 'expired-restore' THEN 'active' WHEN 'expired-archive' THEN 'archived' END, 'rejected') AS next FROM r""")
def lifecycle_transition(spark, d):
    e = read(spark, d, "events")
    state = F.element_at(F.array(*[F.lit(s) for s in ("active", "completed", "archived", "expired")]), (F.col("user_id") % 4 + 1).cast("int"))
    op = F.when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "click", "archive").when(F.col("event_type") == "error", "expire").when(F.col("event_type") == "purchase", "reopen").otherwise("restore")
    return M.transition(e.select(F.col("event_id").alias("id"), state.alias("state"), op.alias("operation")))


@query("SELECT user_id, job_id FROM (SELECT user_id % 12 AS user_id, event_id AS job_id, row_number() OVER (PARTITION BY user_id % 12 ORDER BY ts, event_id) AS turn FROM events) WHERE turn <= 20 ORDER BY turn, CASE WHEN lpad(CAST(user_id AS VARCHAR), 2, '0') > '05' THEN 0 ELSE 1 END, user_id LIMIT 20")
def due_jobs(spark, d):
    j = read(spark, d, "events").select(F.lpad((F.col("user_id") % 12).cast("string"), 2, "0").alias("tenant"), F.col("event_id").alias("job_id"), F.col("ts").alias("due_at"))
    return M.due_jobs(j, "05", 20).select(F.col("tenant").cast("long").alias("user_id"), "job_id")


@query("SELECT event_id, CAST(least(21600000.0, 60000.0 * pow(2.0, greatest(event_id % 14 - 1, 0))) AS BIGINT) AS backoff FROM events")
def retry_backoff(spark, d):
    return read(spark, d, "events").select("event_id", S.backoff_ms(F.col("event_id") % 14).alias("backoff"))


@query("SELECT item_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fingerprint FROM benchmark".replace("\\\\", "\\"))
def query_fingerprints(spark, d):
    return read(spark, d, "benchmark").select("item_id", X.query_fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id HAVING count(*) > 9 OR sum(CASE WHEN turn = 8 THEN 1 ELSE 0 END) > 0 OR (count(*) > 1 AND sum(length(text)) > 4000)")
def snapshot_retention(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), (F.col("turn") == 8).alias("flagged"), F.length("text").cast("long").alias("bytes"))
    return M.retention(c, 9, 4000).select(F.col("key").alias("conv_id"), "n", "bytes")
