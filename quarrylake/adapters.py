"""Typed views of the sample tables in the shapes that the operators take, and the same views as SQL.

Each view is a function (spark, sf_dir) -> DataFrame; VIEWS holds its DuckDB text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as X

#: What stands for the present time in queries.
NOW = "2026-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def recall_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of recall: scopes, time, trust and logical key."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    source = F.coalesce("source", F.lit(""))
    return d.select(
        F.col("doc_id"), F.concat(F.lit("mem://"), source, F.lit("/"), F.col("doc_id").cast("string")).alias("uri"), F.col("source").alias("project"), F.col("lang").alias("workspace_scope"),
        F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("logical_key"),
        F.expr("timestamp_seconds(1735689600 + (doc_id * 7919) % 31536000)").alias("recorded_at"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("approved"), F.when(F.coalesce("toxic", F.lit(0)) == 1, "untrusted").otherwise("approved").alias("trust"),
        F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes from the business tables."""
    r = lambda n: read(spark, sf_dir, n)
    row = lambda prefix, key, kind, name, package, path, exported: [F.concat(F.lit(prefix + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.concat(package, F.lit("."), name).alias("qualified_name"), package.alias("package_name"), path.alias("path"), exported.alias("exported"), F.lit("typescript" if kind in ("class", "function") else "python").alias("language")]
    part = r("part").select(*row("part", "p_partkey", "function", F.col("p_name"), F.col("p_brand"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit(".ts")), F.col("p_size") % 2 == 0))
    supplier = r("supplier").select(*row("supplier", "s_suppkey", "module", F.col("s_name"), F.lit("supplier"), F.concat(F.lit("tests/"), F.col("s_nationkey").cast("string"), F.lit(".py")), F.lit(True)))
    customer = r("customer").select(*row("customer", "c_custkey", "class", F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit("app/"), F.col("c_mktsegment"), F.lit(".ts")), F.col("c_acctbal") > 0))
    orders = r("orders").select(*row("order", "o_orderkey", "method", F.concat(F.lit("order"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), F.concat(F.lit("docs/"), F.col("o_orderpriority"), F.lit(".md")), F.col("o_orderstatus") == "F"))
    nation = r("nation").select(*row("nation", "n_nationkey", "package", F.col("n_name"), F.lit("nation"), F.lit("src/nation/index.ts"), F.lit(True)))
    region = r("region").select(*row("region", "r_regionkey", "package", F.col("r_name"), F.lit("region"), F.lit("src/region/index.ts"), F.lit(True)))
    out = part
    for other in (supplier, customer, orders, nation, region):
        out = out.unionByName(other)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges; some line items have a confidence out of range and some no target."""
    r = lambda n: read(spark, sf_dir, n)
    s = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    prov = F.when(F.col("l_returnflag") == "A", "declared").when(F.col("l_returnflag") == "N", "resolved").when(F.col("l_discount") > 0.05, "heuristic").otherwise("syntactic")
    conf = F.when(F.col("l_quantity") >= 50, 1.2).otherwise(1 - F.col("l_discount") * 5)
    line = r("lineitem").select(F.concat(F.lit("l:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("id"), s("order:", "l_orderkey").alias("source_id"), F.when(F.col("l_quantity") > 1, s("part:", "l_partkey")).alias("target_id"), F.lit("calls").alias("relation"), prov.alias("provenance"), conf.cast("double").alias("confidence"))
    order = r("orders").select(s("o:", "o_orderkey").alias("id"), s("order:", "o_orderkey").alias("source_id"), s("customer:", "o_custkey").alias("target_id"), F.lit("depends_on").alias("relation"), F.lit("declared").alias("provenance"), F.lit(1.0).alias("confidence"))
    customer = r("customer").select(s("c:", "c_custkey").alias("id"), s("customer:", "c_custkey").alias("source_id"), s("nation:", "c_nationkey").alias("target_id"), F.lit("extends").alias("relation"), F.lit("resolved").alias("provenance"), F.lit(0.8).alias("confidence"))
    supplier = r("supplier").select(s("s:", "s_suppkey").alias("id"), s("supplier:", "s_suppkey").alias("source_id"), s("nation:", "s_nationkey").alias("target_id"), F.lit("imports").alias("relation"), F.lit("syntactic").alias("provenance"), F.lit(0.75).alias("confidence"))
    nation = r("nation").select(s("n:", "n_nationkey").alias("id"), s("region:", "n_regionkey").alias("source_id"), s("nation:", "n_nationkey").alias("target_id"), F.lit("contains").alias("relation"), F.lit("model").alias("provenance"), F.lit(0.5).alias("confidence"))
    out = line
    for other in (order, customer, supplier, nation):
        out = out.unionByName(other)
    return out


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small structural part of the graph: everything but the line items and orders."""
    return edges(spark, sf_dir).where("relation in ('extends', 'imports', 'contains')")


def snapshot_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, overlay, tombstones) of the parts: a fifth overridden with a new name, a seventh deleted."""
    s = symbols(spark, sf_dir).where("kind = 'function'")
    key = F.substring_index("id", ":", -1).cast("long")
    overlay = s.where(key % 5 == 0).withColumn("name", F.concat(F.col("name"), F.lit(" v2")))
    return s, overlay, s.where(key % 7 == 0).select("id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: action, uri, project, query key, time."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "pin", "purchase", "applied", "error", "wrong", "view", "useful", "click", "dismiss")])
    return read(spark, sf_dir, "events").select("event_id", kind[F.col("event_type")].alias("action"), F.concat(F.lit("mem://u/"), (F.col("user_id") % 50).cast("string")).alias("uri"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("user_id"), F.col("ts"))


def memory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as memory records."""
    c = read(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    return c.select(
        F.concat(F.lit("mem://r/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("uri"), F.concat(F.lit("topic-"), F.col("conv_id").cast("string")).alias("topic"), F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string")).alias("project"),
        F.when(F.col("role") == "user", "durable").when(F.col("role") == "assistant", "handoff").otherwise("incident").alias("kind"), F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "archived").otherwise("active").alias("status"),
        text.alias("body"), F.col("turn").cast("long").alias("generation"),
        F.expr("timestamp_seconds(1767225600 - 86400 * ((conv_id * 13 + turn * 5) % 45))").alias("updated_at"),
        F.expr("case when (conv_id + turn) % 5 = 0 then timestamp_seconds(1767225600 + 86400 * ((conv_id + turn) % 9 - 5)) end").alias("valid_to"),
        F.expr("case when turn > 0 then concat('mem://r/', cast(conv_id as string), '/', cast(turn - 1 as string)) end").alias("supersedes"),
    )


VIEWS = {
    "recall_docs": """recall_docs AS (SELECT d.doc_id, 'mem://' || coalesce(source, '') || '/' || d.doc_id AS uri, source AS project, lang AS workspace_scope, coalesce(text, '') AS text, md5(coalesce(text, '')) AS logical_key,
        to_timestamp(1735689600 + (d.doc_id * 7919) % 31536000)::TIMESTAMP AS recorded_at, coalesce(quality, 0) = 1 AS approved, CASE WHEN coalesce(toxic, 0) = 1 THEN 'untrusted' ELSE 'approved' END AS trust, split_part(coalesce(text, ''), chr(10), 1) AS title
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)""",
    "symbols": """symbols AS (SELECT id, kind, name, package_name || '.' || name AS qualified_name, package_name, path, exported, CASE WHEN kind IN ('class', 'function') THEN 'typescript' ELSE 'python' END AS language FROM (
        SELECT 'part:' || p_partkey AS id, 'function' AS kind, p_name AS name, p_brand AS package_name, 'src/' || p_brand || '/' || p_type || '.ts' AS path, p_size % 2 = 0 AS exported FROM part
        UNION ALL SELECT 'supplier:' || s_suppkey, 'module', s_name, 'supplier', 'tests/' || s_nationkey || '.py', true FROM supplier
        UNION ALL SELECT 'customer:' || c_custkey, 'class', c_name, c_mktsegment, 'app/' || c_mktsegment || '.ts', c_acctbal > 0 FROM customer
        UNION ALL SELECT 'order:' || o_orderkey, 'method', 'order' || o_orderkey, o_orderpriority, 'docs/' || o_orderpriority || '.md', o_orderstatus = 'F' FROM orders
        UNION ALL SELECT 'nation:' || n_nationkey, 'package', n_name, 'nation', 'src/nation/index.ts', true FROM nation
        UNION ALL SELECT 'region:' || r_regionkey, 'package', r_name, 'region', 'src/region/index.ts', true FROM region))""",
    "edges": """edges AS (SELECT 'l:' || l_orderkey || ':' || l_linenumber AS id, 'order:' || l_orderkey AS source_id, CASE WHEN l_quantity > 1 THEN 'part:' || l_partkey END AS target_id, 'calls' AS relation,
        CASE WHEN l_returnflag = 'A' THEN 'declared' WHEN l_returnflag = 'N' THEN 'resolved' WHEN l_discount > 0.05::DOUBLE THEN 'heuristic' ELSE 'syntactic' END AS provenance, CASE WHEN l_quantity >= 50 THEN 1.2::DOUBLE ELSE 1 - l_discount * 5 END AS confidence FROM lineitem
        UNION ALL SELECT 'o:' || o_orderkey, 'order:' || o_orderkey, 'customer:' || o_custkey, 'depends_on', 'declared', 1.0 FROM orders
        UNION ALL SELECT 'c:' || c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'extends', 'resolved', 0.8 FROM customer
        UNION ALL SELECT 's:' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports', 'syntactic', 0.75 FROM supplier
        UNION ALL SELECT 'n:' || n_nationkey, 'region:' || n_regionkey, 'nation:' || n_nationkey, 'contains', 'model', 0.5 FROM nation)""",
    "code_edges": "code_edges AS (SELECT * FROM edges WHERE relation IN ('extends', 'imports', 'contains'))",
    "snapshot": """base_symbols AS (SELECT * FROM symbols WHERE kind = 'function'),
        overlay_symbols AS (SELECT id, kind, name || ' v2' AS name, qualified_name, package_name, path, exported, language FROM base_symbols WHERE CAST(split_part(id, ':', 2) AS BIGINT) % 5 = 0),
        tombstones AS (SELECT id FROM base_symbols WHERE CAST(split_part(id, ':', 2) AS BIGINT) % 7 = 0)""",
    "vectors": "vectors AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)",
    "feedback": """feedback AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'pin' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'wrong' WHEN 'view' THEN 'useful' WHEN 'click' THEN 'dismiss' END AS action,
        'mem://u/' || (user_id % 50) AS uri, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, ts FROM events)""",
    "memory_records": """memory_records AS (SELECT 'mem://r/' || conv_id || '/' || turn AS uri, 'topic-' || conv_id AS topic, 'p' || (conv_id % 7) AS project, CASE WHEN role = 'user' THEN 'durable' WHEN role = 'assistant' THEN 'handoff' ELSE 'incident' END AS kind,
        CASE WHEN (conv_id + turn) % 11 = 0 THEN 'archived' ELSE 'active' END AS status, coalesce(text, '') AS body, turn AS generation, to_timestamp(1767225600 - 86400 * ((conv_id * 13 + turn * 5) % 45))::TIMESTAMP AS updated_at,
        CASE WHEN (conv_id + turn) % 5 = 0 THEN to_timestamp(1767225600 + 86400 * ((conv_id + turn) % 9 - 5))::TIMESTAMP END AS valid_to, CASE WHEN turn > 0 THEN 'mem://r/' || conv_id || '/' || (turn - 1) END AS supersedes FROM conversations)""",
    # lexical terms of a text, as the SQL macro-free expression the views below share
    "doc_terms": r"""doc_tokens AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ʼ’‐‑‒–—―−', '''''-------'), '[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:[._/''-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*)*')) AS t FROM recall_docs)
          WHERE length(t) >= 3 OR (length(t) = 2 AND regexp_matches(t, '\p{L}') AND regexp_matches(t, '[^\x00-\x7F]'))),
        doc_terms AS (SELECT doc_id, lower(t) AS term FROM doc_tokens
          UNION ALL SELECT doc_id, term FROM (SELECT doc_id, lower(t) AS low, unnest(list_transform(string_split_regex(regexp_replace(t, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '[._/''-]+'), lambda p: lower(p))) AS term FROM doc_tokens) WHERE length(term) >= 2 AND term <> low)""",
    "postings": r"""postings AS (SELECT doc_id, term, max(w) AS field_weight, CAST(greatest(sum(n), 1) AS BIGINT) AS tf FROM (
          SELECT doc_id, term, 1 AS w, 1 AS n FROM doc_terms UNION ALL SELECT doc_id, lower(project), 1, 0 FROM recall_docs WHERE length(project) >= 3 UNION ALL SELECT doc_id, term, 3, 0 FROM title_terms) GROUP BY doc_id, term)""",
    "title_terms": r"""title_tokens AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(translate(title, 'ʼ’‐‑‒–—―−', '''''-------'), '[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:[._/''-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*)*')) AS t FROM recall_docs)
          WHERE length(t) >= 3 OR (length(t) = 2 AND regexp_matches(t, '\p{L}') AND regexp_matches(t, '[^\x00-\x7F]'))),
        title_terms AS (SELECT doc_id, lower(t) AS term FROM title_tokens
          UNION ALL SELECT doc_id, term FROM (SELECT doc_id, lower(t) AS low, unnest(list_transform(string_split_regex(regexp_replace(t, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '[._/''-]+'), lambda p: lower(p))) AS term FROM title_tokens) WHERE length(term) >= 2 AND term <> low)""",
    "query_terms": r"""query_terms AS (SELECT DISTINCT item_id, lower(t) AS term FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(translate(text, 'ʼ’‐‑‒–—―−', '''''-------'), '[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:[._/''-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*)*'), lambda t: length(t) >= 3)) AS t FROM benchmark))""",
}


def sql(views: str, body: str) -> str:
    """The named views (in order) before a body of common table expressions and a SELECT."""
    text = body.strip()
    lead = ",\n".join(VIEWS[v] for v in views.split())
    if text[:5].upper() == "WITH ":
        return f"WITH {lead},\n{text[5:]}"
    if text[:10].upper() == "RECURSIVE ":
        return f"WITH RECURSIVE {lead},\n{text[10:]}"
    return f"WITH {lead}\n{text}"
