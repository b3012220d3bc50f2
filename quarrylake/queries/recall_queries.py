"""Recall queries over documents, benchmark, embeddings and pages."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ..adapters import read, recall_docs, sql, vectors
from ..functions import scores as S, text as X
from ..operators import recall as R, recall_index as I, traversal as T, vector_index as V
from ..plans import predicates as P

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def _postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, field_weight, tf, n) of the documents and their projects' names; of the wanted terms (term) only, if given."""
    return R.weighted_terms(docs, "doc_id", {"title": S.TITLE}, "text", "project", wanted)


def _opened(spark, d) -> I.RecallIndex:
    """The index of a folder's documents, kept in the shared folder and brought up to date."""
    return I.opened(recall_docs(spark, d), f"{T.shared_dir(spark)}/recall-index/{I.LAYOUT}-{hashlib.md5(d.encode()).hexdigest()}", _postings)


def _terms(spark, d) -> DataFrame:
    """query_id, term: the tokens of 3 characters or more of each benchmark text."""
    t = F.filter(X.tokens(F.col("text")), lambda x: F.length(x) >= 3)
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.transform(t, F.lower))).alias("term"))


_STATS = """lengths AS (SELECT r.doc_id, r.logical_key, r.uri, r.recorded_at, coalesce(n, 0) AS length FROM recall_docs r LEFT JOIN (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id) t ON r.doc_id = t.doc_id),
  stats AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(coalesce(sum(l), 0) AS BIGINT) AS total_length FROM (SELECT logical_key, max(length) AS l FROM lengths GROUP BY logical_key)),
  freq AS (SELECT term, count(DISTINCT logical_key) AS frequency FROM postings p JOIN recall_docs USING (doc_id) WHERE term IN (SELECT term FROM query_terms) GROUP BY term),
  chosen AS (SELECT item_id, term, frequency, rank FROM (SELECT item_id, term, frequency, row_number() OVER (PARTITION BY item_id ORDER BY ln(1 + (documents - frequency + 0.5::DOUBLE) / (frequency + 0.5::DOUBLE)) DESC, term) AS rank FROM query_terms JOIN freq USING (term), stats) WHERE rank <= 32)"""


@query(sql("recall_docs doc_terms title_terms postings query_terms", f"""WITH {_STATS},
  scored AS (SELECT q.item_id AS query_id, p.term, p.doc_id, l.uri, p.field_weight,
    ln(1 + (documents - frequency + 0.5::DOUBLE) / (frequency + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / greatest(total_length / greatest(documents, 1)::DOUBLE, 1.0::DOUBLE)))) + field_weight / 4.0::DOUBLE AS term_score
    FROM postings p JOIN chosen q USING (term) JOIN lengths l USING (doc_id), stats),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id, term ORDER BY term_score DESC, field_weight DESC, uri) AS r FROM scored),
  total AS (SELECT query_id, doc_id, uri, round(sum(term_score), 6) AS score FROM best WHERE r <= 256 GROUP BY ALL)
SELECT query_id, uri, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS rank FROM total) WHERE rank <= 10"""))  # fmt: skip
def bm25_topk(spark, d):
    index, terms = _opened(spark, d), _terms(spark, d)
    some = index.buckets_of(terms)
    return R.bm25(terms, index.postings(some), index.documents, "doc_id", frequency=index.frequency(some)).select("query_id", "uri", "score")


def _older(docs: DataFrame) -> DataFrame:
    """The documents as they were: a ninth not yet there, a seventh with another text, and a fifth that have gone since."""
    gone = docs.where("doc_id % 5 = 0").withColumn("doc_id", -1 - F.col("doc_id")).withColumn("uri", F.concat("uri", F.lit("/old")))
    was = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("earlier words of "), F.col("text"))).otherwise(F.col("text"))
    return docs.where("doc_id % 9 <> 0").withColumn("text", was).unionByName(gone)


def _refreshed(spark, d) -> I.RecallIndex:
    docs = recall_docs(spark, d)
    index = I.build(_older(docs), f"{T.shared_dir(spark)}/recall-index/{uuid.uuid4().hex}", _postings)
    return I.refresh(index, docs, _postings)


@query(sql("recall_docs doc_terms title_terms postings query_terms", f"""WITH {_STATS.removesuffix(" WHERE rank <= 32)")}),
  scored AS (SELECT q.item_id AS query_id, p.doc_id, l.uri,
    ln(1 + (documents - frequency + 0.5::DOUBLE) / (frequency + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / greatest(total_length / greatest(documents, 1)::DOUBLE, 1.0::DOUBLE)))) + field_weight / 4.0::DOUBLE AS term_score
    FROM postings p JOIN chosen q USING (term) JOIN lengths l USING (doc_id), stats),
  total AS (SELECT query_id, doc_id, uri, round(sum(term_score), 6) AS score FROM scored GROUP BY ALL)
SELECT query_id, uri, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS rank FROM total) WHERE rank <= 10"""))  # fmt: skip
def index_refresh_topk(spark, d):
    """The best of all documents by an index that was built on older documents and refreshed: those of an index of today's. No pool of a term and no list of a query's terms is cut."""
    index, terms = _refreshed(spark, d), _terms(spark, d)
    some = index.buckets_of(terms)
    return R.whole_bm25(terms, index.postings(some), index.documents, "doc_id", frequency=index.frequency(some)).select("query_id", "uri", "score")


@query(sql("recall_docs doc_terms title_terms postings", "SELECT term, count(DISTINCT logical_key) AS frequency FROM postings JOIN recall_docs USING (doc_id) GROUP BY term"))
def index_refresh_frequency(spark, d):
    """All document frequencies of the refreshed index."""
    return _refreshed(spark, d).frequency()


@query(sql("recall_docs doc_terms title_terms postings query_terms", f"""WITH {_STATS},
  scored AS (SELECT q.item_id AS query_id, p.term, p.doc_id, l.uri, l.logical_key, p.field_weight,
    ln(1 + (documents - frequency + 0.5::DOUBLE) / (frequency + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / greatest(total_length / greatest(documents, 1)::DOUBLE, 1.0::DOUBLE)))) + field_weight / 4.0::DOUBLE AS term_score
    FROM postings p JOIN chosen q USING (term) JOIN lengths l USING (doc_id), stats),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, term ORDER BY term_score DESC, field_weight DESC, uri) AS r FROM scored) WHERE r <= 256),
  asked AS (SELECT item_id AS query_id, count(*) AS query_terms FROM query_terms GROUP BY item_id),
  terms AS (SELECT query_id, count(*) AS indexed_terms, max(n) AS fullest_pool FROM (SELECT query_id, term, count(*) AS n FROM pool GROUP BY ALL) GROUP BY query_id),
  ranked AS (SELECT query_id, count(DISTINCT doc_id) AS ranked_documents, count(DISTINCT logical_key) AS candidates FROM pool GROUP BY query_id)
SELECT query_id, query_terms, coalesce(indexed_terms, 0) AS indexed_terms, coalesce(fullest_pool, 0) AS fullest_pool, coalesce(ranked_documents, 0) AS ranked_documents, coalesce(candidates, 0) AS candidates,
  query_terms = coalesce(indexed_terms, 0) AND coalesce(fullest_pool, 0) < 256 AND coalesce(ranked_documents, 0) <= 512 AND coalesce(candidates, 0) <= 400 AS exhaustive FROM asked LEFT JOIN terms USING (query_id) LEFT JOIN ranked USING (query_id)"""))  # fmt: skip
def exhaustive_proof(spark, d):
    """Which benchmark queries were answered in full."""
    index, terms = _opened(spark, d), _terms(spark, d)
    some = index.buckets_of(terms)
    pools = T.written(R.term_pools(terms, index.postings(some), index.documents, "doc_id", frequency=index.frequency(some)), "pools")
    return R.exhaustive(terms, pools, index.documents, "doc_id", 256, 512, 400)


@query(sql("recall_docs doc_terms title_terms postings query_terms", f"WITH {_STATS} SELECT documents, total_length FROM stats"))
def corpus_stats_logical(spark, d):
    return R.logical_statistics(R.document_lengths(recall_docs(spark, d), "doc_id", "text"))


@query(sql("recall_docs doc_terms title_terms postings query_terms", f"WITH {_STATS} SELECT term, frequency FROM freq"))
def doc_frequency(spark, d):
    docs = recall_docs(spark, d)
    return R.term_frequency(docs, {"title", "text"}, "project", _terms(spark, d).select("term").distinct())


@query(sql("recall_docs doc_terms title_terms postings", "SELECT doc_id, term, CAST(field_weight AS BIGINT) AS field_weight, tf FROM postings"))
def postings_build(spark, d):
    return _postings(recall_docs(spark, d)).select("doc_id", "term", F.col("field_weight").cast("long").alias("field_weight"), "tf")


@query(sql("recall_docs doc_terms title_terms postings query_terms", f"WITH {_STATS} SELECT item_id AS query_id, term, rank FROM chosen"))
def query_term_selection(spark, d):
    index, terms = _opened(spark, d), _terms(spark, d)
    frequency = index.frequency(index.buckets_of(terms)).crossJoin(R.logical_statistics(index.documents))  # one row
    return R.select_query_terms(terms, frequency, F.col("documents")).select("query_id", "term", F.col("rank").cast("long").alias("rank"))


@query(sql("recall_docs doc_terms title_terms postings", "SELECT term, uri, rank FROM (SELECT term, uri, row_number() OVER (PARTITION BY term ORDER BY recorded_at DESC, uri) AS rank FROM postings JOIN recall_docs USING (doc_id) WHERE term IN ('the', 'und', 'les', 'que', 'license')) WHERE rank <= 8"))
def recency_lane(spark, d):
    docs = recall_docs(spark, d)
    terms = spark.createDataFrame([(t,) for t in ("the", "und", "les", "que", "license")], "term string")
    return R.recency_lane(terms, _postings(docs, terms), docs, "doc_id", 8).select("term", "uri", F.col("rank").cast("long").alias("rank"))


@query(sql("recall_docs", "SELECT uri, project FROM recall_docs WHERE uri = 'mem://src1' OR starts_with(uri, 'mem://src1/') OR uri = 'mem://src3/3' OR starts_with(uri, 'mem://src3/3/')"))
def uri_scope_filter(spark, d):
    return recall_docs(spark, d).where(P.uri_scope(F.col("uri"), ["mem://src1/", " ", "mem://src3/3#a"])).select("uri", "project")


@query(sql("recall_docs", "SELECT workspace_scope, 'hierarchy' AS mode, count(*) AS n FROM recall_docs WHERE workspace_scope IS NULL OR workspace_scope = 'de' GROUP BY ALL UNION ALL SELECT workspace_scope, 'sibling', count(*) FROM recall_docs WHERE workspace_scope <> 'de' GROUP BY ALL"))
def workspace_scope_filter(spark, d):
    docs = recall_docs(spark, d)
    part = lambda mode: docs.where(P.workspace_scope(F.col("workspace_scope"), "./DE/", mode)).groupBy("workspace_scope", F.lit(mode).alias("mode")).agg(F.count("*").alias("n"))
    return part("hierarchy").unionByName(part("sibling"))


@query(sql("recall_docs", "SELECT project, approved, count(*) AS n FROM recall_docs WHERE project IS NULL OR lower(project) IN ('src1', 'src2') GROUP BY ALL"))
def eligibility_filter(spark, d):
    docs = recall_docs(spark, d)
    policy = P.derive_policy("where is the parser", workset=["src1", "SRC2"])
    return docs.where(P.eligibility(F.col("project"), F.col("approved"), policy)).groupBy("project", "approved").agg(F.count("*").alias("n"))


def _exact(spark, d) -> DataFrame:
    """Literal matches of a few terms, as (uri, term)."""
    docs = recall_docs(spark, d)
    return R.grep(docs, ["license", "token", "und der", "src1"], 1_000_000).select("uri", "term").distinct()


_EXACT = """matches AS (SELECT DISTINCT uri, term FROM recall_docs, (VALUES ('license'), ('token'), ('und der'), ('src1')) v(term) WHERE contains(lower(text), term) AND len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), term))) > 0),
  ef AS (SELECT term, count(DISTINCT uri) AS frequency FROM matches GROUP BY term),
  strength AS (SELECT uri, round(sum((CASE WHEN contains('-' || regexp_replace(lower(split_part(regexp_replace(split_part(uri, '#', 1), '\\.[a-z0-9]+$', '', 'i'), '/', -1)), '[^a-z0-9]+', '-', 'g') || '-', '-' || regexp_replace(term, '[^a-z0-9]+', '-', 'g') || '-') THEN 4 ELSE 1 END) / frequency::DOUBLE), 9) AS strength FROM matches JOIN ef USING (term) GROUP BY uri)"""


@query(sql("recall_docs", f"WITH {_EXACT} SELECT uri, round(strength, 6) AS strength FROM strength"))
def exact_match_strength(spark, d):
    return R.exact_strength(_exact(spark, d)).select("uri", F.round(F.round("strength", 9), 6).alias("strength"))


@query(sql("recall_docs", f"""WITH {_EXACT}, hits AS (SELECT uri, round((doc_id % 97) / 97.0::DOUBLE, 6) AS score, CASE WHEN doc_id % 4 = 0 THEN 'memories' ELSE 'resources' END AS category FROM recall_docs),
  j AS (SELECT h.uri, score, category, coalesce(round(strength, 9), 0.0) AS strength FROM hits h LEFT JOIN strength s ON h.uri = s.uri)
SELECT uri, category, score, round(strength, 6) AS strength, row_number() OVER (ORDER BY CASE category WHEN 'memories' THEN 0 ELSE 1 END, strength DESC, score DESC, uri) AS position FROM j"""))
def exact_boost_order(spark, d):
    hits = recall_docs(spark, d).select("uri", F.round((F.col("doc_id") % 97) / 97.0, 6).alias("score"), F.when(F.col("doc_id") % 4 == 0, "memories").otherwise("resources").alias("category"))
    return R.exact_boost(hits, _exact(spark, d)).select("uri", "category", "score", F.round("strength", 6).alias("strength"), "position")


def _hits(spark, d) -> DataFrame:
    docs = recall_docs(spark, d)
    return docs.select((F.col("doc_id") % 20).alias("query_id"), "uri", F.when(F.col("doc_id") % 3 == 0, "memories").when(F.col("doc_id") % 3 == 1, "resources").otherwise("skills").alias("category"), F.round(((F.col("doc_id") * 31) % 1009) / 1009.0, 6).alias("score"), X.snippet(F.col("text"), 40).alias("snippet"))


_HITS = r"""hits AS (SELECT doc_id % 20 AS query_id, uri, CASE doc_id % 3 WHEN 0 THEN 'memories' WHEN 1 THEN 'resources' ELSE 'skills' END AS category, round(((doc_id * 31) % 1009) / 1009.0::DOUBLE, 6) AS score, CASE WHEN length(flat) > 40 THEN rtrim(substring(flat, 1, 40)) || '…' ELSE flat END AS snippet FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM recall_docs))"""


@query(sql("recall_docs", f"WITH {_HITS} SELECT uri, category, score FROM (SELECT *, row_number() OVER (PARTITION BY category, snippet ORDER BY score DESC, uri) AS r FROM hits) WHERE category = 'memories' OR r = 1 OR snippet = ''"))
def content_dedupe(spark, d):
    return R.dedupe_content(_hits(spark, d)).select("uri", "category", "score")


@query(sql("recall_docs", f"""WITH {_HITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS position FROM hits),
  c AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY position) AS k, CASE category WHEN 'memories' THEN 1 WHEN 'resources' THEN 2 ELSE 3 END AS o FROM ranked),
  s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k <= 2 THEN 0 ELSE 1 END, CASE WHEN k <= 2 THEN o END, CASE WHEN k <= 2 THEN k END, position) AS slot FROM c)
SELECT query_id, uri, category, position FROM s WHERE slot <= 8"""))
def category_reserve(spark, d):
    ranked = _hits(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uri")).cast("long"))
    return R.category_reserve(ranked, 8).select("query_id", "uri", "category", "position")


@query(sql("recall_docs", f"WITH {_HITS}, p AS (SELECT uri, score FROM hits UNION ALL SELECT uri || '#c', round(1 - score, 6) FROM hits WHERE query_id < 10) SELECT split_part(uri, '#', 1) AS document, uri, score FROM p QUALIFY row_number() OVER (PARTITION BY split_part(uri, '#', 1) ORDER BY score DESC, uri) = 1"))
def merge_hits_best(spark, d):
    h = _hits(spark, d)
    other = h.where("query_id < 10").select(F.concat("uri", F.lit("#c")).alias("uri"), F.round(1 - F.col("score"), 6).alias("score"))
    return R.merge_hits([h.select("uri", "score"), other]).select("document", "uri", "score")


@query(sql("recall_docs", "SELECT title AS identity, count(DISTINCT logical_key) AS contents FROM recall_docs GROUP BY title HAVING count(DISTINCT logical_key) > 1"))
def identity_conflicts(spark, d):
    return R.identity_conflicts(recall_docs(spark, d).withColumnRenamed("title", "identity"), "identity", "logical_key")


@query(sql("recall_docs", f"WITH {_HITS} SELECT query_id, uri, CAST(spent AS BIGINT) AS spent FROM (SELECT *, sum(length(snippet)) OVER (PARTITION BY query_id ORDER BY score DESC, uri ROWS UNBOUNDED PRECEDING) AS spent FROM hits) WHERE spent <= 300"))
def budget_page(spark, d):
    return R.budget_prefix(_hits(spark, d), F.length("snippet"), F.lit(300), ["query_id"], [F.desc("score"), "uri"]).select("query_id", "uri", F.col("spent").cast("long").alias("spent"))


@query(sql("recall_docs", "SELECT project, workspace_scope, doc_id FROM recall_docs WHERE (project, workspace_scope, doc_id) > ('src12', 'en', 40) ORDER BY 1, 2, 3 LIMIT 50"))
def keyset_page(spark, d):
    return R.keyset_page(recall_docs(spark, d).select("project", "workspace_scope", "doc_id"), ["project", "workspace_scope", "doc_id"], ("src12", "en", 40), 50)


@query(sql("vectors", """WITH n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vectors),
  s AS (SELECT q.vec_id AS query_id, n.vec_id, round(greatest(-1.0, least(1.0, list_dot_product(n.v, q.v))), 5) AS score FROM n, n AS q WHERE q.vec_id % 20 = 0 AND n.vec_id <> q.vec_id)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10"""))
def vector_topk(spark, d):
    """Exact: cells that the nearest ones do not rule out are read too."""
    index, q = _vector_index(spark, d)
    return V.search(index, q, 10, exact=True, same_id=False, digits=5)


def _vector_index(spark, d):
    """The index of a folder's embeddings, kept in the shared folder, and the queries: every 20th vector."""
    v = vectors(spark, d)
    return V.opened(v.select("vec_id", "v"), f"{T.shared_dir(spark)}/vector-index/{hashlib.md5(d.encode()).hexdigest()}"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")


@query()
def vector_index_topk(spark, d):
    """By the probed cells alone; tests measure its recall against vector_topk."""
    index, q = _vector_index(spark, d)
    return V.search(index, q, 10, same_id=False, digits=5)


@query(sql("recall_docs", "SELECT term, uri, line FROM (SELECT term, uri, line, row_number() OVER (PARTITION BY term ORDER BY uri, line) AS r FROM (SELECT uri, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM recall_docs), (VALUES ('license'), ('TOKEN')) v(term) WHERE contains(lower(content), lower(term))) WHERE r <= 25"))
def grep_terms(spark, d):
    return R.grep(recall_docs(spark, d), ["license", "TOKEN"], 25).select("term", "uri", F.col("line").cast("long").alias("line"))


@query(r"SELECT url, page_id FROM pages WHERE regexp_matches(url, '^https?://[^/]*/en/[^/]*$')")
def glob_paths(spark, d):
    p = read(spark, d, "pages")
    return R.glob_filter(p, "http://*/en/*", "url").unionByName(R.glob_filter(p, "https://*/en/*", "url")).select("url", "page_id")


@query("""WITH cur AS (SELECT doc_id, n_chars, source FROM documents WHERE doc_id % 9 <> 0), old AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, source FROM documents WHERE doc_id % 5 <> 0)
SELECT c.doc_id AS uri, CASE WHEN o.doc_id IS NULL THEN 'added' ELSE 'changed' END AS change FROM cur c LEFT JOIN old o ON c.doc_id = o.doc_id WHERE o.doc_id IS NULL OR c.n_chars IS DISTINCT FROM o.n_chars OR c.source IS DISTINCT FROM o.source
UNION ALL SELECT doc_id, 'removed' FROM old WHERE doc_id NOT IN (SELECT doc_id FROM cur)""")
def source_changes(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("uri"), "n_chars", "source")
    old = docs.where("uri % 5 <> 0").withColumn("n_chars", F.when(F.col("uri") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return R.source_changes(docs.where("uri % 9 <> 0"), old, ["n_chars", "source"])


@query(sql("recall_docs", f"""WITH {_HITS}, ranked AS (SELECT query_id, uri, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS position FROM hits),
  rel AS (SELECT doc_id % 20 AS query_id, uri, CASE WHEN doc_id % 13 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS grade FROM recall_docs),
  ideal AS (SELECT query_id, sum(CASE WHEN r <= 5 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS ideal, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, uri) AS r FROM rel WHERE grade > 0) GROUP BY query_id),
  got AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(position + 1)) AS dcg, min(position) AS f, count(*) AS found FROM ranked JOIN rel USING (query_id, uri) WHERE grade > 0 AND position <= 5 GROUP BY query_id)
SELECT query_id, round(coalesce(dcg / ideal, 0.0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / f, 0.0), 6) AS reciprocal_rank, round(coalesce(found, 0) / relevant::DOUBLE, 6) AS recall FROM ideal LEFT JOIN got USING (query_id)"""))
def ndcg_metrics(spark, d):
    h = _hits(spark, d)
    ranked = h.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uri")))
    rel = recall_docs(spark, d).select((F.col("doc_id") % 20).alias("query_id"), "uri", F.when(F.col("doc_id") % 13 == 0, 2).when(F.col("doc_id") % 7 == 0, 1).otherwise(0).alias("grade"))
    return R.retrieval_metrics(ranked, rel)


@query(sql("recall_docs", "SELECT r.position, r.uri, d.project FROM (SELECT 'mem://src' || (i % 23) || '/' || (i * 7) AS uri, i AS position FROM range(0, 200) t(i)) r LEFT JOIN recall_docs d ON r.uri = d.uri"))
def requested_order_join(spark, d):
    wanted = spark.range(200).select(F.concat(F.lit("mem://src"), (F.col("id") % 23).cast("string"), F.lit("/"), (F.col("id") * 7).cast("string")).alias("uri"), F.col("id").alias("position"))
    return R.requested_order(wanted, recall_docs(spark, d).select("uri", "project"), "uri").select("position", "uri", "project")


@query("""WITH links AS (SELECT l_orderkey % 500 AS document_id, l_partkey % 50 AS selector_digest, CAST(l_linenumber AS BIGINT) AS citation_ordinal FROM lineitem), sel AS (SELECT i AS selector_digest, i % 4 AS match_rank, i % 3 AS anchor_ordinal, 'a' || i AS anchor_id FROM range(0, 30) t(i))
SELECT DISTINCT document_id, selector_digest, citation_ordinal, match_rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY match_rank, citation_ordinal, anchor_ordinal, anchor_id, selector_digest) AS r FROM links JOIN sel USING (selector_digest)) WHERE r = 1""")
def code_link_best(spark, d):
    links = read(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("document_id"), F.lit("symbol").alias("selector_kind"), (F.col("l_partkey") % 50).alias("selector_digest"), F.col("l_linenumber").cast("long").alias("citation_ordinal"))
    sel = spark.range(30).select(F.lit("symbol").alias("selector_kind"), F.col("id").alias("selector_digest"), (F.col("id") % 4).alias("match_rank"), (F.col("id") % 3).alias("anchor_ordinal"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("anchor_id"))
    return R.code_link_best(links, sel).select("document_id", "selector_digest", "citation_ordinal", "match_rank")


@query()
def markdown_chunks(spark, d):
    from ..sources.readers import chunk_documents

    return chunk_documents(recall_docs(spark, d)).select("uri", "ordinal", "start", F.length("chunk").alias("n"))
