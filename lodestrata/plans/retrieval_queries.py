"""Vector, ranking and planning queries over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import graph, retrieval
from lodestrata.session import table


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to the first one."""
    vectors = table(spark, d, "embeddings")
    query = vectors.orderBy("vec_id").select("embedding").first()
    return retrieval.vector_top(vectors, list(query.embedding))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    query = vectors.orderBy("vec_id").select("embedding", "label").first()
    return retrieval.vector_top(vectors, list(query.embedding), 10, F.col("label") == query.label)


def similar_code(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_top_of_queries(vectors, queries, 5)


def similar_same_label(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    return retrieval.vector_top_of_queries(vectors, queries, 5, "label")


def planner(spark: SparkSession, d: str) -> DataFrame:
    """Plans of all document texts, taken as questions."""
    docs = table(spark, d, "documents").where("text is not null")
    plan = retrieval.question_plan(F.col("text"))
    return docs.select("doc_id", *[plan[c].alias(c) for c in ("intent", "search_type", "multi_hop", "max_hops")], F.array_join(plan["entities"], "|").alias("entities"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Each function itself, and its callers and callees within two steps, as evidence for the function, with degrees and texts."""
    entities = table(spark, d, "code_entities")
    known = graph.nodes(entities).select("project", "qn", "name", "file_path", "docstring", "signature", "start_line")
    texts = entities.select(F.col("project_name").alias("project"), F.col("qualified_name").alias("qn"), "code").groupBy("project", "qn").agg(F.min("code").alias("code"))
    calls = graph.call_edges(entities)
    near = graph.transitive(calls, 2).groupBy("project", "origin", "reached").agg(F.min("depth").alias("depth"))
    rows = (
        known.where("name is not null").select("project", F.col("qn").alias("about"), F.col("qn").alias("qn"), F.lit("primary").alias("bucket"), F.lit(0).alias("depth"))
        .unionByName(near.select("project", F.col("reached").alias("about"), F.col("origin").alias("qn"), F.lit("caller").alias("bucket"), "depth"))
        .unionByName(near.select("project", F.col("origin").alias("about"), F.col("reached").alias("qn"), F.lit("callee").alias("bucket"), "depth"))
    )
    degrees = graph.centrality(calls).select("project", "qn", "total_degree")
    joined = rows.join(known, ["project", "qn"]).join(degrees, ["project", "qn"], "left").join(texts, ["project", "qn"], "left")
    match = F.when(F.col("bucket") == "primary", 1.0).otherwise(0.0)
    intent = F.when(F.col("bucket") == "caller", "find_callers").when(F.col("bucket") == "callee", "find_callees").otherwise("locate_entity")
    score = retrieval.graph_score(intent, F.col("bucket"), F.col("depth"), match, F.col("total_degree"), F.lit(None), F.col("docstring"), F.col("signature"), F.col("code"))
    return joined.select("project", "about", "qn", "file_path", "bucket", "depth", score.alias("score"))


def score_graph(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("project", "about", "qn", "bucket", F.round("score", 6).alias("score"))


def score_vector(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the nearest vectors: a vector of the query's label is a match, and as central as it is near to queries; the label's number of vectors stands for the length of a content."""
    near = similar_code(spark, d)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    degrees = near.groupBy("vec_id").agg(F.count("*").alias("degree"))
    rows = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id").join(sizes, "label").join(degrees, "vec_id")
    match = F.when(F.col("label") == F.col("asked"), 1.0).otherwise(0.0)
    score = retrieval.vector_score(F.lit("search_functionality"), F.col("score"), match, F.col("degree"), F.col("n"))
    return rows.select("query_id", "vec_id", F.round(score, 5).alias("score"))


def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    """Evidence about each function merged by entity, five a file and fifty in all."""
    order = F.when(F.col("bucket") == "primary", 0).when(F.col("bucket") == "caller", 1).otherwise(2)
    rows = _scored(spark, d).withColumns({"ord": F.concat_ws(":", order, "depth", "qn"), "source": F.lit("graph")})
    merged = retrieval.merge_scores(rows, ["project", "about", "qn", "file_path"])
    merged = merged.withColumn("score", F.round("score", 9))
    capped = retrieval.cap_results(merged, ["project", "about"], "file_path")
    return capped.select("project", "about", "qn", "source", F.round("score", 6).alias("score"), "place")


def legacy_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Constant evidence of what a query is linked with by its label, and weighed similarity of what is near to it, added by query and vector."""
    linked = similar_same_label(spark, d).select("query_id", "vec_id", F.lit(0.4).alias("score"), F.lit("graph").alias("source"))
    near = similar_code(spark, d).select("query_id", "vec_id", (F.col("score") * 0.6).alias("score"), F.lit("vector").alias("source"))
    fused = linked.unionByName(near).groupBy("query_id", "vec_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"), F.min("source").alias("source"))
    return fused.select("query_id", "vec_id", F.round("score", 5).alias("score"), F.when(F.col("n") > 1, "hybrid").otherwise(F.col("source")).alias("source"))


def dedupe_per_file(spark: SparkSession, d: str) -> DataFrame:
    """The three longest entities of each file."""
    known = graph.nodes(table(spark, d, "code_entities")).withColumn("score", (F.col("end_line") - F.col("start_line")).cast("double")).withColumn("first_ord", F.col("qn"))
    return retrieval.cap_results(known, ["project", "file_path"], "file_path", 3, 3).select("project", "file_path", "qn", "place")


def minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return retrieval.min_max(rows, "value", "event_type").select("event_id", F.round("normalized", 6).alias("normalized"))


NAMES = "vector_topk vector_topk_filtered similar_code similar_same_label planner score_graph score_vector hybrid_rank legacy_fuse dedupe_per_file minmax_normalize".split()
QUERIES = {name: globals()[name] for name in NAMES}

_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"
_NEAR = (
    "near AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, "
    + _COS.format(a="q.embedding", b="v.embedding")
    + " AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY "
    + _COS.format(a="q.embedding", b="v.embedding")
    + " DESC, v.vec_id) AS place FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id {same} WHERE q.vec_id % 50 = 0) WHERE place <= 5)"
)
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in retrieval.INTENT_WORDS) + " ELSE 'search_functionality' END"
_HOPS = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in retrieval.HOP_WORDS) + ")"
_SCORED = """
WITH nodes AS (
  SELECT DISTINCT entity_id, project_name AS project, qualified_name AS qn, name, file_path, docstring, signature, code FROM code_entities
), calls AS (
  SELECT DISTINCT c.project, c.src, c.dst FROM (SELECT project_name AS project, qualified_name AS src, unnest(calls) AS dst FROM code_entities) c JOIN nodes n ON n.project = c.project AND n.qn = c.dst
), degrees AS (
  SELECT project, qn, count(*) AS total_degree FROM (SELECT project, src AS qn FROM calls UNION ALL SELECT project, dst FROM calls) GROUP BY 1, 2
), ways AS (
  SELECT project, src, dst, min(depth) AS depth FROM (SELECT project, src, dst, 1 AS depth FROM calls UNION ALL SELECT a.project, a.src, b.dst, 2 FROM calls a JOIN calls b ON b.project = a.project AND b.src = a.dst AND NOT (a.src = b.src AND a.dst = b.dst)) WHERE src <> dst GROUP BY 1, 2, 3
), evidence AS (
  SELECT project, qn AS about, qn, 'primary' AS bucket, 0 AS depth FROM nodes WHERE name IS NOT NULL
  UNION ALL SELECT project, dst, src, 'caller', depth FROM ways UNION ALL SELECT project, src, dst, 'callee', depth FROM ways
), scored AS (
  SELECT e.project, e.about, e.qn, n.file_path, e.bucket, e.depth,
    CASE e.bucket WHEN 'primary' THEN 0.6::DOUBLE + 0.3 + 0.15 WHEN 'caller' THEN greatest(0.3::DOUBLE, 1.0 - 0.2 * (e.depth - 1)) * 0.8 + 0.8 * 0.15 ELSE greatest(0.3::DOUBLE, 1.0 - 0.2 * (e.depth - 1)) * 0.8 + 0.7 * 0.15 END
    + least(1.0::DOUBLE, coalesce(g.total_degree, 0) / 50.0::DOUBLE) * 0.2
    + (CASE WHEN coalesce(n.docstring, '') <> '' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN coalesce(n.signature, '') <> '' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN coalesce(n.code, '') <> '' THEN 0.3::DOUBLE ELSE 0 END) * 0.1 AS score
  FROM evidence e JOIN nodes n ON n.project = e.project AND n.qn = e.qn LEFT JOIN degrees g ON g.project = e.project AND g.qn = e.qn
)
"""
ORACLE = {
    "vector_topk": "SELECT vec_id, label, score FROM (SELECT v.vec_id, v.label, " + _COS.format(a="v.embedding", b="q.embedding") + " AS score FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY score DESC, vec_id LIMIT 10",
    "vector_topk_filtered": "SELECT vec_id, label, score FROM (SELECT v.vec_id, v.label, " + _COS.format(a="v.embedding", b="q.embedding") + " AS score FROM embeddings v JOIN (SELECT embedding, label FROM embeddings ORDER BY vec_id LIMIT 1) q ON v.label = q.label) ORDER BY score DESC, vec_id LIMIT 10",
    "similar_code": "WITH " + _NEAR.format(same="") + " SELECT query_id, vec_id, score, place FROM near",
    "similar_same_label": "WITH " + _NEAR.format(same="AND v.label = q.label") + " SELECT query_id, vec_id, score, place FROM near",
    "planner": f"""SELECT doc_id, intent, CASE WHEN intent IN ('explain_implementation', 'search_functionality') THEN 'hybrid' WHEN intent = 'find_similar' THEN 'vector' ELSE 'graph' END AS search_type,
multi_hop, CASE WHEN multi_hop THEN 3 ELSE 1 END AS max_hops, entities FROM (SELECT doc_id, {_INTENT} AS intent, {_HOPS} AS multi_hop,
array_to_string(list_concat(list_concat(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1), regexp_extract_all(text, '\\b([a-z]+(?:_[a-z]+)+)\\b', 1)), regexp_extract_all(text, '`([^`]+)`', 1)), '|') AS entities
FROM documents WHERE text IS NOT NULL)""",
    "score_graph": _SCORED + "SELECT project, about, qn, bucket, round(score, 6) AS score FROM scored",
    "score_vector": "WITH " + _NEAR.format(same="")
    + """, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), degrees AS (SELECT vec_id, count(*) AS degree FROM near GROUP BY 1)
SELECT query_id, near.vec_id, round(score * 0.7::DOUBLE + 0.3 * CASE WHEN v.label = q.label THEN 1 ELSE 0 END + 0.2 * least(1.0::DOUBLE, degree / 50.0::DOUBLE) + 0.1 * CASE WHEN n > 100 AND n < 2000 THEN 0.8 WHEN n > 50 AND n < 3000 THEN 0.5 ELSE 0.3 END, 5) AS score
FROM near JOIN embeddings v ON v.vec_id = near.vec_id JOIN embeddings q ON q.vec_id = near.query_id JOIN sizes ON sizes.label = v.label JOIN degrees ON degrees.vec_id = near.vec_id""",
    "hybrid_rank": _SCORED
    + """, merged AS (
  SELECT project, about, qn, file_path, round(list_reduce(list(score ORDER BY CASE bucket WHEN 'primary' THEN 0 WHEN 'caller' THEN 1 ELSE 2 END, depth), lambda a, b: (a + b) / 2 * 1.1), 9) AS score,
    CASE WHEN count(*) > 1 THEN 'hybrid' ELSE 'graph' END AS source, min(CASE bucket WHEN 'primary' THEN '0' WHEN 'caller' THEN '1' ELSE '2' END || ':' || depth || ':' || qn) AS first_ord FROM scored GROUP BY 1, 2, 3, 4
), filed AS (SELECT *, row_number() OVER (PARTITION BY project, about, file_path ORDER BY score DESC, first_ord) AS in_file FROM merged)
SELECT project, about, qn, source, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY project, about ORDER BY score DESC, first_ord) AS place FROM filed WHERE in_file <= 5) WHERE place <= 50""",
    "legacy_fuse": "WITH " + _NEAR.format(same="") + ", " + _NEAR.format(same="AND v.label = q.label").replace("near AS", "linked AS", 1)
    + ", parts AS (SELECT query_id, vec_id, 0.4::DOUBLE AS score, 'graph' AS source FROM linked UNION ALL SELECT query_id, vec_id, score * 0.6, 'vector' FROM near) SELECT query_id, vec_id, round(sum(score), 5) AS score, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(source) END AS source FROM parts GROUP BY 1, 2",
    "dedupe_per_file": "SELECT project, file_path, qn, place FROM (SELECT project, file_path, qn, row_number() OVER (PARTITION BY project, file_path ORDER BY n DESC, qn) AS place FROM (SELECT DISTINCT entity_id, project_name AS project, file_path, qualified_name AS qn, end_line - start_line AS n FROM code_entities)) WHERE place <= 3",
    "minmax_normalize": "SELECT event_id, round(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (value - lo) / (hi - lo) END, 6) AS normalized FROM (SELECT event_id, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)",
}
