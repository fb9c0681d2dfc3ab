"""Graph reads over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import graph
from lodestrata.session import table


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_entities")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.all_edges(_entities(spark, d), table(spark, d, "imports"))


def find_callers(spark: SparkSession, d: str) -> DataFrame:
    entities = _entities(spark, d)
    known = graph.nodes(entities).select("project", F.col("qn").alias("src"), "name", "file_path", "start_line")
    return graph.call_edges(entities).join(known, ["project", "src"]).select("project", F.col("dst").alias("function"), F.col("src").alias("caller"), "name", "file_path", "start_line")


def find_callees(spark: SparkSession, d: str) -> DataFrame:
    entities = _entities(spark, d)
    known = graph.nodes(entities).select("project", F.col("qn").alias("dst"), "name", "file_path", "start_line")
    return graph.call_edges(entities).join(known, ["project", "dst"]).select("project", F.col("src").alias("function"), F.col("dst").alias("callee"), "name", "file_path", "start_line")


def transitive_callers_k3(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitive(graph.call_edges(_entities(spark, d)), 3).select("project", F.col("reached").alias("target"), F.col("origin").alias("caller"), "depth")


def transitive_callees_k3(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitive(graph.call_edges(_entities(spark, d)), 3).select("project", F.col("origin").alias("source"), F.col("reached").alias("callee"), "depth")


def all_paths_k3(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths_between(graph.call_edges(_entities(spark, d)), 3)


def all_paths_k5(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths_between(graph.call_edges(_entities(spark, d)), 5)


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """The shortest chain of at most ten calls between any two entities."""
    return graph.shortest_paths(graph.call_edges(_entities(spark, d)), 10)


def full_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return graph.hierarchy_lines(graph.extends_edges(_entities(spark, d)), 5)


def class_hierarchy_chain(spark: SparkSession, d: str) -> DataFrame:
    entities = _entities(spark, d)
    chains = graph.trails(graph.extends_edges(entities), 5).select("project", F.col("origin").alias("class"), F.array_join("path", ">").alias("chain"))
    alone = graph.nodes(entities).where(F.col("label").isin("Class", "Interface")).select("project", F.col("qn").alias("class"), F.col("qn").alias("chain"))
    return alone.unionByName(chains)


def related_entities_d2(spark: SparkSession, d: str) -> DataFrame:
    """What lies within two edges of any kind of each entity whose id is divisible by 50."""
    asked = graph.nodes(_entities(spark, d)).where("entity_id % 50 = 0").select("project", "qn")
    return graph.related(_edges(spark, d), asked, 2)


def file_entities(spark: SparkSession, d: str) -> DataFrame:
    entities = _entities(spark, d)
    known = graph.nodes(entities).select("project", F.col("qn").alias("dst"), "name", "label", "start_line", "end_line")
    defined = graph.defines_edges(entities).where("kind = 'DEFINES'")
    return defined.join(known, ["project", "dst"]).select("project", F.col("src").alias("file_path"), F.col("dst").alias("qn"), "name", "label", "start_line", "end_line")


def file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "imports").dropDuplicates(["import_id"])
    return rows.select("project_name", "file_path", "name", "alias", "source", "is_external", "line_number")


def file_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_context(_entities(spark, d), table(spark, d, "imports"))


def implementation_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.implementation_context(_entities(spark, d))


def class_with_methods(spark: SparkSession, d: str) -> DataFrame:
    return graph.class_with_methods(_entities(spark, d))


def usage_patterns(spark: SparkSession, d: str) -> DataFrame:
    return graph.usage_patterns(_entities(spark, d))


def module_dependencies_theta(spark: SparkSession, d: str) -> DataFrame:
    return graph.module_dependencies(_entities(spark, d), table(spark, d, "imports"))


def entity_exact(spark: SparkSession, d: str) -> DataFrame:
    """Entities that an import names, by name or qualified name."""
    known = graph.nodes(_entities(spark, d))
    wanted = table(spark, d, "imports").select(F.col("project_name").alias("project"), F.col("name").alias("word")).distinct()
    keys = known.select("project", "qn", "label", F.explode(F.array_distinct(F.array("name", "qn"))).alias("word"))
    return wanted.join(keys, ["project", "word"]).select("project", "word", "qn", "label").distinct()


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Names that files import, and the words of the fields of metadata."""
    fields = table(spark, d, "metadata_generation_log").select(F.explode(F.split("field_name", "_")).alias("word"))
    return table(spark, d, "imports").select(F.col("name").alias("word")).unionByName(fields).distinct()


def entity_fuzzy_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best entities for each imported name and each word of a metadata field."""
    ranked = graph.name_search(_entities(spark, d), _words(spark, d))
    place = F.row_number().over(Window.partitionBy("word").orderBy("match_score", "name", "qn"))
    return ranked.withColumn("place", place).where("place <= 10").select("word", "qn", "match_score", "place")


def search_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty entities by qualified name for each of the words."""
    found = graph.search_by_name(_entities(spark, d), _words(spark, d))
    place = F.row_number().over(Window.partitionBy("word").orderBy("qn", "project"))
    return found.withColumn("place", place).where("place <= 20").select("word", "project", "qn", "label", "place")


def entity_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.centrality(_edges(spark, d))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    known = graph.nodes(_entities(spark, d))
    files = table(spark, d, "files").agg(F.count_distinct("path").alias("files"))
    counts = known.agg(*[F.count_if(F.col("label") == label).alias(f"{label.lower()}_count") for label in ("Class", "Function", "Method")])
    return files.crossJoin(counts)


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_entities(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


def edge_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


NAMES = (
    "find_callers find_callees transitive_callers_k3 transitive_callees_k3 all_paths_k3 all_paths_k5 shortest_path full_hierarchy class_hierarchy_chain related_entities_d2 file_entities file_dependencies "
    "file_context implementation_context class_with_methods usage_patterns module_dependencies_theta entity_exact entity_fuzzy_rank search_by_name entity_centrality graph_stats label_counts edge_type_counts"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

GRAPH = """
WITH RECURSIVE nodes AS (
  SELECT DISTINCT entity_id, project_name AS project, qualified_name AS qn, name, upper(type[1]) || type[2:] AS label, file_path, start_line, end_line FROM code_entities
), calls AS (
  SELECT DISTINCT c.project, c.src, c.dst FROM (SELECT project_name AS project, qualified_name AS src, unnest(calls) AS dst FROM code_entities) c
  JOIN nodes n ON n.project = c.project AND n.qn = c.dst
), extends AS (
  SELECT project, src, dst, min(ord) AS ord FROM (
    SELECT project, src, ord, CASE WHEN contains(base, '.') THEN base ELSE regexp_replace(src, '[^.]*$', '') || base END AS dst FROM (
      SELECT DISTINCT project_name AS project, qualified_name AS src, unnest(base_classes) AS base, generate_subscripts(base_classes, 1) - 1 AS ord
      FROM code_entities WHERE type IN ('class', 'interface'))
  ) e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.project = e.project AND n.qn = e.dst AND n.label IN ('Class', 'Interface')) GROUP BY 1, 2, 3
), defines AS (
  SELECT project, file_path AS src, qn AS dst, 'DEFINES' AS kind FROM nodes WHERE label <> 'Method'
  UNION ALL SELECT m.project, c.qn, m.qn, 'DEFINES_METHOD' FROM nodes m JOIN nodes c ON c.project = m.project AND c.qn = regexp_replace(m.qn, '\\.[^.]*$', '')
    AND c.label IN ('Class', 'Interface') WHERE m.label = 'Method'
), imported AS (
  SELECT DISTINCT project_name AS project, file_path AS src, coalesce(nullif(source, ''), name) AS dst FROM imports
), edges AS (
  SELECT project, src, dst, 'CALLS' AS kind FROM calls UNION ALL SELECT project, src, dst, 'EXTENDS' FROM extends
  UNION ALL SELECT project, src, dst, kind FROM defines UNION ALL SELECT project, src, dst, 'IMPORTS' FROM imported
)
"""


def _trails(edges: str, hops: int) -> str:
    return (
        GRAPH
        + f""", trails AS (
  SELECT project, src AS origin, dst AS reached, 1 AS depth, [src, dst] AS path, [src || chr(1) || dst] AS used FROM {edges}
  UNION ALL SELECT t.project, t.origin, e.dst, t.depth + 1, list_append(t.path, e.dst), list_append(t.used, e.src || chr(1) || e.dst)
  FROM trails t JOIN {edges} e ON e.project = t.project AND e.src = t.reached WHERE t.depth < {hops} AND NOT list_contains(t.used, e.src || chr(1) || e.dst)
)
"""
    )


_BOTH = """, linked AS (SELECT project, src, dst FROM edges WHERE src <> dst UNION SELECT project, dst, src FROM edges WHERE src <> dst)
"""
_WORDS = ", words AS (SELECT DISTINCT word FROM (SELECT name AS word FROM imports UNION SELECT unnest(string_split(field_name, '_')) FROM metadata_generation_log) WHERE word <> '')\n"
ORACLE = {
    "find_callers": GRAPH + "SELECT c.project, c.dst AS function, c.src AS caller, n.name, n.file_path, n.start_line FROM calls c JOIN nodes n ON n.project = c.project AND n.qn = c.src",
    "find_callees": GRAPH + "SELECT c.project, c.src AS function, c.dst AS callee, n.name, n.file_path, n.start_line FROM calls c JOIN nodes n ON n.project = c.project AND n.qn = c.dst",
    "transitive_callers_k3": _trails("calls", 3) + "SELECT DISTINCT project, reached AS target, origin AS caller, depth FROM trails WHERE origin <> reached",
    "transitive_callees_k3": _trails("calls", 3) + "SELECT DISTINCT project, origin AS source, reached AS callee, depth FROM trails WHERE origin <> reached",
    "all_paths_k3": _trails("calls", 3)
    + "SELECT * FROM (SELECT project, origin, reached, depth, array_to_string(path, '>') AS route, row_number() OVER (PARTITION BY project, origin, reached ORDER BY depth, array_to_string(path, '>')) AS place FROM trails WHERE origin <> reached) WHERE place <= 10",
    "all_paths_k5": _trails("calls", 5)
    + "SELECT * FROM (SELECT project, origin, reached, depth, array_to_string(path, '>') AS route, row_number() OVER (PARTITION BY project, origin, reached ORDER BY depth, array_to_string(path, '>')) AS place FROM trails WHERE origin <> reached) WHERE place <= 10",
    "shortest_path": _trails("calls", 10)
    + "SELECT project, origin, reached, depth, route FROM (SELECT project, origin, reached, depth, array_to_string(path, '>') AS route, row_number() OVER (PARTITION BY project, origin, reached ORDER BY depth, array_to_string(path, '>')) AS place FROM trails WHERE origin <> reached) WHERE place = 1",
    "full_hierarchy": _trails("extends", 5)
    + ", pairs AS (SELECT project, origin, reached, min(depth) AS depth FROM trails WHERE origin <> reached GROUP BY 1, 2, 3) SELECT project, origin AS class, reached AS other, depth, 'ancestor' AS direction FROM pairs UNION ALL SELECT project, reached, origin, depth, 'descendant' FROM pairs",
    "class_hierarchy_chain": _trails("extends", 5)
    + "SELECT project, qn AS class, qn AS chain FROM nodes WHERE label IN ('Class', 'Interface') UNION ALL SELECT project, origin, array_to_string(path, '>') FROM trails",
    "related_entities_d2": GRAPH
    + _BOTH
    + """, asked AS (SELECT project, qn FROM nodes WHERE entity_id % 50 = 0), near AS (SELECT a.project, a.qn AS origin, l.dst AS reached FROM asked a JOIN linked l ON l.project = a.project AND l.src = a.qn)
SELECT project, origin, reached, min(distance)::INT AS distance FROM (SELECT *, 1 AS distance FROM near UNION ALL SELECT n.project, n.origin, l.dst, 2 FROM near n JOIN linked l ON l.project = n.project AND l.src = n.reached WHERE l.dst <> n.origin) GROUP BY 1, 2, 3""",
    "file_entities": GRAPH + "SELECT project, file_path, qn, name, label, start_line, end_line FROM nodes WHERE label <> 'Method'",
    "file_dependencies": "SELECT project_name, file_path, name, alias, source, is_external, line_number FROM (SELECT DISTINCT import_id, project_name, file_path, name, alias, source, is_external, line_number FROM imports)",
    "file_context": GRAPH
    + """, across AS (SELECT c.project, c.src, c.dst, a.file_path AS from_file, b.file_path AS to_file FROM calls c JOIN nodes a ON a.project = c.project AND a.qn = c.src JOIN nodes b ON b.project = c.project AND b.qn = c.dst WHERE a.file_path <> b.file_path)
SELECT d.project, d.file_path, d.entities, coalesce(i.n, 0) AS imports, coalesce(o.n, 0) AS called, coalesce(w.n, 0) AS callers FROM (SELECT project, file_path, count(*) AS entities FROM nodes GROUP BY 1, 2) d
LEFT JOIN (SELECT project, src, count(*) AS n FROM imported GROUP BY 1, 2) i ON i.project = d.project AND i.src = d.file_path
LEFT JOIN (SELECT project, from_file, count(DISTINCT dst) AS n FROM across GROUP BY 1, 2) o ON o.project = d.project AND o.from_file = d.file_path
LEFT JOIN (SELECT project, to_file, count(DISTINCT src) AS n FROM across GROUP BY 1, 2) w ON w.project = d.project AND w.to_file = d.file_path""",
    "implementation_context": GRAPH
    + """, f AS (SELECT project, qn, file_path FROM nodes WHERE label IN ('Function', 'Method')), near AS (SELECT project, file_path, list_sort(list(qn)) AS names FROM f GROUP BY 1, 2)
SELECT f.project, f.qn, coalesce(array_to_string(a.names[1:10], '|'), '') AS callers, coalesce(array_to_string(b.names[1:10], '|'), '') AS callees,
  array_to_string(list_filter(near.names, lambda x: x <> f.qn)[1:10], '|') AS siblings
FROM f JOIN near ON near.project = f.project AND near.file_path = f.file_path
LEFT JOIN (SELECT project, dst, list_sort(list(src)) AS names FROM calls GROUP BY 1, 2) a ON a.project = f.project AND a.dst = f.qn
LEFT JOIN (SELECT project, src, list_sort(list(dst)) AS names FROM calls GROUP BY 1, 2) b ON b.project = f.project AND b.src = f.qn""",
    "class_with_methods": GRAPH
    + "SELECT c.project, c.qn, count(m.qn)::INT AS methods, coalesce(string_agg(m.name, ',' ORDER BY m.start_line, m.name), '') AS names FROM nodes c LEFT JOIN nodes m ON m.project = c.project AND m.label = 'Method' AND regexp_replace(m.qn, '\\.[^.]*$', '') = c.qn WHERE c.label IN ('Class', 'Interface') GROUP BY 1, 2",
    "usage_patterns": GRAPH
    + ", near AS (SELECT project, src, list_sort(list(dst)) AS names FROM calls GROUP BY 1, 2) SELECT c.project, c.dst, c.src, array_to_string(list_filter(n.names, lambda x: x <> c.dst)[1:5], '|') AS also_calls FROM calls c JOIN near n ON n.project = c.project AND n.src = c.src",
    "module_dependencies_theta": GRAPH
    + ", wanted AS (SELECT DISTINCT project_name AS project, file_path, name FROM imports) SELECT w.project, w.file_path, w.name AS import_name, count(n.qn) AS entities FROM wanted w LEFT JOIN nodes n ON n.project = w.project AND (n.name = w.name OR contains(n.qn, w.name)) GROUP BY 1, 2, 3",
    "entity_exact": GRAPH + "SELECT DISTINCT n.project, i.name AS word, n.qn, n.label FROM nodes n JOIN imports i ON i.project_name = n.project AND (n.name = i.name OR n.qn = i.name)",
    "entity_fuzzy_rank": GRAPH
    + _WORDS
    + """SELECT word, qn, match_score, place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY match_score, name, qn) AS place FROM (
  SELECT w.word, n.qn, n.name, CASE WHEN n.name = w.word THEN 0 WHEN n.qn = w.word THEN 1 WHEN lower(n.name) = lower(w.word) THEN 2 WHEN starts_with(n.name, w.word) THEN 3 WHEN ends_with(n.name, w.word) THEN 4 WHEN contains(n.name, w.word) THEN 5 ELSE 6 END AS match_score
  FROM words w JOIN nodes n ON contains(lower(n.qn), lower(w.word)) OR contains(lower(n.name), lower(w.word)))) WHERE place <= 10""",
    "search_by_name": GRAPH
    + _WORDS
    + "SELECT word, project, qn, label, place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY qn, project) AS place FROM (SELECT w.word, n.project, n.qn, n.label FROM words w JOIN nodes n ON contains(n.qn, w.word) OR contains(n.name, w.word))) WHERE place <= 20",
    "entity_centrality": GRAPH
    + """SELECT project, qn, count(*) FILTER (kind = 'CALLS' AND into_ = 1) AS in_degree, count(*) FILTER (kind = 'CALLS' AND into_ = 0) AS out_degree, count(*) FILTER (kind = 'CALLS') AS total_degree,
count(*) FILTER (NOT (into_ = 1 AND src = dst)) AS relationship_count FROM (SELECT project, src AS qn, kind, 0 AS into_, src, dst FROM edges UNION ALL SELECT project, dst, kind, 1, src, dst FROM edges) GROUP BY 1, 2""",
    "graph_stats": GRAPH
    + "SELECT (SELECT count(DISTINCT path) FROM files) AS files, count(*) FILTER (label = 'Class') AS class_count, count(*) FILTER (label = 'Function') AS function_count, count(*) FILTER (label = 'Method') AS method_count FROM nodes",
    "label_counts": GRAPH + "SELECT label, count(*) AS n FROM nodes GROUP BY 1",
    "edge_type_counts": GRAPH + "SELECT kind, count(*) AS n FROM edges GROUP BY 1",
}
