"""Queries of the general problems (hierarchies, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import hierarchy, references
from lodestrata.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = hierarchy.entity_parents(table(spark, sf_dir, "code_entities"))
    return hierarchy.resolve_hierarchy(links).select(F.col("id").alias("entity_id"), F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root as ids joined by '/', null on or below a loop."""
    links = hierarchy.entity_parents(table(spark, sf_dir, "code_entities"))
    found = hierarchy.resolve_hierarchy(links, with_path=True)
    return found.select(F.col("id").alias("entity_id"), F.concat_ws("/", F.col("path").cast("array<string>")).alias("joined"), "path").select(
        "entity_id", F.when(F.col("path").isNotNull(), F.col("joined")).alias("path")
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = hierarchy.entity_parents(table(spark, sf_dir, "code_entities"))
    return hierarchy.descendants(hierarchy.resolve_hierarchy(links, with_path=True))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.find_orphans(table(spark, sf_dir, "code_entities")).select("entity_id", "field", "target", "reason")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(table(spark, sf_dir, "code_entities"))


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p6_found": p6_found, "p6_report": p6_report}

_LINKS = """
WITH RECURSIVE e AS (
  SELECT entity_id AS id, any_value(project_name) AS project, any_value(qualified_name) AS name, any_value(type) AS type, any_value(base_classes) AS bases
  FROM code_entities WHERE type IN ('class', 'interface', 'method') GROUP BY entity_id
), wanted AS (
  SELECT id, project, place, CASE WHEN contains(base, '.') THEN base ELSE regexp_replace(name, '[^.]*$', '') || base END AS target
  FROM (SELECT id, project, name, unnest(bases) AS base, generate_subscripts(bases, 1) AS place FROM e WHERE type <> 'method') WHERE base <> ''
  UNION ALL
  SELECT id, project, 1, regexp_replace(name, '\\.[^.]*$', '') FROM e WHERE type = 'method' AND contains(name, '.')
), links AS (
  SELECT w.id, arg_min(o.id, w.place) AS parent
  FROM wanted w JOIN e o ON o.project = w.project AND o.name = w.target AND o.type <> 'method' GROUP BY w.id
), nodes AS (SELECT e.id, l.parent FROM e LEFT JOIN links l ON l.id = e.id),
tree AS (
  SELECT id, id AS root, 0::BIGINT AS depth, [id] AS path FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.id, t.root, t.depth + 1, list_append(t.path, n.id) FROM tree t JOIN nodes n ON n.parent = t.id
)
"""

_ORPHANS = """
WITH e AS (
  SELECT entity_id, any_value(project_name) AS project, any_value(qualified_name) AS name, any_value(calls) AS calls,
    any_value(base_classes) AS bases, any_value(indexed_at) AS indexed, any_value(deleted_at) AS deleted, min(ingested_at) AS arrived
  FROM code_entities GROUP BY entity_id
), refs AS (
  SELECT DISTINCT entity_id, project, indexed, arrived, field, target FROM (
    SELECT entity_id, project, indexed, arrived, 'calls' AS field, unnest(calls) AS target FROM e
    UNION ALL SELECT entity_id, project, indexed, arrived, 'base_classes', unnest(bases) FROM e
  ) WHERE starts_with(target, project || '.')
), judged AS (
  SELECT r.entity_id, r.field, r.target, r.indexed, CASE
    WHEN o.entity_id IS NULL THEN 'missing' WHEN o.deleted <= r.indexed THEN 'deleted' WHEN o.arrived > r.arrived THEN 'late' END AS reason
  FROM refs r LEFT JOIN e o ON o.project = r.project AND o.name = r.target
)
"""

ORACLE = {
    "p4_found": _LINKS + "SELECT n.id AS entity_id, coalesce(t.root, -1) AS root_id, coalesce(t.depth, -1) AS depth FROM nodes n LEFT JOIN tree t ON t.id = n.id",
    "p4_paths": _LINKS + "SELECT n.id AS entity_id, array_to_string(t.path, '/') AS path FROM nodes n LEFT JOIN tree t ON t.id = n.id",
    "p4_descendants": _LINKS
    + "SELECT * FROM (SELECT unnest(path) AS ancestor, id AS descendant, depth - generate_subscripts(path, 1) + 1 AS distance FROM tree) WHERE ancestor <> descendant",
    "p6_found": _ORPHANS + "SELECT entity_id, field, target, reason FROM judged WHERE reason IS NOT NULL",
    "p6_report": _ORPHANS + "SELECT field, strftime(indexed, '%Y-%m') AS month, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}
