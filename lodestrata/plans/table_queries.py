"""Statistics, changes of tables and resolution over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import graph, resolve, tables
from lodestrata.plans.graph_queries import GRAPH
from lodestrata.session import table
from lodestrata.sources import extract

DAY = "2025-07-01"


def scan_statistics(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan_statistics(table(spark, d, "files"))


def content_hash_changed(spark: SparkSession, d: str) -> DataFrame:
    return tables.changed_files(table(spark, d, "files"))


def unchanged_semi(spark: SparkSession, d: str) -> DataFrame:
    """Rows delivered again whose path and hash an earlier delivery has."""
    rows = table(spark, d, "files").select("file_id", "path", "content_hash", "ingested_at")
    first = rows.groupBy("file_id").agg(F.min("ingested_at").alias("first"))
    both = rows.join(first, "file_id")
    old = both.where("ingested_at = first").select("path", "content_hash")
    return both.where("ingested_at > first").join(old, ["path", "content_hash"], "left_semi").select("file_id", "path", "content_hash")


def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities that arrived before a day, with those that arrived later put in by project and name."""
    rows = table(spark, d, "code_entities").select("entity_id", "project_name", "name", "start_line", "ingested_at")
    early, late = rows.where(F.col("ingested_at") < DAY), rows.where(F.col("ingested_at") >= DAY)
    order = [F.desc("ingested_at"), F.desc("entity_id")]
    base = tables.last_of(early, ["project_name", "name"], order)
    return tables.upsert(base, late, ["project_name", "name"], order).select("project_name", "name", "entity_id", "start_line")


def _gone(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose file's latest content is null or empty."""
    empty = table(spark, d, "files").where("content is null or content = ''").select(F.col("project_name").alias("project"), F.col("path").alias("file_path")).distinct()
    return graph.nodes(table(spark, d, "code_entities")).join(empty, ["project", "file_path"], "left_semi")


def delete_file_entities(spark: SparkSession, d: str) -> DataFrame:
    left = tables.delete_matching(graph.nodes(table(spark, d, "code_entities")), _gone(spark, d), ["project", "file_path"])
    return left.select("project", "qn", "label")


def delete_calls_for_file(spark: SparkSession, d: str) -> DataFrame:
    return tables.delete_edges(graph.call_edges(table(spark, d, "code_entities")), _gone(spark, d)).select("project", "src", "dst")


def delete_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Files left once everything below a squads folder is deleted."""
    rows = table(spark, d, "files").dropDuplicates(["file_id"])
    return rows.where(~F.startswith("path", F.concat(F.lit("/srv/repos/"), "project_name", F.lit("/squads/")))).select("file_id", "project_name", "path")


def metadata_upsert_version(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "metadata_generation_log").where("status = 'completed'").select(F.col("project_metadata_id").alias("id"))
    return tables.versioned_upsert(table(spark, d, "project_metadata").select("id", "version"), done, "id")


def generation_log_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metadata_generation_log").dropDuplicates(["id"])
    place = F.row_number().over(Window.partitionBy("project_metadata_id").orderBy(F.desc("created_at"), "id"))
    return rows.select("project_metadata_id", "id", "field_name", "status", place.alias("place"))


def generation_status(spark: SparkSession, d: str) -> DataFrame:
    """Per document: fields whose last attempt is done, and completed, partial or failed by their number."""
    rows = table(spark, d, "metadata_generation_log").dropDuplicates(["id"])
    last = tables.last_of(rows, ["project_metadata_id", "field_name"], [F.desc("created_at"), F.desc("id")])
    counts = last.groupBy("project_metadata_id").agg(F.count("*").alias("fields"), F.count_if(F.col("status") == "completed").alias("done"))
    status = F.when(F.col("done") == F.col("fields"), "completed").when(F.col("done") > 0, "partial").otherwise("failed")
    return counts.select("project_metadata_id", "fields", "done", status.alias("status"))


def metadata_documents(spark: SparkSession, d: str) -> DataFrame:
    """Typed parts of the JSON columns of each project's document."""
    rows = table(spark, d, "project_metadata")
    return rows.select(
        "project_name",
        F.array_join(F.from_json(F.get_json_object("tech_stack", "$.languages"), "array<string>"), ",").alias("languages"),
        F.get_json_object("entry_points", "$[0].path").alias("entry_point"),
        F.json_array_length("core_features").cast("long").alias("features"),
    )


def list_projects(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "project_metadata").select("project_name", "status")
    counts = table(spark, d, "files").groupBy("project_name").agg(F.count_distinct("path").alias("file_count"))
    return projects.join(counts, "project_name", "left").select("project_name", "status", F.coalesce("file_count", F.lit(0)).alias("file_count"))


def project_stats_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Entities below each project's folder, whose name is the third part of a path."""
    root = F.substring_index("file_path", "/", 4)
    counts = graph.nodes(table(spark, d, "code_entities")).groupBy(root.alias("root")).agg(
        F.count_distinct("file_path").alias("files"), *[F.count_if(F.col("label") == x).alias(x.lower()) for x in ("Class", "Function", "Method", "Interface")]
    )
    projects = table(spark, d, "project_metadata").select("project_name", F.concat(F.lit("/srv/repos/"), "project_name").alias("root"))
    return projects.join(counts, "root", "left").drop("root").na.fill(0)


def context_file_summaries(spark: SparkSession, d: str) -> DataFrame:
    known = graph.nodes(table(spark, d, "code_entities")).groupBy(F.col("project").alias("project_name"), F.col("file_path").alias("path")).agg(F.count("*").alias("entity_count"))
    rows = table(spark, d, "files").select("file_id", "project_name", "path", "language").dropDuplicates(["file_id"])
    n = F.coalesce("entity_count", F.lit(0))
    return rows.join(known, ["project_name", "path"], "left").select("file_id", n.alias("entity_count"), F.format_string("%s file with %d entities", F.coalesce("language", F.lit("unknown")), n).alias("summary"))


def call_chain_explanations(spark: SparkSession, d: str) -> DataFrame:
    chains = graph.trails(graph.call_edges(table(spark, d, "code_entities")), 3).where("depth = 3")
    names = F.transform("path", lambda x: F.substring_index(x, ".", -1))
    return chains.select("project", "origin", "reached", F.array_join(names, " → ").alias("explanation"))


def import_extract(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the script files import, in any form; a file's language is that of its path where the row has none."""
    found = extract.extract_script_imports(table(spark, d, "files")).select("file_id", "source", "line_number", "is_external").distinct()
    return found.select("file_id", "source", "is_external")


def module_qn(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files").dropDuplicates(["file_id"])
    return rows.select("file_id", resolve.module_qn(F.col("project_name"), F.col("path")).alias("module"))


def registry_simple_name(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(table(spark, d, "code_entities")).groupBy("project", F.substring_index("qn", ".", -1).alias("simple_name")).agg(F.count("*").alias("n"), F.min("qn").alias("first"))


def registry_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Entities below each dotted prefix, whole parts only."""
    parts = F.split("qn", r"\.")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")))
    return graph.nodes(table(spark, d, "code_entities")).select("project", prefix.alias("prefix")).groupBy("project", "prefix").agg(F.count("*").alias("n"))


def registry_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the last two parts of their names."""
    return graph.nodes(table(spark, d, "code_entities")).groupBy("project", F.substring_index("qn", ".", -2).alias("suffix")).agg(F.count("*").alias("n"))


def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "code_entities")
    return resolve.resolve_calls(entities, table(spark, d, "imports"), resolve.annotated_parameters(entities))


def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """What the imported names and the bare base classes of each file stand for by its imports."""
    bases = table(spark, d, "code_entities").select(F.col("project_name").alias("project"), "file_path", F.explode("base_classes").alias("name"))
    names = table(spark, d, "imports").select(F.col("project_name").alias("project"), "file_path", "name").unionByName(bases).where("name is not null").distinct()
    return resolve.resolve_name(names, table(spark, d, "imports"), table(spark, d, "code_entities"))


def module_distance(spark: SparkSession, d: str) -> DataFrame:
    calls = graph.call_edges(table(spark, d, "code_entities"))
    return calls.select("project", "src", "dst", resolve.module_distance(F.col("src"), F.col("dst")).alias("distance"))


def mro_bfs(spark: SparkSession, d: str) -> DataFrame:
    return resolve.ancestors(table(spark, d, "code_entities")).select("project", "class", "ancestor", "depth")


def subclasses(spark: SparkSession, d: str) -> DataFrame:
    """Descendants by every path: a diamond gives one twice."""
    return resolve.subclass_paths(table(spark, d, "code_entities"))


def inherited_methods(spark: SparkSession, d: str) -> DataFrame:
    return resolve.inherited_methods(table(spark, d, "code_entities"))


def inheritance_stats(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "code_entities")
    parents = graph.extends_edges(entities).groupBy("project", F.col("src").alias("qn")).agg(F.count("*").alias("n"))
    known = graph.nodes(entities).where(F.col("label").isin("Class", "Interface")).join(parents, ["project", "qn"], "left").na.fill(0, ["n"])
    return known.groupBy("project").agg(F.count("*").alias("classes"), F.count_if(F.col("n") > 0).alias("with_parents"), F.round(F.avg("n"), 6).alias("avg_parents"))


def import_map(spark: SparkSession, d: str) -> DataFrame:
    return resolve.import_map(table(spark, d, "imports"))


def param_type_match(spark: SparkSession, d: str) -> DataFrame:
    return resolve.parameter_types(table(spark, d, "code_entities"), table(spark, d, "imports"))


NAMES = (
    "import_map param_type_match scan_statistics content_hash_changed unchanged_semi upsert_nodes delete_file_entities delete_calls_for_file delete_by_prefix metadata_upsert_version generation_log_order generation_status "
    "metadata_documents list_projects project_stats_prefix context_file_summaries call_chain_explanations import_extract module_qn registry_simple_name registry_prefix registry_suffix "
    "resolve_calls resolve_names module_distance mro_bfs subclasses inherited_methods inheritance_stats"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_F = "WITH f AS (SELECT DISTINCT ON (file_id) * FROM files) "
_GONE = GRAPH + ", gone AS (SELECT n.project, n.qn, n.file_path FROM nodes n WHERE EXISTS (SELECT 1 FROM files f WHERE f.project_name = n.project AND f.path = n.file_path AND coalesce(f.content, '') = ''))\n"
_MODULE = "rtrim(project_name || '.' || regexp_replace(replace(regexp_replace(regexp_replace(path, '^/srv/repos/[^/]+/', ''), '\\.[^./]*$', ''), '/', '.'), '\\.?__init__$', ''), '.')"


#: Trails of any length; an edge occurs at most once in one, so they end.
_UP = (
    GRAPH
    + """, lines AS (
  SELECT project, src AS origin, dst AS reached, 1 AS depth, ord, [src || chr(1) || dst] AS used FROM extends
  UNION ALL SELECT l.project, l.origin, e.dst, l.depth + 1, l.ord, list_append(l.used, e.src || chr(1) || e.dst) FROM lines l JOIN extends e ON e.project = l.project AND e.src = l.reached
  WHERE NOT list_contains(l.used, e.src || chr(1) || e.dst)
)
"""
)


_COMMON = "len(list_filter(range(1, greatest(len(l), len(r)) + 1), lambda n: l[1:n] = r[1:n] AND n <= least(len(l), len(r))))"
_quoted = lambda words: ", ".join(f"'{x}'" for x in words)
_FILE_MODULE = _MODULE.replace("path,", "file_path,")
#: The import map, with `..` of a script's source only at its beginning.
_IMPORTS = f""", parted AS (
  SELECT *, string_split(module, '.') AS mp, list_filter(string_split(src, '/'), lambda x: x NOT IN ('', '.', '..')) AS downs, len(list_filter(string_split(src, '/'), lambda x: x = '..')) AS ups, length(regexp_extract(src, '^(\\.*)', 1)) AS dots
  FROM (SELECT project_name AS project, file_path, name, nullif(alias, '') AS alias, nullif(source, '') AS src, line_number, regexp_matches(file_path, '{resolve.SCRIPT_FILES}') AS script, {_FILE_MODULE} AS module FROM imports)
), based AS (
  SELECT *, CASE WHEN script THEN CASE WHEN starts_with(src, '.') THEN array_to_string(list_concat(mp[1:greatest(len(mp) - 1 - ups, 0)], downs), '.') ELSE replace(src, '/', '.') END
    WHEN dots > 0 THEN array_to_string(list_concat(list_concat([project], mp[2:len(mp) - dots]), list_filter(string_split(substr(src, dots + 1), '.'), lambda x: x <> '')), '.') ELSE src END AS base FROM parted
), mapped AS (
  SELECT project, file_path, local, struct_extract(max(ROW(line_number, target)), 2) AS target FROM (SELECT project, file_path, line_number,
    CASE WHEN src IS NULL AND NOT script THEN coalesce(alias, string_split(name, '.')[1]) WHEN name = '*' AND NOT script THEN '*' || base ELSE coalesce(alias, name) END AS local,
    CASE WHEN src IS NULL THEN name WHEN name = '*' THEN base ELSE base || '.' || name END AS target FROM based) WHERE local IS NOT NULL GROUP BY 1, 2, 3
)
"""
_CALLS = f""", c AS (
  SELECT *, string_split(call, '.')[1] AS head, CASE WHEN contains(call, '.') THEN string_split(substr(call, strpos(call, '.') + 1), '(')[1] END AS rest, string_split(string_split(call, '.')[-1], '(')[1] AS tail, string_split(call, '(')[1] AS bare,
    CASE WHEN call = 'super' OR starts_with(call, 'super.') OR starts_with(call, 'super()') THEN 'super' WHEN contains(call, ').') AND contains(call, '(') THEN 'chain' ELSE 'plain' END AS form,
    regexp_extract(call, '\\.(call|apply|bind)$', 1) AS suffix, regexp_matches(file_path, '{resolve.SCRIPT_FILES}') AS script, {_FILE_MODULE.replace('project_name', 'project')} AS module FROM (
    SELECT DISTINCT project_name AS project, qualified_name AS caller, file_path, CASE WHEN type = 'method' THEN regexp_replace(qualified_name, '\\.[^.]*$', '') END AS class, unnest(calls) AS call FROM code_entities) WHERE call <> ''
), above AS (
  SELECT m.project, m.origin AS class, string_split(n.qn, '.')[-1] AS method, struct_extract(min(ROW(struct_extract(m.m, 1), struct_extract(m.m, 2), m.reached, n.qn)), 4) AS target FROM (SELECT project, origin, reached, min(ROW(depth, ord)) AS m FROM lines WHERE origin <> reached GROUP BY 1, 2, 3) m
  JOIN nodes n ON n.project = m.project AND n.label = 'Method' AND regexp_replace(n.qn, '\\.[^.]*$', '') = m.reached GROUP BY 1, 2, 3
), types AS (
  SELECT DISTINCT project, caller, regexp_extract(pair, '^(\\w+)', 1) AS variable, regexp_extract(pair, '(\\w+)$', 1) AS type FROM (SELECT project_name AS project, qualified_name AS caller, unnest(regexp_extract_all(signature, '([A-Za-z_]\\w*\\??\\s*:\\s*[A-Z]\\w*)\\s*[,)=]', 1)) AS pair FROM code_entities WHERE signature IS NOT NULL)
), objects AS (
  SELECT project, caller, call, file_path, module, regexp_extract(call, '^([\\w.]+)\\([^()]*\\)\\.[^.()]+$', 1) AS type, regexp_extract(call, '\\.([^.()]+)$', 1) AS method, 4 AS place, 'chain' AS strategy FROM c WHERE form = 'chain'
  UNION ALL SELECT c.project, c.caller, c.call, c.file_path, c.module, t.type, c.rest, 6, 'import' FROM c JOIN types t ON t.project = c.project AND t.caller = c.caller AND t.variable = c.head WHERE c.form = 'plain' AND c.rest IS NOT NULL
), classed AS (
  SELECT o.*, CASE WHEN contains(o.type, '.') THEN o.type ELSE coalesce(m.target, k.qn, f.qn) END AS class FROM objects o LEFT JOIN mapped m ON m.project = o.project AND m.file_path = o.file_path AND m.local = o.type
  LEFT JOIN nodes k ON k.project = o.project AND k.label = 'Class' AND k.qn = o.module || '.' || o.type LEFT JOIN (SELECT project, name, min(qn) AS qn FROM nodes WHERE label = 'Class' GROUP BY 1, 2) f ON f.project = o.project AND f.name = o.type WHERE o.type <> '' AND o.method <> ''
), near AS (
  SELECT project, caller, call, min(ROW(len(l) + len(r) - 2 * {_COMMON} - CASE WHEN starts_with(qn, module || '.') THEN 2 ELSE 0 END, qn)) AS t FROM (
    SELECT c.*, n.qn, string_split(c.module, '.') AS l, string_split(n.qn, '.') AS r FROM c JOIN nodes n ON n.project = c.project AND string_split(n.qn, '.')[-1] = c.tail WHERE c.form = 'plain') GROUP BY 1, 2, 3
), found AS (
  SELECT c.project, c.caller, c.call, 1 AS place, 'qualified' AS strategy, c.call AS target FROM c
  UNION ALL SELECT project, caller, call, 2, 'iife', module || '.' || call FROM c WHERE script AND regexp_matches(call, '^iife_(?:func|arrow)_')
  UNION ALL SELECT c.project, c.caller, c.call, 3, 'super', a.target FROM c JOIN above a ON a.project = c.project AND a.class = c.class AND a.method = CASE WHEN c.call IN ('super', 'super()') THEN '__init__' ELSE c.rest END WHERE c.form = 'super'
  UNION ALL SELECT o.project, o.caller, o.call, o.place, o.strategy, coalesce(n.qn, a.target) FROM classed o LEFT JOIN nodes n ON n.project = o.project AND n.qn = o.class || '.' || o.method LEFT JOIN above a ON a.project = o.project AND a.class = o.class AND a.method = o.method
  UNION ALL SELECT c.project, c.caller, c.call, 5, 'import', m.target FROM c JOIN mapped m ON m.project = c.project AND m.file_path = c.file_path AND m.local = c.call WHERE c.form = 'plain'
  UNION ALL SELECT c.project, c.caller, c.call, 7, 'import', m.target || '.' || c.rest FROM c JOIN mapped m ON m.project = c.project AND m.file_path = c.file_path AND m.local = c.head WHERE c.form = 'plain'
  UNION ALL SELECT c.project, c.caller, c.call, 8, 'import', m.target || '.' || c.call FROM c JOIN mapped m ON m.project = c.project AND m.file_path = c.file_path AND starts_with(m.local, '*') WHERE c.form = 'plain'
  UNION ALL SELECT project, caller, call, 9, 'module', module || '.' || string_split(head, '(')[1] FROM c WHERE form = 'plain'
), every AS (
  SELECT f.* FROM found f JOIN nodes n ON n.project = f.project AND n.qn = f.target
  UNION ALL SELECT * FROM (SELECT project, caller, call, 10, 'builtin', CASE WHEN NOT script THEN CASE WHEN bare IN ({_quoted(resolve.PYTHON_BUILTINS)}) THEN 'builtins.' || bare END WHEN call IN ({_quoted(resolve.SCRIPT_FUNCTIONS)}) THEN 'builtin.' || call
    WHEN bare IN ({_quoted(resolve.SCRIPT_TYPES)}) THEN 'builtin.' || bare WHEN suffix <> '' THEN 'builtin.Function.prototype.' || suffix END AS target FROM c WHERE form = 'plain') WHERE target IS NOT NULL
  UNION ALL SELECT project, caller, call, 11, 'simple', struct_extract(t, 2) FROM near UNION ALL SELECT project, caller, call, 12, 'none', NULL FROM c
)
SELECT project, caller, call, arg_min(strategy, place) AS strategy, struct_extract(min(ROW(place, target)), 2) AS target FROM every GROUP BY 1, 2, 3"""
ORACLE = {
    "import_map": GRAPH + _IMPORTS + "SELECT project, file_path, local, target FROM mapped",
    "resolve_names": GRAPH
    + _IMPORTS
    + """, asked AS (SELECT DISTINCT * FROM (SELECT project_name AS project, file_path, name FROM imports UNION SELECT project_name, file_path, unnest(base_classes) FROM code_entities) WHERE name IS NOT NULL)
SELECT a.project, a.file_path, a.name, coalesce(min(m.target), min(n.qn)) AS target FROM asked a LEFT JOIN mapped m ON m.project = a.project AND m.file_path = a.file_path AND m.local = a.name
LEFT JOIN mapped s ON s.project = a.project AND s.file_path = a.file_path AND starts_with(s.local, '*') LEFT JOIN nodes n ON n.project = a.project AND n.qn = s.target || '.' || a.name GROUP BY 1, 2, 3""",
    "param_type_match": GRAPH
    + _IMPORTS
    + """, n AS (SELECT DISTINCT entity_id, project_name AS project, file_path, qualified_name AS qn, name, type, signature FROM code_entities), flat AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(signature, '(?s)\\((.*)\\)', 1), '%s', '', 'g'), '%s', '', 'g'), '%s', '', 'g') AS inside FROM n WHERE type IN ('function', 'method') AND signature IS NOT NULL
), p AS (SELECT DISTINCT project, qn AS function, file_path, unnest(regexp_extract_all(inside, '(?:^|,)\\s*\\*{0,2}(?:\\.\\.\\.)?([A-Za-z_]\\w*)', 1)) AS parameter FROM flat),
c AS (SELECT project, file_path, name FROM n WHERE type = 'class' AND name <> '' AND qn = %s || '.' || name UNION SELECT m.project, m.file_path, m.local FROM mapped m JOIN n ON n.project = m.project AND n.qn = m.target AND n.type = 'class'),
s AS (SELECT p.project, p.function, p.parameter, c.name AS class, CASE WHEN lower(parameter) = lower(name) THEN 100 WHEN ends_with(lower(name), lower(parameter)) OR ends_with(lower(parameter), lower(name)) THEN 90
  WHEN contains(lower(parameter), lower(name)) THEN floor(80 * (length(name)::DOUBLE / length(parameter)))::INT ELSE 0 END AS score FROM p JOIN c ON c.project = p.project AND c.file_path = p.file_path)
SELECT p.project, p.function, p.parameter, struct_extract(b, 2) AS class, coalesce(-struct_extract(b, 1), 0)::INT AS score FROM (SELECT DISTINCT project, function, parameter FROM p) p
LEFT JOIN (SELECT project, function, parameter, min(ROW(-score, class)) AS b FROM s WHERE score > 50 GROUP BY 1, 2, 3) b ON b.project = p.project AND b.function = p.function AND b.parameter = p.parameter"""
    % (*[r"\\([^()]*\\)|\\[[^\\[\\]]*\\]|\\{[^{}]*\\}|<[^<>]*>".replace("\\\\", "\\")] * 3, _MODULE.replace("project_name", "project").replace("path,", "file_path,")),
    "scan_statistics": _F
    + "SELECT language, count(*) AS file_count, sum(length(content) - length(replace(content, chr(10), '')) + 1)::BIGINT AS total_lines, sum(length(content))::BIGINT AS total_size FROM f WHERE content IS NOT NULL GROUP BY 1",
    "content_hash_changed": _F + "SELECT file_id, coalesce(sha256(content) <> content_hash, true) AS changed FROM f",
    "unchanged_semi": "WITH b AS (SELECT *, min(ingested_at) OVER (PARTITION BY file_id) AS first FROM files) SELECT file_id, path, content_hash FROM b WHERE ingested_at > first AND EXISTS (SELECT 1 FROM b o WHERE o.ingested_at = o.first AND o.path = b.path AND o.content_hash = b.content_hash)",
    "upsert_nodes": "SELECT project_name, name, entity_id, start_line FROM (SELECT *, row_number() OVER (PARTITION BY project_name, name ORDER BY ingested_at DESC, entity_id DESC) AS place FROM code_entities) WHERE place = 1",
    "delete_file_entities": _GONE + "SELECT project, qn, label FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.project = n.project AND g.file_path = n.file_path)",
    "delete_calls_for_file": _GONE + "SELECT project, src, dst FROM calls c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.project = c.project AND g.qn IN (c.src, c.dst))",
    "delete_by_prefix": _F + "SELECT file_id, project_name, path FROM f WHERE NOT starts_with(path, '/srv/repos/' || project_name || '/squads/')",
    "metadata_upsert_version": "SELECT coalesce(p.id, l.id) AS id, (CASE WHEN l.id IS NULL THEN p.version ELSE coalesce(p.version, 0) + 1 END)::INT AS version FROM project_metadata p FULL JOIN (SELECT DISTINCT project_metadata_id AS id FROM metadata_generation_log WHERE status = 'completed') l ON l.id = p.id",
    "generation_log_order": "SELECT project_metadata_id, id, field_name, status, row_number() OVER (PARTITION BY project_metadata_id ORDER BY created_at DESC, id) AS place FROM (SELECT DISTINCT ON (id) * FROM metadata_generation_log)",
    "generation_status": "SELECT project_metadata_id, fields, done, CASE WHEN done = fields THEN 'completed' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT project_metadata_id, count(*) AS fields, count(*) FILTER (status = 'completed') AS done FROM (SELECT *, row_number() OVER (PARTITION BY project_metadata_id, field_name ORDER BY created_at DESC, id DESC) AS place FROM (SELECT DISTINCT ON (id) * FROM metadata_generation_log)) WHERE place = 1 GROUP BY 1)",
    "metadata_documents": "SELECT project_name, array_to_string(from_json(json_extract(tech_stack, '$.languages'), '[\"VARCHAR\"]'), ',') AS languages, json_extract_string(entry_points, '$[0].path') AS entry_point, json_array_length(core_features)::BIGINT AS features FROM project_metadata",
    "list_projects": "SELECT p.project_name, p.status, count(DISTINCT f.path) AS file_count FROM project_metadata p LEFT JOIN files f ON f.project_name = p.project_name GROUP BY 1, 2",
    "project_stats_prefix": GRAPH
    + "SELECT p.project_name, count(DISTINCT n.file_path) AS files, count(*) FILTER (n.label = 'Class') AS class, count(*) FILTER (n.label = 'Function') AS function, count(*) FILTER (n.label = 'Method') AS method, count(*) FILTER (n.label = 'Interface') AS interface FROM project_metadata p LEFT JOIN nodes n ON starts_with(n.file_path, '/srv/repos/' || p.project_name || '/') GROUP BY 1",
    "context_file_summaries": GRAPH
    + "SELECT f.file_id, coalesce(c.n, 0) AS entity_count, coalesce(f.language, 'unknown') || ' file with ' || coalesce(c.n, 0) || ' entities' AS summary FROM (SELECT DISTINCT file_id, project_name, path, language FROM files) f LEFT JOIN (SELECT project, file_path, count(*) AS n FROM nodes GROUP BY 1, 2) c ON c.project = f.project_name AND c.file_path = f.path",
    "call_chain_explanations": GRAPH
    + "SELECT a.project, a.src AS origin, c.dst AS reached, array_to_string(list_transform([a.src, a.dst, b.dst, c.dst], lambda x: string_split(x, '.')[-1]), ' → ') AS explanation FROM calls a JOIN calls b ON b.project = a.project AND b.src = a.dst JOIN calls c ON c.project = b.project AND c.src = b.dst WHERE (a.src, a.dst) <> (b.src, b.dst) AND (b.src, b.dst) <> (c.src, c.dst) AND (a.src, a.dst) <> (c.src, c.dst)",
    "import_extract": _F
    + """SELECT file_id, source, NOT starts_with(source, '.') AS is_external FROM (SELECT file_id, unnest(regexp_extract_all(content, '(?m)^[ \\t]*import\\s+(?:[^;''"]*?\\sfrom\\s*)?["'']([^"''\\n]+)["'']', 1)) AS source FROM f
  WHERE coalesce(lower(language), CASE regexp_extract(lower(path), '\\.([^.]+)$', 1) WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'cts' THEN 'typescript' WHEN 'jsx' THEN 'jsx' WHEN 'tsx' THEN 'tsx' END) IN ('javascript', 'typescript', 'jsx', 'tsx'))""",
    "module_qn": _F + f"SELECT file_id, {_MODULE} AS module FROM f",
    "registry_simple_name": GRAPH + "SELECT project, string_split(qn, '.')[-1] AS simple_name, count(*) AS n, min(qn) AS first FROM nodes GROUP BY 1, 2",
    "registry_prefix": GRAPH + "SELECT project, array_to_string(parts[1:n], '.') AS prefix, count(*) AS n FROM (SELECT project, string_split(qn, '.') AS parts, unnest(range(1, len(string_split(qn, '.')) + 1)) AS n FROM nodes) GROUP BY 1, 2",
    "registry_suffix": GRAPH + "SELECT project, array_to_string(string_split(qn, '.')[-2:], '.') AS suffix, count(*) AS n FROM nodes GROUP BY 1, 2",
    "resolve_calls": _UP + _IMPORTS + _CALLS,
    "module_distance": GRAPH
    + f"SELECT project, src, dst, (len(l) + len(r) - 2 * {_COMMON} - CASE WHEN starts_with(dst, src || '.') THEN 2 ELSE 0 END)::INT AS distance FROM (SELECT *, string_split(src, '.') AS l, string_split(dst, '.') AS r FROM calls)",
    "mro_bfs": _UP
    + "SELECT project, qn AS class, qn AS ancestor, 0 AS depth FROM nodes WHERE label IN ('Class', 'Interface') UNION ALL SELECT project, origin, reached, min(depth) FROM lines WHERE origin <> reached GROUP BY 1, 2, 3",
    "subclasses": _UP + "SELECT project, reached AS class, origin AS subclass, count(*) AS paths FROM lines GROUP BY 1, 2, 3",
    "inherited_methods": _UP
    + """, mro AS (SELECT project, qn AS class, qn AS ancestor, 0 AS depth, 0 AS ord FROM nodes WHERE label IN ('Class', 'Interface')
  UNION ALL SELECT project, origin, reached, struct_extract(m, 1), struct_extract(m, 2) FROM (SELECT project, origin, reached, min(ROW(depth, ord)) AS m FROM lines WHERE origin <> reached GROUP BY 1, 2, 3))
SELECT project, class, method, struct_extract(min(ROW(depth, ord, ancestor)), 3) AS defined_in FROM (
  SELECT mro.*, n.name AS method FROM mro JOIN nodes n ON n.project = mro.project AND n.label = 'Method' AND regexp_replace(n.qn, '\\.[^.]*$', '') = mro.ancestor) GROUP BY 1, 2, 3""",
    "inheritance_stats": GRAPH
    + "SELECT n.project, count(*) AS classes, count(*) FILTER (coalesce(e.n, 0) > 0) AS with_parents, round(avg(coalesce(e.n, 0)), 6) AS avg_parents FROM nodes n LEFT JOIN (SELECT project, src, count(*) AS n FROM extends GROUP BY 1, 2) e ON e.project = n.project AND e.src = n.qn WHERE n.label IN ('Class', 'Interface') GROUP BY 1",
}
