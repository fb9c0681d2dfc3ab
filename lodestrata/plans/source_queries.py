"""Extraction, chunks, embeddings, streams and search over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.engine import QueryEngine
from lodestrata.functions.models import embed, summarize
from lodestrata.operators import chunks, graph, index
from lodestrata.operators.resolve import SCRIPT_FILES
from lodestrata.session import cut, shared_folder, table
from lodestrata.sources import extract
from lodestrata.streaming.changes import run_changes, run_index


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_python(table(spark, d, "files")).select("file_id", "type", "local_name", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))


def extract_script_entities(spark: SparkSession, d: str) -> DataFrame:
    found = extract.extract_script(table(spark, d, "files"))
    return found.select("file_id", "type", "name", "local_name", "start_line", "end_line", "signature", F.array_join("base_classes", ",").alias("bases"), F.array_join("calls", ",").alias("calls"))


def _indexed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Paths of the script files that a table has rows of."""
    return table(spark, d, name).where(F.col("file_path").rlike(SCRIPT_FILES)).select(F.col("file_path").alias("path")).distinct()


def script_entities_of_indexed(spark: SparkSession, d: str) -> DataFrame:
    """What is extracted from the script files that entities are known of: the table says the same."""
    files = table(spark, d, "files").join(_indexed(spark, d, "code_entities"), "path", "left_semi")
    found = extract.extract_script(files).join(files.select("file_id", F.col("path").alias("file_path")).distinct(), "file_id")
    return found.select("file_path", "type", "local_name", "start_line", "end_line", "is_async", "is_static").distinct()


def script_imports_of_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same of imports."""
    files = table(spark, d, "files").join(_indexed(spark, d, "imports"), "path", "left_semi")
    found = extract.extract_script_imports(files).join(files.select("file_id", F.col("path").alias("file_path")).distinct(), "file_id")
    return found.select("file_path", "name", "alias", "source", "is_external", "line_number").distinct()


def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return extract.extract_python_imports(files).unionByName(extract.extract_script_imports(files))


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all files by the standard bounds."""
    made = chunks.chunk_files(table(spark, d, "files"), table(spark, d, "code_entities"))
    return made.select("project_name", "file_path", "entity_type", "entity_name", "language", "part", "start_line", "end_line", F.length("content").alias("n_chars"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all files in windows that most functions don't fit in."""
    made = chunks.chunk_files(table(spark, d, "files"), table(spark, d, "code_entities"), 120, 30)
    return made.select("project_name", "file_path", "entity_type", "entity_name", "part", "start_line", "end_line")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return index.build_index(chunks.chunk_files(table(spark, d, "files"), table(spark, d, "code_entities")))


def similar_excluding_file(spark: SparkSession, d: str) -> DataFrame:
    """The five chunks nearest to each chunk of an entity whose id is divisible by 50, none of its own file."""
    made = cut(_index(spark, d).select("chunk_id", "vector", "project_name", "file_path", "graph_node_id"))
    asked = table(spark, d, "code_entities").where("entity_id % 50 = 0").select("project_name", F.col("qualified_name").alias("graph_node_id")).distinct()
    return index.similar_excluding_file(made, made.join(asked, ["project_name", "graph_node_id"], "left_semi"))


def code_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten Python methods nearest to a question."""
    return index.code_search(_index(spark, d), "merge the items of a queue and flush the session", language="python", entity_type="method").select("chunk_id", "file_path", "entity_name", "score")


def summary_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten entities whose summaries are nearest to a question."""
    known = graph.nodes(table(spark, d, "code_entities"))
    rows = known.select(F.col("project").alias("project_name"), "file_path", F.lower("label").alias("entity_type"), F.coalesce("qn", F.lit("")).alias("entity_name"), summarize(F.col("label"), F.col("name"), F.col("docstring"), F.col("signature")).alias("summary"))
    return index.code_search(index.summary_index(rows), "keeps the order of the items").select("entity_name", "summary", "score")


def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that must be indexed again, where the index was made of what arrived before a day."""
    files, entities = table(spark, d, "files"), table(spark, d, "code_entities")
    made = chunks.chunk_files(files.where("ingested_at < '2025-07-01'"), entities.where("ingested_at < '2025-07-01'"))
    return index.stale_files(files, made)


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each entity in the latest content of its file."""
    wanted = table(spark, d, "code_entities").where("start_line is not null and end_line is not null").select("project_name", F.col("file_path").alias("path"), "start_line", "end_line").distinct()
    return index.snippet(table(spark, d, "files"), wanted)


def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", embed(F.col("text")).alias("vector"))
    return docs.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def entity_summaries(spark: SparkSession, d: str) -> DataFrame:
    known = graph.nodes(table(spark, d, "code_entities"))
    return known.select("entity_id", summarize(F.col("label"), F.col("name"), F.col("docstring"), F.col("signature")).alias("summary"))


def stream_final_state(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of actions on users: a signup, click, view or purchase changes one, an error deletes it."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")
    action = F.when(F.col("event_type") == "error", "deleted").otherwise("changed")
    actions = events.select(F.col("user_id").alias("key"), "ts", action.alias("action"), F.col("event_id").cast("string").alias("payload"))
    return run_changes(actions, f"{shared_folder(spark)}/changes-{uuid.uuid4()}").select(F.col("key").alias("user_id"), F.col("payload").alias("event_id"))


def stream_file_index(spark: SparkSession, d: str) -> DataFrame:
    """Files as a stream of changes: what is indexed at its end, and how many lines of each were chunked."""
    schema = table(spark, d, "files").schema
    files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{d}/files*")
    lines = lambda df: df.select("path", "content_hash", (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    rows = run_index(files, f"{shared_folder(spark)}/index-{uuid.uuid4()}", lines)["rows"]
    return rows.select("path", "content_hash", "lines")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for the question who calls the function that is called most."""
    engine = QueryEngine(spark, d)
    most = graph.call_edges(engine.entities).groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").first()
    name = most.dst.rpartition(".")[2] if most else "main"
    return engine.search(f"who calls `{name}`, also indirectly?")


def search_implementation(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for the question how the class with the most methods is made, with the surroundings of each entity."""
    engine = QueryEngine(spark, d)
    most = graph.class_with_methods(engine.entities).orderBy(F.desc("methods"), "qn").first()
    return engine.context(f"how does `{most.qn if most else 'main'}` work").drop("docstring")


NAMES = (
    "extract_entities extract_script_entities script_entities_of_indexed script_imports_of_indexed extract_imports chunk_lines chunk_windows similar_excluding_file code_search summary_search stale_files snippets embed_hash entity_summaries stream_final_state stream_file_index "
    "hybrid_search search_implementation"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE = {
    "entity_summaries": "SELECT entity_id, upper(type[1]) || type[2:] || coalesce(' ' || name, '') || ' - ' || coalesce(nullif(regexp_extract(trim(docstring, ' '), '^([^\\n]*)', 1), ''), signature, 'no description') AS summary FROM (SELECT DISTINCT entity_id, type, name, docstring, signature FROM code_entities)",
    "stream_final_state": "SELECT user_id, event_id FROM (SELECT user_id, event_id::VARCHAR AS event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS place FROM events) WHERE place = 1 AND event_type <> 'error'",
    "stream_file_index": """SELECT path, content_hash, length(content) - length(replace(content, chr(10), '')) + 1 AS lines FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ingested_at DESC, content_hash DESC NULLS LAST) AS place FROM files
  WHERE regexp_matches(lower(path), '\\.(py|js|jsx|ts|tsx)$') AND len(list_filter(string_split(replace(coalesce(relative_path, path), '\\', '/'), '/'), lambda x: x IN ('.git', 'node_modules', '__pycache__', '.venv', 'venv', 'dist', 'build', '.egg-info') OR ends_with(x, '.egg-info'))) = 0) WHERE place = 1 AND content IS NOT NULL""",
    "snippets": """SELECT w.project_name, w.path, w.start_line, w.end_line, array_to_string(string_split(f.content, chr(10))[greatest(w.start_line, 1):w.end_line], chr(10)) AS snippet FROM (SELECT DISTINCT project_name, file_path AS path, start_line, end_line FROM code_entities WHERE start_line IS NOT NULL AND end_line IS NOT NULL) w
JOIN (SELECT project_name, path, arg_max(content, ingested_at) AS content FROM files WHERE content IS NOT NULL GROUP BY 1, 2) f ON f.project_name = w.project_name AND f.path = w.path""",
    "stale_files": """WITH early AS (SELECT * FROM files WHERE ingested_at < '2025-07-01'), e AS (SELECT * FROM code_entities WHERE ingested_at < '2025-07-01'), hashes AS (SELECT project_name, path, min(content_hash) AS content_hash FROM early GROUP BY 1, 2),
held AS (SELECT h.* FROM hashes h JOIN e ON e.project_name = h.project_name AND e.file_path = h.path WHERE coalesce(e.signature, '') <> '' OR coalesce(e.docstring, '') <> '' OR coalesce(e.code, '') <> ''
  UNION SELECT f.project_name, f.path, f.content_hash FROM early f WHERE regexp_matches(f.content, '\\S') AND NOT EXISTS (SELECT 1 FROM e WHERE e.project_name = f.project_name AND e.file_path = f.path))
SELECT DISTINCT project_name, path, content_hash FROM files f WHERE content_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.project_name = f.project_name AND h.path = f.path AND h.content_hash = f.content_hash)""",
    "script_entities_of_indexed": f"""SELECT DISTINCT file_path, type, CASE WHEN type = 'method' THEN array_to_string(string_split(qualified_name, '.')[-2:], '.') ELSE string_split(qualified_name, '.')[-1] END AS local_name, start_line, end_line, coalesce(is_async, false) AS is_async, coalesce(is_static, false) AS is_static
FROM code_entities e WHERE regexp_matches(file_path, '{SCRIPT_FILES}') AND EXISTS (SELECT 1 FROM files f WHERE f.path = e.file_path AND coalesce(f.content, '') <> '')""",
    "script_imports_of_indexed": f"SELECT DISTINCT file_path, name, alias, source, is_external, line_number FROM imports i WHERE regexp_matches(file_path, '{SCRIPT_FILES}') AND EXISTS (SELECT 1 FROM files f WHERE f.path = i.file_path AND coalesce(f.content, '') <> '')",
}
