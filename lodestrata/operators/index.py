"""Chunks with vectors as a search index: built, kept current, searched."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.models import embed, hash_embeddings
from lodestrata.operators.retrieval import cosine, vector_top_of_queries

Model = Callable[[list[str | None]], np.ndarray]


def build_index(chunks: DataFrame, model: Model = hash_embeddings) -> DataFrame:
    """`chunks` with the vector of each content and an id of its place, the same at every build."""
    return chunks.withColumns({"vector": embed(F.col("content"), model), "chunk_id": F.xxhash64("project_name", "file_path", "entity_name", "start_line", "part")})


def stale_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """(project_name, path, content_hash) of files no chunk of which has their hash: new, changed, or never indexed."""
    wanted = files.where("content_hash is not null").select("project_name", "path", "content_hash").distinct()
    held = index.select("project_name", F.col("file_path").alias("path"), "content_hash").distinct()
    return wanted.join(held, ["project_name", "path", "content_hash"], "left_anti")


def replace_files(index: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """The index with all chunks of the touched files (project_name, path) taken out and the fresh ones put in."""
    gone = touched.select("project_name", F.col("path").alias("file_path")).distinct()
    return index.join(gone, ["project_name", "file_path"], "left_anti").select(*index.columns).unionByName(fresh.select(*index.columns))


def _where(index: DataFrame, **equal: str | None) -> DataFrame:
    for column, value in equal.items():
        index = index if value is None else index.where(F.col(column) == value)
    return index


def search_index(index: DataFrame, query: list[float], k: int = 10, **equal: str | None) -> DataFrame:
    """The k chunks nearest to one vector, among those whose columns have the values of `equal`; zero vectors are at 0."""
    if k < 1 or not query:
        raise ValueError("a query vector and a positive k are needed")
    score = F.coalesce(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])), F.lit(0.0))
    return _where(index, **equal).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "file_path", "start_line", "chunk_id").limit(k).drop("vector")


def code_search(index: DataFrame, question: str, k: int = 10, language: str | None = None, entity_type: str | None = None, project: str | None = None, model: Model = hash_embeddings) -> DataFrame:
    """The k chunks nearest to a question, of a language, a type of entity and a project if given."""
    return search_index(index, model([question])[0].tolist(), k, language=language, entity_type=entity_type, project_name=project)


def similar_excluding_file(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score, place): the k chunks nearest to each chunk of `queries` (chunk_id, vector, file_path), none of its own file."""
    vectors = index.select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("embedding"), "file_path")
    asked = queries.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"), "file_path")
    return vector_top_of_queries(vectors, asked, k, differ="file_path")


def summary_index(summaries: DataFrame, model: Model = hash_embeddings) -> DataFrame:
    """Rows (project_name, file_path, entity_type, entity_name, summary) with vectors, to be searched like chunks."""
    rows = summaries.where("summary is not null and summary != ''").withColumns({"vector": embed(F.col("summary"), model), "chunk_id": F.xxhash64("project_name", "file_path", "entity_name", "summary")})
    return rows.withColumn("start_line", F.lit(1))


def snippet(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project_name, path, start_line, end_line, snippet) for rows (project_name, path, start_line, end_line): the lines of the file, as far as it has them."""
    texts = files.where("content is not null").groupBy("project_name", "path").agg(F.max_by("content", "ingested_at").alias("content"))
    lines = F.split("content", "\n")
    first = F.greatest(F.col("start_line"), F.lit(1))
    part: Column = F.slice(lines, first, F.greatest(F.least(F.col("end_line"), F.size(lines)) - first + 1, F.lit(0)))
    return wanted.join(texts, ["project_name", "path"]).select("project_name", "path", "start_line", "end_line", F.array_join(part, "\n").alias("snippet"))
