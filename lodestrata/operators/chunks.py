"""Texts of entities and files packed into windows of lines."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ship
from lodestrata.sources.languages import language_of

MAX_TOKENS, OVERLAP_TOKENS = 1000, 200
#: The public vocabulary that tokens are counted by.
VOCABULARY = os.path.join(os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = (
    "content string, file_path string, entity_type string, entity_name string, language string, start_line int, end_line int, graph_node_id string, content_hash string, project_name string, part int"
)


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text by a public vocabulary; marks that look like special tokens are ordinary text."""
    return len(_encoding(path).encode_ordinary(text))


def pack_lines(lines: list[str], most: int, overlap: int, count: Callable[[str], int] = count_tokens) -> list[tuple[int, int]]:
    """(first, beyond) of windows of at most `most` tokens; the next one begins with the longest tail of at most `overlap`.

    A line that is longer than the window makes one of its own.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap is less than the window")
    sizes = [count(line) for line in lines]
    windows, first, held = [], 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > most:
            windows.append((first, at))
            first, held = at, 0
            while first > windows[-1][0] + 1 and held + sizes[first - 1] <= overlap:
                first -= 1
                held += sizes[first]
            if held + size > most:
                first, held = at, 0
        held += size
    if lines:
        windows.append((first, len(lines)))
    return windows


def entity_text(signature: Column, docstring: Column, code: Column) -> Column:
    """What is searched of an entity: signature, docstring and code; null parts are left out."""
    return F.concat_ws("\n", signature, F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit('"""'), docstring, F.lit('"""'))), code)


def chunk_texts(texts: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Rows (content, ..., part) of texts in windows of lines; of a text that fits, part is 0, its name and lines stay."""
    ship(texts.sparkSession)
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if len(row.content) <= most or count_tokens(row.content) <= most:
                    out.append((*row, 0))
                    continue
                lines = row.content.split("\n")
                for part, (a, b) in enumerate(pack_lines(lines, most, overlap), 1):
                    out.append(("\n".join(lines[a:b]), row.file_path, row.entity_type, f"{row.entity_name}_part{part}", row.language, row.start_line + a, row.start_line + b - 1, row.graph_node_id, row.content_hash, row.project_name, part))
            yield pd.DataFrame(out, columns=names)

    return texts.select(*names[:-1]).mapInPandas(pack, SCHEMA)


def chunk_files(files: DataFrame, entities: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """The chunks of files: those of their entities, or of a file without any its whole content under its name.

    Repeated rows count once. Blank contents of files without entities give none.
    """
    known = files.groupBy("project_name", "path").agg(F.min("content_hash").alias("content_hash"), F.min(language_of()).alias("language"))
    columns = ["project_name", "file_path", "type", "qualified_name", "signature", "docstring", "code", "start_line", "end_line"]
    own = entities.dropDuplicates(["entity_id"]).select(*columns).join(known.withColumnRenamed("path", "file_path"), ["project_name", "file_path"], "left")
    of_entities = own.select(
        entity_text(F.col("signature"), F.col("docstring"), F.col("code")).alias("content"), "file_path", F.col("type").alias("entity_type"), F.coalesce("qualified_name", F.lit("")).alias("entity_name"), "language",
        F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", F.lit(1)).alias("end_line"), F.col("qualified_name").alias("graph_node_id"), "content_hash", "project_name",
    ).where("content != ''")
    held = entities.select("project_name", F.col("file_path").alias("path")).distinct()
    bare = files.where(F.col("content").rlike(r"\S")).join(held, ["project_name", "path"], "left_anti").dropDuplicates(["project_name", "path"])
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    whole = bare.select(
        "content", F.col("path").alias("file_path"), F.lit("file").alias("entity_type"), F.substring_index("path", "/", -1).alias("entity_name"), language_of().alias("language"),
        F.lit(1).alias("start_line"), lines.cast("int").alias("end_line"), F.lit(None).cast("string").alias("graph_node_id"), "content_hash", "project_name",
    )
    return chunk_texts(of_entities.unionByName(whole), most, overlap)
