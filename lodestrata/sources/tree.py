"""Source trees as tables."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestrata.session import cut, ship

#: Languages by extension, and names that are left out.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx"}
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "*.egg-info")
SCHEMA = "path string, relative_path string, language string, content_hash string, size_bytes long, line_count int, content string"


#: Paths that one task lists or reads, about.
PATHS_A_TASK = 2000


def scan_tree(spark: SparkSession, root: str, languages: dict[str, str] = LANGUAGES, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """A row per source file below `root`, a folder that all workers see.

    Folders are listed level by level, each as a row, and their files then read where the hash of
    the path puts them, so neither a large folder nor a deep one is one task. Ignored folders are
    not entered. Built-in file sources leave out names that begin with an underscore, this one doesn't.
    Files that can't be read are left out; bytes that aren't UTF-8 are replaced. Lines are newlines + 1.
    """
    if not os.path.isdir(root):
        raise ValueError(f"{root} is no folder")
    ship(spark)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                try:
                    found = [(e.path, e.is_dir(follow_symlinks=False)) for e in os.scandir(folder) if not _ignored(e.name, ignored)]
                except OSError:
                    continue
                yield pd.DataFrame(found, columns=["path", "folder"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                row = _row(path, root, languages)
                if row:
                    yield pd.DataFrame([row], columns=names)

    folders = spark.createDataFrame([(root,)], "path string")
    files = []
    while True:
        here = cut(folders.mapInPandas(entries, "path string, folder boolean"))
        files.append(here.where("not folder").select("path"))
        folders = here.where("folder").select("path")
        n = folders.count()
        if not n:
            break
        folders = folders.repartition(max(1, -(-n // PATHS_A_TASK)), "path")
    paths = reduce(DataFrame.unionByName, files)
    return paths.repartition(max(1, -(-paths.count() // PATHS_A_TASK)), "path").mapInPandas(read, SCHEMA)


def _ignored(name: str, patterns: tuple[str, ...]) -> bool:
    return any(fnmatch.fnmatch(name, pattern) for pattern in patterns)


def _row(path: str, root: str, languages: dict[str, str]) -> tuple | None:
    language = languages.get(os.path.splitext(path)[1].lower())
    if language is None:
        return None
    try:
        with open(path, "rb") as source:
            data = source.read()
    except OSError:
        return None
    return path, os.path.relpath(path, root), language, hashlib.sha256(data).hexdigest(), len(data), data.count(b"\n") + 1, data.decode("utf-8", "replace")
