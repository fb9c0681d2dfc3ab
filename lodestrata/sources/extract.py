"""Entities, imports and calls out of source texts."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ship
from lodestrata.sources.languages import SCRIPTS, language_of
from lodestrata.sources.scripts import script_entities, script_imports

ENTITY_SCHEMA = (
    "file_id long, type string, name string, local_name string, signature string, docstring string, start_line int, end_line int, is_async boolean, is_static boolean, "
    "is_classmethod boolean, decorators array<string>, parent_class string, base_classes array<string>, calls array<string>"
)


def _callable(node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> dict:
    decorators = [ast.unparse(d) for d in node.decorator_list]
    calls = {ast.unparse(n.func) for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute)}
    return {
        "type": "method" if owner else "function", "name": node.name, "local_name": f"{owner}.{node.name}" if owner else node.name,
        "signature": f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})", "docstring": ast.get_docstring(node, clean=False),
        "start_line": min([node.lineno, *(d.lineno for d in node.decorator_list)]), "end_line": node.end_lineno, "is_async": isinstance(node, ast.AsyncFunctionDef),
        "is_static": "staticmethod" in decorators, "is_classmethod": "classmethod" in decorators, "decorators": decorators, "parent_class": owner, "base_classes": [], "calls": sorted(calls),
    }


def python_entities(content: str) -> list[dict]:
    """Functions and classes of a module and the methods of those classes; nothing nested deeper. A text that doesn't parse has none."""
    warnings.simplefilter("ignore")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found.append(_callable(node, None))
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases if isinstance(b, ast.Name | ast.Attribute)]
            found.append(
                {
                    "type": "class", "name": node.name, "local_name": node.name, "signature": f"class {node.name}", "docstring": ast.get_docstring(node, clean=False),
                    "start_line": min([node.lineno, *(d.lineno for d in node.decorator_list)]), "end_line": node.end_lineno, "is_async": False, "is_static": False, "is_classmethod": False,
                    "decorators": [ast.unparse(d) for d in node.decorator_list], "parent_class": None, "base_classes": bases, "calls": [],
                }
            )
            found += [_callable(m, node.name) for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
    return found


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _extracted(files: DataFrame, languages: tuple[str, ...], make: Callable[[str], list[dict]]) -> DataFrame:
    """Rows of ENTITY_SCHEMA that `make` finds in the contents of files of some languages; a redelivered file's rows count once."""
    ship(files.sparkSession)
    names = _names(ENTITY_SCHEMA)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"file_id": file_id, **entity} for file_id, content in zip(batch["file_id"], batch["content"]) for entity in make(content)]
            yield pd.DataFrame(rows, columns=names)

    texts = files.where(language_of().isin(*languages) & F.col("content").isNotNull()).select("file_id", "content")
    return texts.mapInPandas(extract, ENTITY_SCHEMA).dropDuplicates(["file_id", "local_name", "start_line", "type"])


def extract_python(files: DataFrame) -> DataFrame:
    """Entities of the Python files (file_id, language, path, content); null content has none."""
    return _extracted(files, ("python",), python_entities)


def extract_script(files: DataFrame) -> DataFrame:
    """Entities of the script files: functions, arrow functions, classes with methods, interfaces, type aliases."""
    return _extracted(files, SCRIPTS, script_entities)


def extract_entities(files: DataFrame) -> DataFrame:
    """Entities of all files."""
    return extract_python(files).unionByName(extract_script(files))


IMPORT_SCHEMA = "file_id long, name string, alias string, source string, is_external boolean, line_number int"


def _imports(files: DataFrame, languages: tuple[str, ...], make: Callable[[str], list[tuple]]) -> DataFrame:
    ship(files.sparkSession)
    names = _names(IMPORT_SCHEMA)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file_id, *found) for file_id, content in zip(batch["file_id"], batch["content"]) for found in make(content)]
            yield pd.DataFrame(rows, columns=names)

    texts = files.where(language_of().isin(*languages) & F.col("content").isNotNull()).select("file_id", "content")
    return texts.mapInPandas(extract, IMPORT_SCHEMA).distinct()


def python_imports(content: str) -> list[tuple[str | None, str | None, str | None, bool, int]]:
    """(name, alias, source, is_external, line) of each name that a Python text imports; a text that doesn't parse has none."""
    warnings.simplefilter("ignore")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [(a.name, a.asname, None, True, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            source = "." * node.level + (node.module or "")
            found += [(a.name, a.asname, source, node.level == 0, node.lineno) for a in node.names]
    return found


def extract_python_imports(files: DataFrame) -> DataFrame:
    """Imports of the Python files that parse."""
    return _imports(files, ("python",), python_imports)


def extract_script_imports(files: DataFrame) -> DataFrame:
    """Imports of the script files."""
    return _imports(files, SCRIPTS, script_imports)
