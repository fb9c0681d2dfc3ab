"""Languages of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension.
EXTENSIONS = {"py": "python", "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx"}
#: Extensions of the same languages that only the wider registry knows.
MORE_EXTENSIONS = {"pyi": "python", "mjs": "javascript", "cjs": "javascript", "mts": "typescript", "cts": "typescript"}
SCRIPTS = ("javascript", "jsx", "typescript", "tsx")


def language_of(path: str = "path") -> Column:
    """The row's language, or where that is null the one of its path's extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.coalesce(F.lower("language"), *[F.when(extension == e, name) for e, name in (EXTENSIONS | MORE_EXTENSIONS).items()])
