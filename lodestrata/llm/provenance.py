"""Which source files were not written by hand.

Vendored copies are found by hashes computed bottom-up, from blocks of lines over files to
directories (a Merkle tree): a node whose hash occurs in several repositories is third-party code,
and so is a file most blocks of which, or a directory most entries of which, do. Header and layout
rules find what tools wrote, minified scripts and data saved as code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

#: A block of fewer characters is too common to tell anything.
BLOCK_CHARS = 40
#: A file is a copy if so large a part of its blocks, and so many characters, occur elsewhere.
SHARED_PART, SHARED_CHARS = 0.5, 400
#: A directory is a changed copy if it has so many entries that occur elsewhere, and they are so large a part of all.
SHARED_ENTRIES, ENTRIES_PART = 3, 0.8

#: How headers of generated files begin, and where such files lie.
_OPENS = r"(?:#|//|/\*+!?|\*|<!--|--|;)\s*"
GENERATED_HEADER = (
    r"(?m)\A(?:[ \t\r]*(?:#|//|/\*|\*)[^\n]*\n|\s*\n){0,6}?[ \t]*" + _OPENS + r"(?:@generated\b|-\*-\s*(?:auto-?)?generated|(?i:auto-?\s?generated)\b"
    r"|This file (?:was|is|has been) (?:auto(?:matically|-)?\s?)?generated|Code generated by .{0,80}DO NOT EDIT|Generated by [\w./-]+(?:[;,]|\s+(?:v?\d|on\b|from\b|at\b)|\s*$)"
    r"|Automatisch (?:erzeugt|generiert)|G[ée]n[ée]r[ée] automatiquement|Generado autom[áa]ticamente)"
)
GENERATED_PATH = r"(?:^|/)(?:__generated__|generated|gen|autogen)/|\.(?:gen|generated|g)\.[cm]?[jt]sx?$|_(?:pb2(?:_grpc)?|generated|gen)\.pyi?$|(?:^|/)migrations/\d{4}_auto_"
MINIFIED_PATH = r"[.-]min\.[cm]?js$"
#: The banner that a bundler puts above the one script it makes of a library.
BANNER = r"\A\s*/\*!?\s*\*?\s*[\w.@/-]+ v\d+\.\d+[\w.]*\s"
_NUMBERED = r"(?m)^(?:export\s+)?(?:declare\s+)?(?:async\s+)?(?:function|type|interface|const|class|enum)\s+\w*[A-Za-z](\d{1,4})\b"
_TOP_LEVEL = r"(?m)^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?:function|type|interface|const|let|class|enum|def)\s"
_MIGRATION = r"(?m)^class Migration\(\s*[\w.]*[mM]igrations?\.Migration\s*\):\s*\n\s+dependencies\s*="
#: What turns literals into 0, one after the other: escapes, strings, lines of encoded bytes, words, numbers, keys.
LITERALS = (
    (r"\\.", ""),
    (r"\"[^\"\n]*\"|'[^'\n]*'", "0"),
    (r"(?m)^[ \t]*[A-Za-z0-9+/]{40,}={0,2}[ \t]*$", "0"),
    (r"\b(?:true|false|null|undefined|None|True|False)\b", "0"),
    (r"\d[\d.]*(?:[eE][-+]?\d+)?", "0"),
    (r"[\w$]+[ \t]*:", "0:"),
)
#: A line that holds nothing but those and brackets.
LITERAL_LINE = r"(?m)^[-+0.,:; \t\[\](){}]+$"
#: At most this part of a data file is left without its literals.
CODE_PART = 0.15


def clean_path(path: Column) -> Column:
    """A relative path in one way of writing: '/' between parts, no '.' parts, no doubled or leading '/'."""
    path = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?:^|(?<=/))(?:\.?/)+", "")
    return path


def distinct_files(files: DataFrame) -> DataFrame:
    """(file_id, project_name, rel, content, lines) of the files with content; a redelivered file may repeat."""
    rel = clean_path(F.coalesce("relative_path", "path"))
    text = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^﻿", "")
    return files.where("file_id is not null and content is not null and content != ''").select("file_id", "project_name", rel.alias("rel"), text.alias("content"))


def _parts(content: Column) -> Column:
    """Blocks of lines between blank lines."""
    return F.transform(F.split(content, r"\n\s*\n"), lambda block: F.btrim(block, F.lit(" \t\n")))


def _blocks(files: DataFrame) -> DataFrame:
    """(file_id, project_name, place, hash, chars) of each block that is long enough to tell something."""
    rows = files.select("file_id", "project_name", F.posexplode(F.filter(_parts(F.col("content")), lambda block: F.length(block) >= BLOCK_CHARS)).alias("place", "block"))
    return rows.select("file_id", "project_name", "place", F.xxhash64("block").alias("hash"), F.length("block").alias("chars"))


def _shared(nodes: DataFrame) -> DataFrame:
    """Hashes of `nodes` (hash, project_name) that occur in more than one project."""
    return nodes.groupBy("hash").agg(F.min("project_name").alias("a"), F.max("project_name").alias("b")).where("a != b").select("hash")


def merkle_nodes(leaves: DataFrame) -> DataFrame:
    """(project_name, path, depth, hash, files, chars) of each file and directory over leaves (project_name, path, hash, chars).

    A directory's hash combines names and hashes of what lies in it by exclusive or, so a
    directory with any number of entries is a partial aggregation. One pass a level, deepest first,
    to the top, however deep a tree is.
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    columns = ["project_name", "path", "depth", "hash", "files", "chars"]
    nodes = cut(leaves.withColumns({"depth": depth, "files": F.lit(1).cast("long")}).select(*columns))
    deepest = nodes.agg(F.max("depth").alias("d")).first().d or 0
    found = [nodes]
    above = None
    for level in range(deepest, 0, -1):
        here = nodes.where(F.col("depth") == level)
        here = here if above is None else here.unionByName(above)
        folders = here.groupBy("project_name", parent.alias("path")).agg(
            F.bit_xor(F.xxhash64(_name("path"), F.col("hash"))).alias("hash"), F.sum("files").alias("files"), F.sum("chars").alias("chars")
        )
        above = cut(folders.withColumn("depth", F.lit(level - 1)).select(*columns), "hash")
        found.append(above)
    return reduce(DataFrame.unionByName, found).where("path != ''")


def _name(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def vendored(files: DataFrame) -> DataFrame:
    """file_ids of the rows of `distinct_files` that are copies of code of other repositories.

    Either half of a file's blocks occur in other projects, or one of its directories does as a
    whole. Blocks and nodes are counted by hash after a partial aggregation, so a library that
    every repository holds costs no more than another.
    """
    blocks = _blocks(files)
    common = _shared(blocks).withColumn("common", F.lit(True))
    per_file = blocks.join(common, "hash", "left").groupBy("file_id").agg(
        F.sum("chars").alias("chars"), F.sum(F.when(F.col("common"), F.col("chars")).otherwise(0)).alias("shared")
    )
    return per_file.where((F.col("shared") >= SHARED_CHARS) & (F.col("shared") >= SHARED_PART * F.col("chars"))).select("file_id")


def shared_directories(files: DataFrame) -> DataFrame:
    """(project_name, path, files, chars) of each directory that is a copy of one of another project.

    Either it lies there too, equal in names and contents, or at least `SHARED_ENTRIES` of its
    entries, and `ENTRIES_PART` of all, do; of an equal one all subdirectories are listed as well.
    A file's hash is made of the hashes of its blocks; it counts once per project and path.
    """
    blocks = F.transform(_parts(F.col("content")), lambda block: F.xxhash64(block))
    whole = files.select("project_name", F.col("rel").alias("path"), F.xxhash64(blocks).alias("hash"), F.length("content").cast("long").alias("chars"))
    nodes = merkle_nodes(whole.groupBy("project_name", "path").agg(F.min("hash").alias("hash"), F.max("chars").alias("chars")))
    names = nodes.withColumn("parent", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("entry", F.xxhash64(_name("path"), F.col("hash")))
    elsewhere = names.groupBy("entry").agg(F.min("project_name").alias("a"), F.max("project_name").alias("b")).where("a != b").select("entry", F.lit(1).alias("common"))
    known = names.join(elsewhere, "entry", "left")
    entries = known.groupBy("project_name", F.col("parent").alias("path")).agg(
        F.count("*").alias("entries"), F.count("common").alias("common_entries"), F.sum("files").alias("files"), F.sum("chars").alias("chars")
    )
    changed = entries.where((F.col("common_entries") >= SHARED_ENTRIES) & (F.col("common_entries") >= ENTRIES_PART * F.col("entries")))
    folders = entries.select("project_name", "path")
    equal = nodes.join(_shared(nodes), "hash", "left_semi").select("project_name", "path", "files", "chars").join(folders, ["project_name", "path"], "left_semi")
    return equal.unionByName(changed.select("project_name", "path", "files", "chars")).where((F.col("path") != "") & (F.col("chars") >= SHARED_CHARS)).distinct()


def tool_written(files: DataFrame) -> DataFrame:
    """file_id and why of the rows of `distinct_files`: `generated`, `minified`, `data`, or null if no rule finds it.

    Null rows stay until they are grouped: a filter here would run every pattern once more.
    """
    content, rel = F.col("content"), F.col("rel")
    rest = content
    for literal, instead in LITERALS:
        rest = F.regexp_replace(rest, literal, instead)
    # what several rules use is a column of its own, so that no pattern runs twice
    rows = files.withColumns(
        {
            "rest": F.regexp_replace(rest, LITERAL_LINE, ""),
            "lines": F.regexp_count(content, F.lit(r"(?m)^[ \t]*\S")),
            "dense": F.length(F.regexp_replace(content, r"[ \t\n]+", "")),
            "places": F.regexp_extract_all(content, F.lit(_NUMBERED), F.lit(1)),
        }
    )
    length, lines, dense, places = F.length(content), F.col("lines"), F.col("dense"), F.col("places")
    script = rel.rlike(r"\.[cm]?[jt]sx?$")
    widest = content.rlike(r"[^\n]{80}")
    minified = script & widest & (((dense >= 0.93 * length) & (dense >= 40 * lines)) | ((dense >= 0.85 * length) & (dense >= 100 * lines)))
    ordered = F.element_at(places, 1).isin("0", "1") & (F.element_at(places, -1).cast("int") >= F.size(places) - 1)
    layout = ((F.size(places) >= 2) & ordered & (F.size(places) >= 0.8 * F.regexp_count(content, F.lit(_TOP_LEVEL)))) | content.rlike(_MIGRATION)
    # most lines must be literals: one long string doesn't make a data file
    code_lines = F.regexp_count("rest", F.lit(r"(?m)^[ \t]*\S"))
    data = (lines >= 5) & (code_lines <= 0.4 * lines) & (F.length(F.regexp_replace("rest", r"\s+", "")) <= CODE_PART * length)
    why = (
        F.when(content.rlike(GENERATED_HEADER) | rel.rlike(GENERATED_PATH) | layout, "generated")
        .when(rel.rlike(MINIFIED_PATH) | minified | (script & content.rlike(BANNER)), "minified")
        .when(data, "data")
    )
    return rows.select("file_id", why.alias("why"))


def not_by_hand(files: DataFrame) -> DataFrame:
    """(file_id, why) of the files that a person didn't write.

    Null or empty content is no case; a redelivered file counts once; rows without file_id are
    dropped; without rows there are none. Null paths leave only what the content tells.
    """
    texts = distinct_files(files)
    folders = shared_directories(texts)
    parts = F.split("rel", "/")
    folder = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    by_place = texts.select("file_id", "project_name", F.explode(folder).alias("path"))
    copied = by_place.join(folders.select("project_name", "path").distinct(), ["project_name", "path"], "left_semi").select("file_id")
    copies = vendored(texts).unionByName(copied).withColumn("why", F.lit("vendored"))
    return tool_written(texts).unionByName(copies).groupBy("file_id").agg(F.min("why").alias("why")).where("why is not null")
