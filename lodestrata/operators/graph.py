"""The code graph as tables, and the reads over it.

`nodes` (project, qn, name, label, file_path, signature, docstring, start_line, end_line, parent_class)
has a row per entity; `edges` (project, src, dst, kind) a row per distinct edge. Variable-length
reads follow trails: an edge occurs at most once in a path, a node may recur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.substrings import containing
from lodestrata.session import cut


def nodes(entities: DataFrame) -> DataFrame:
    """One row per entity; redelivered rows count once."""
    columns = [
        F.col("project_name").alias("project"), F.col("qualified_name").alias("qn"), "name", F.initcap("type").alias("label"), "file_path", "signature", "docstring",
        "start_line", "end_line", "parent_class", "entity_id",
    ]
    return entities.select(*columns).dropDuplicates(["entity_id"])


def call_edges(entities: DataFrame) -> DataFrame:
    """CALLS edges: distinct pairs of caller and callee where the called text is a qualified name of the project."""
    calls = entities.select(F.col("project_name").alias("project"), F.col("qualified_name").alias("src"), F.explode("calls").alias("dst")).distinct()
    known = nodes(entities).select("project", F.col("qn").alias("dst"))
    return calls.join(known, ["project", "dst"]).select("project", "src", "dst", F.lit("CALLS").alias("kind"))


def extends_edges(entities: DataFrame) -> DataFrame:
    """EXTENDS edges (project, src, dst, kind, ord) to classes and interfaces of the project; a bare name is one of the module."""
    kinds = entities.where(F.col("type").isin("class", "interface"))
    module = F.regexp_extract("src", r"(?s)^(.*)\.", 1)
    bases = kinds.select(F.col("project_name").alias("project"), F.col("qualified_name").alias("src"), F.posexplode("base_classes").alias("ord", "base")).distinct()
    bases = bases.withColumn("dst", F.when(F.col("base").contains("."), F.col("base")).otherwise(F.concat(module, F.lit("."), "base")))
    known = kinds.select(F.col("project_name").alias("project"), F.col("qualified_name").alias("dst")).distinct()
    return bases.join(known, ["project", "dst"]).groupBy("project", "src", "dst").agg(F.min("ord").alias("ord")).withColumn("kind", F.lit("EXTENDS"))


def defines_edges(entities: DataFrame) -> DataFrame:
    """DEFINES from a file to its classes, interfaces and functions; DEFINES_METHOD from a class to its methods."""
    known = nodes(entities)
    from_file = known.where("label != 'Method'").select("project", F.col("file_path").alias("src"), F.col("qn").alias("dst"), F.lit("DEFINES").alias("kind"))
    owner = F.regexp_extract("qn", r"(?s)^(.*)\.", 1)
    methods = known.where("label = 'Method'").select("project", owner.alias("src"), F.col("qn").alias("dst"))
    owners = known.where(F.col("label").isin("Class", "Interface")).select("project", F.col("qn").alias("src"))
    return from_file.unionByName(methods.join(owners, ["project", "src"]).select("project", "src", "dst", F.lit("DEFINES_METHOD").alias("kind")))


def import_edges(imports: DataFrame) -> DataFrame:
    """IMPORTS from a file to what it imports: its source, or its name where there is none."""
    target = F.coalesce(F.expr("nullif(source, '')"), "name")
    return imports.select(F.col("project_name").alias("project"), F.col("file_path").alias("src"), target.alias("dst"), F.lit("IMPORTS").alias("kind")).distinct()


def all_edges(entities: DataFrame, imports: DataFrame) -> DataFrame:
    parts = [call_edges(entities), extends_edges(entities).drop("ord"), defines_edges(entities), import_edges(imports)]
    return reduce(DataFrame.unionByName, parts)


def trails(edges: DataFrame, hops: int) -> DataFrame:
    """(project, origin, reached, depth, path) of every trail of 1 to `hops` edges (hops at most 10)."""
    if not 1 <= hops <= 10:
        raise ValueError("a trail has 1 to 10 edges")
    step = edges.select("project", F.col("src").alias("reached"), F.col("dst").alias("next"))
    edge = lambda a, b: F.concat_ws("\x01", a, b)
    here = edges.select("project", F.col("src").alias("origin"), F.col("dst").alias("reached"), F.lit(1).alias("depth"), F.array("src", "dst").alias("path"), F.array(edge("src", "dst")).alias("used"))
    found = [here]
    for depth in range(2, hops + 1):
        grown = here.join(step, ["project", "reached"]).where(~F.array_contains("used", edge(F.col("reached"), F.col("next"))))
        here = grown.select(
            "project", "origin", F.col("next").alias("reached"), F.lit(depth).alias("depth"), F.array_append("path", F.col("next")).alias("path"),
            F.array_append("used", edge(F.col("reached"), F.col("next"))).alias("used"),
        )
        found.append(here)
    return reduce(DataFrame.unionByName, found).drop("used")


def transitive(edges: DataFrame, hops: int = 3) -> DataFrame:
    """Distinct (project, origin, reached, depth) with origin != reached: callees of origin, or callers of reached."""
    return trails(edges, hops).where("origin != reached").select("project", "origin", "reached", "depth").distinct()


def paths_between(edges: DataFrame, hops: int = 3, most: int = 10) -> DataFrame:
    """The `most` shortest paths of each pair, with their place among them."""
    rows = trails(edges, hops).where("origin != reached").withColumn("route", F.array_join("path", ">"))
    place = F.row_number().over(Window.partitionBy("project", "origin", "reached").orderBy("depth", "route"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("project", "origin", "reached", "depth", "route", "place")


def hierarchy_lines(extends: DataFrame, hops: int = 5) -> DataFrame:
    """Ancestors and descendants of each class up to `hops` levels: (project, class, other, depth, direction), least depth."""
    pairs = trails(extends, hops).where("origin != reached").groupBy("project", "origin", "reached").agg(F.min("depth").alias("depth"))
    up = pairs.select("project", F.col("origin").alias("class"), F.col("reached").alias("other"), "depth", F.lit("ancestor").alias("direction"))
    down = pairs.select("project", F.col("reached").alias("class"), F.col("origin").alias("other"), "depth", F.lit("descendant").alias("direction"))
    return up.unionByName(down)


def shortest_paths(edges: DataFrame, hops: int = 10) -> DataFrame:
    """(project, origin, reached, depth, route): the shortest way of each pair that at most `hops` edges (at most 10) join; of equal ones the least.

    A round goes one edge on from the pairs that the last one found, and keeps one way of each pair
    not met before; it ends when none is new.
    """
    if not 1 <= hops <= 10:
        raise ValueError("a way has 1 to 10 edges")
    keys = ["project", "origin", "reached"]
    step = cut(edges.where("src != dst").select("project", F.col("src").alias("at"), F.col("dst").alias("next")).distinct(), "project", "at")
    here = cut(step.select("project", F.col("at").alias("origin"), F.col("next").alias("reached"), F.concat_ws(">", "at", "next").alias("route")), *keys)
    found = here.select(*keys, F.lit(1).alias("depth"), "route")
    seen = here.select(*keys)
    for depth in range(2, hops + 1):
        grown = here.withColumnRenamed("reached", "at").join(step, ["project", "at"]).where("origin != next")
        grown = grown.groupBy("project", "origin", F.col("next").alias("reached")).agg(F.min(F.concat_ws(">", "route", "next")).alias("route"))
        here = cut(grown.join(seen, keys, "left_anti"), *keys)
        if here.isEmpty():
            break
        found = found.unionByName(here.select(*keys, F.lit(depth).alias("depth"), "route"))
        seen = seen.unionByName(here.select(*keys))
    return found


def reach(edges: DataFrame, origins: DataFrame, hops: int, forward: bool = True) -> DataFrame:
    """(project, origin, reached, depth) of what lies within `hops` edges of `origins` (project, qn), with its least depth.

    Only what the origins lead to is walked; of a pair met on several ways one row goes on.
    """
    here_column, next_column = ("src", "dst") if forward else ("dst", "src")
    step = edges.select("project", F.col(here_column).alias("at"), F.col(next_column).alias("next")).distinct()
    here = origins.select("project", F.col("qn").alias("origin"), F.col("qn").alias("at")).distinct()
    found = []
    for depth in range(1, hops + 1):
        here = here.join(step, ["project", "at"]).where("origin != next").select("project", "origin", F.col("next").alias("at")).distinct()
        found.append(here.select("project", "origin", F.col("at").alias("reached"), F.lit(depth).alias("depth")))
    return reduce(DataFrame.unionByName, found).groupBy("project", "origin", "reached").agg(F.min("depth").alias("depth"))


def related(edges: DataFrame, origins: DataFrame, hops: int = 2, salts: int = 16) -> DataFrame:
    """(project, origin, reached, distance): nodes within `hops` edges of any kind and direction of `origins` (project, qn), with their least distance.

    A node that everything touches, as a module that all files import, is a hot key of the step on
    from it: its edges are dealt out over `salts` parts, and the few pairs that reach it go to each.
    """
    both = edges.select("project", "src", "dst").unionByName(edges.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().where("src != dst")
    step = both.select("project", F.col("src").alias("at"), F.col("dst").alias("next"), F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int").alias("salt"))
    here = origins.select("project", F.col("qn").alias("origin"), F.col("qn").alias("at")).distinct()
    found = []
    for distance in range(1, hops + 1):
        spread = here.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        here = spread.join(step, ["project", "at", "salt"]).where("origin != next").select("project", "origin", F.col("next").alias("at")).distinct()
        found.append(here.select("project", "origin", F.col("at").alias("reached"), F.lit(distance).alias("distance")))
    return reduce(DataFrame.unionByName, found).groupBy("project", "origin", "reached").agg(F.min("distance").alias("distance"))


def centrality(edges: DataFrame) -> DataFrame:
    """In, out and total degree of each node over CALLS, and its distinct incident edges of any kind."""
    ends = edges.select("project", F.col("src").alias("qn"), "kind", F.lit(0).alias("into"), "src", "dst").unionByName(
        edges.select("project", F.col("dst").alias("qn"), "kind", F.lit(1).alias("into"), "src", "dst")
    )
    call = F.col("kind") == "CALLS"
    loop = (F.col("into") == 1) & (F.col("src") == F.col("dst"))
    return ends.groupBy("project", "qn").agg(
        F.count_if(call & (F.col("into") == 1)).alias("in_degree"),
        F.count_if(call & (F.col("into") == 0)).alias("out_degree"),
        F.count_if(call).alias("total_degree"),
        F.count_if(~loop).alias("relationship_count"),
    )


def file_context(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """Per file: entities defined, imports, and calls that come from and go to other files; each side is counted before the join."""
    known = nodes(entities).select("project", "qn", "file_path")
    calls = call_edges(entities)
    ends = calls.join(known.select("project", F.col("qn").alias("src"), F.col("file_path").alias("from_file")), ["project", "src"]).join(
        known.select("project", F.col("qn").alias("dst"), F.col("file_path").alias("to_file")), ["project", "dst"]
    ).where("from_file != to_file")
    defined = known.groupBy("project", "file_path").agg(F.count("*").alias("entities"))
    imported = import_edges(imports).groupBy("project", F.col("src").alias("file_path")).agg(F.count("*").alias("imports"))
    outward = ends.groupBy("project", F.col("from_file").alias("file_path")).agg(F.count_distinct("dst").alias("called"))
    inward = ends.groupBy("project", F.col("to_file").alias("file_path")).agg(F.count_distinct("src").alias("callers"))
    joined = defined
    for side in (imported, outward, inward):
        joined = joined.join(side, ["project", "file_path"], "left")
    return joined.na.fill(0, ["imports", "called", "callers"])


def implementation_context(entities: DataFrame, most: int = 10) -> DataFrame:
    """Per function or method: up to `most` callers, callees and siblings of its file, in order of name."""
    known = nodes(entities).where(F.col("label").isin("Function", "Method")).select("project", "qn", "file_path")
    calls = call_edges(entities)
    first = lambda c: F.array_join(F.slice(F.sort_array(F.collect_set(c)), 1, most), "|")
    callers = calls.groupBy("project", F.col("dst").alias("qn")).agg(first("src").alias("callers"))
    callees = calls.groupBy("project", F.col("src").alias("qn")).agg(first("dst").alias("callees"))
    # the least names of a file are found before they meet its functions
    place = F.row_number().over(Window.partitionBy("project", "file_path").orderBy("qn"))
    least = known.withColumn("place", place).where(F.col("place") <= most + 1).groupBy("project", "file_path").agg(F.sort_array(F.collect_list("qn")).alias("near"))
    joined = known.join(least, ["project", "file_path"], "left").join(callers, ["project", "qn"], "left").join(callees, ["project", "qn"], "left")
    siblings = F.array_join(F.slice(F.filter("near", lambda x: x != F.col("qn")), 1, most), "|")
    return joined.select("project", "qn", F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("callees", F.lit("")).alias("callees"), siblings.alias("siblings"))


def class_with_methods(entities: DataFrame) -> DataFrame:
    """Each class or interface with its methods in order of line and name; none leave an empty list."""
    known = nodes(entities)
    methods = known.where("label = 'Method'").select("project", F.regexp_extract("qn", r"(?s)^(.*)\.", 1).alias("qn"), "name", "start_line")
    lists = methods.groupBy("project", "qn").agg(F.sort_array(F.collect_list(F.struct("start_line", "name"))).alias("m"))
    owners = known.where(F.col("label").isin("Class", "Interface")).select("project", "qn").join(lists, ["project", "qn"], "left")
    return owners.select("project", "qn", F.coalesce(F.size("m"), F.lit(0)).alias("methods"), F.coalesce(F.array_join(F.transform("m", lambda x: x["name"]), ","), F.lit("")).alias("names"))


def usage_patterns(entities: DataFrame, most: int = 5) -> DataFrame:
    """For each callee and caller: up to `most` other names the caller calls, in order."""
    calls = call_edges(entities).select("project", "src", "dst")
    place = F.row_number().over(Window.partitionBy("project", "src").orderBy("dst"))
    least = calls.withColumn("place", place).where(F.col("place") <= most + 1).groupBy("project", "src").agg(F.sort_array(F.collect_list("dst")).alias("near"))
    also = F.array_join(F.slice(F.filter("near", lambda x: x != F.col("dst")), 1, most), "|")
    return calls.join(least, ["project", "src"]).select("project", "dst", "src", also.alias("also_calls"))


def module_dependencies(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, file_path, import_name, entities): how many entities of the project an import of a file may mean.

    An entity is meant if its name is the import's, or its qualified name contains it. Each name is
    matched once a project, whatever the number of files that import it.
    """
    known = nodes(entities).select("project", F.col("qn").alias("text"), "name")
    wanted = imports.select(F.col("project_name").alias("project"), "file_path", F.col("name").alias("word")).distinct()
    words = wanted.select("project", "word").distinct()
    within = containing(known, words, ["project"]).groupBy("project", "word").agg(F.count("*").alias("within"))
    # a name that isn't part of its own qualified name
    apart = known.where(~F.contains("text", "name")).groupBy("project", F.col("name").alias("word")).agg(F.count("*").alias("apart"))
    joined = wanted.join(within, ["project", "word"], "left").join(apart, ["project", "word"], "left")
    total = F.coalesce("within", F.lit(0).cast("long")) + F.coalesce("apart", F.lit(0).cast("long"))
    return joined.select("project", "file_path", F.col("word").alias("import_name"), total.alias("entities"))


def name_search(entities: DataFrame, words: DataFrame) -> DataFrame:
    """(word, project, qn, name, label, match_score) of entities whose name or qualified name contains a searched word, in any case.

    0 the name itself, 1 the qualified name itself, 2 the name in other letters, 3 the beginning,
    4 the end, 5 a part of the name as written, 6 any other part. `words` (word) are looked up once each.
    """
    known = nodes(entities).select("project", "qn", "name", "label").withColumn("text", F.concat_ws("\n", F.lower("qn"), F.lower("name")))
    asked = words.where("word is not null and word != ''").select("word", F.lower("word").alias("low")).distinct()
    found = containing(known, asked.select(F.col("low").alias("word"))).withColumnRenamed("word", "low").join(asked, "low")
    name, word = F.col("name"), F.col("word")
    score = (
        F.when(name == word, 0).when(F.col("qn") == word, 1).when(F.lower(name) == F.col("low"), 2).when(F.startswith(name, word), 3)
        .when(F.endswith(name, word), 4).when(F.contains(name, word), 5).otherwise(6)
    )
    return found.select("word", "project", "qn", "name", "label", score.alias("match_score"))


def search_by_name(entities: DataFrame, words: DataFrame) -> DataFrame:
    """(word, project, qn, name, label) of entities whose name or qualified name contains a searched word as it is written."""
    known = nodes(entities).select("project", "qn", "name", "label").withColumn("text", F.concat_ws("\n", "qn", "name"))
    return containing(known, words).drop("text")
