"""Parent-child links resolved to whole hierarchies by tree contraction.

Rounds of leaf raking and unary-chain compression shrink the forest to its roots; the recorded
contractions are then undone in reverse order, which hands every node its root, depth and path.
A loop can't be raked: compression shrinks it to one node that is its own parent, and everything
that was contracted into it or hangs below it gets root -1 and depth -1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

MAX_ROUNDS = 200


def _draw(column: str) -> Column:
    """A number of each node that changes from round to round; the round is a column, so that all rounds run the same code."""
    return F.xxhash64(F.col(column), F.col("turn"))


def _contract(live: DataFrame, with_path: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """The records of each round, oldest first, and the nodes that stand for a loop.

    A round finds each node's number of children. Nodes without any are raked. Of the nodes with
    one child an independent set (those that draw more than parent and child, a third of a chain and
    one of any two that are each other's parents) is spliced out: the child takes over the parent
    and the length of the link, also if it is raked in the same round, so that a record's parent is
    always a node that lives on.
    """
    rounds: list[DataFrame] = []
    loops: list[DataFrame] = []
    live = live.withColumn("turn", F.lit(0))
    for _ in range(MAX_ROUNDS):
        children = live.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.max("id").alias("child"))
        kind = (
            F.when(F.col("parent") == F.col("id"), "loop")
            .when(F.col("n").isNull(), "leaf")
            .when((F.col("n") == 1) & (_draw("id") > _draw("parent")) & (_draw("id") > _draw("child")), "chain")
            .otherwise("stays")
        )
        step = cut(live.join(children, "id", "left").withColumn("kind", kind).drop("n"), "id")
        loops.append(step.where("kind = 'loop'").select("id"))
        spliced = step.where("kind = 'chain'").select(
            F.col("child").alias("id"),
            F.col("parent").alias("up"),
            F.col("hops").alias("up_hops"),
            *([F.concat("via", F.array("id")).alias("up_via")] if with_path else []),
        )
        columns = [
            "id",
            F.coalesce("up", "parent").alias("parent"),
            (F.col("hops") + F.coalesce("up_hops", F.lit(0).cast("long"))).alias("hops"),
            "kind",
            (F.col("turn") + 1).alias("turn"),
        ]
        if with_path:
            columns.append(F.when(F.col("up").isNull(), F.col("via")).otherwise(F.concat("up_via", "via")).alias("via"))
        moved = step.drop("child").join(spliced, "id", "left").select(*columns)
        rounds.append(moved.where(F.col("kind").isin("leaf", "chain")))
        live = moved.where("kind = 'stays'").drop("kind")
        if step.where("kind = 'stays'").isEmpty():
            return rounds, loops
    raise RuntimeError(f"contraction did not end within {MAX_ROUNDS} rounds")


def resolve_hierarchy(nodes: DataFrame, with_path: bool = False) -> DataFrame:
    """One row (id, root, depth and, if asked for, path) per node of `nodes` (id, parent).

    * parent null, or not the id of any node: the node is a root with depth 0, itself as root.
    * a node on a loop (its own parent included) or below one: root -1, depth -1, path null.
    * repeated ids count once, with the least parent; a null id is dropped; no rows give no rows.
    * path holds the ids from the root to the node itself.

    Every join is on a node id. A parent with a third of all children is counted by a partial
    aggregation; as a join key it meets one row, so a skewed partition can be split.
    """
    links = nodes.where("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("parent").cast("long").alias("parent"))
    known = links.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    links = cut(links.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent")), "id")
    empty_path = F.array().cast("array<long>")
    live = links.where("parent is not null").select("id", "parent", F.lit(1).cast("long").alias("hops"), *([empty_path.alias("via")] if with_path else []))
    zero = F.lit(0).cast("long")
    roots = links.where("parent is null").select("id", F.col("id").alias("root"), zero.alias("depth"), *([F.array("id").alias("path")] if with_path else []))
    if live.isEmpty():
        return roots
    rounds, loops = _contract(live, with_path)
    lost = F.lit(-1).cast("long")
    looped = reduce(DataFrame.union, loops)
    # roots without a child are asked about by no record
    asked = links.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    apart = roots.join(asked, "id", "left_anti")
    done = cut(roots.join(asked, "id", "left_semi").unionByName(looped.select("id", lost.alias("root"), lost.alias("depth"), *([F.lit(None).cast("array<long>").alias("path")] if with_path else []))), "id")
    for nth, records in reversed(list(enumerate(rounds))):
        above = done.select(F.col("id").alias("parent"), "root", F.col("depth").alias("above"), *([F.col("path").alias("above_path")] if with_path else []))
        found = records.join(above, "parent").select(
            "id",
            "root",
            F.when(F.col("above") < 0, lost).otherwise(F.col("above") + F.col("hops")).alias("depth"),
            *([F.concat("above_path", "via", F.array("id")).alias("path")] if with_path else []),
        )
        # the first round took most nodes; what it took is asked about by no other
        done = done.unionByName(found) if nth == 0 else cut(done.unionByName(found), "id")
    return done.unionByName(apart)


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair on a root path, from rows with a path.

    The rows are as many as the depths add up to; nodes of loops have none.
    """
    spread = resolved.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor"))
    return spread.where("ancestor != descendant").select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))


def entity_parents(entities: DataFrame) -> DataFrame:
    """(id, parent) of every class, interface and method of a table of code entities.

    A class or interface has the first element of `base_classes` that names a class or interface
    of the same project: with a dot a qualified name, without one a name of the same module. A
    method has the class of its qualified name without the last part. Deleted and late entities
    count. Null names have no parent; of repeated rows one counts.
    """
    kinds = entities.where(F.col("type").isin("class", "interface", "method")).select(
        F.col("entity_id").cast("long").alias("id"), F.col("project_name").alias("project"), F.col("qualified_name").alias("name"), "type", "base_classes"
    )
    owner = F.regexp_extract("name", r"(?s)^(.*)\.", 1)
    bases = F.when(F.col("type") == "method", F.array(owner)).otherwise(
        F.transform("base_classes", lambda b: F.when(b.contains("."), b).otherwise(F.concat_ws(".", owner, b)))
    )
    wanted = kinds.select("id", "project", F.posexplode(bases).alias("place", "target")).where("target is not null and target != ''").distinct()
    owners = kinds.where("type != 'method'").groupBy("project", F.col("name").alias("target")).agg(F.min("id").alias("parent"))
    chosen = wanted.join(owners, ["project", "target"]).groupBy("id").agg(F.min(F.struct("place", "parent")).getField("parent").alias("parent"))
    return kinds.select("id").distinct().join(chosen, "id", "left")
