"""References to records that do not exist, were deleted or arrive later.

Names are hashed to integers. The keys of the existing records, the leading bits of their hashes,
are sorted and compressed into runs of consecutive integers; each reference is matched as-of with
the run that starts last at or before its key. Beyond the run's end no record has the key; within
it the run's members tell which records have it, by the whole hash, and when they came and went.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys are matched within blocks of so many consecutive ones; a run ends with its block.
BLOCK_BITS = 4


def _identity(project: Column, name: Column) -> dict[str, Column]:
    """128 bits that stand for a name of a project; the key is the beginning of the first 64."""
    return {"id": F.xxhash64(project, name), "id2": F.xxhash64(name, F.lit(1), project)}


def _keyed(rows: DataFrame, bits: int) -> DataFrame:
    """Adds the integer key of `bits` bits and its block."""
    key = F.shiftrightunsigned("id", 64 - bits)
    return rows.withColumn("key", key).withColumn("block", F.shiftright("key", BLOCK_BITS))


def entity_references(entities: DataFrame) -> DataFrame:
    """(project, target, entity_id, field, seen, indexed) of `calls` and `base_classes` that name the own project.

    `seen` is when the row arrived and `indexed` its index time. A redelivered row gives its
    references again, with a later arrival. Null arrays, null elements and rows without a project
    give nothing.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(c, F.array().cast("array<string>")).alias("targets")) for c in ("calls", "base_classes")])
    rows = entities.select(F.col("project_name").alias("project"), "entity_id", F.col("indexed_at").alias("indexed"), F.col("ingested_at").alias("seen"), F.explode(fields).alias("f"))
    rows = rows.select("project", "entity_id", "indexed", "seen", "f.field", F.explode(F.array_distinct("f.targets")).alias("target"))
    return rows.where(F.col("target").startswith(F.concat("project", F.lit("."))))


def parent_runs(entities: DataFrame, bits: int) -> DataFrame:
    """(block, run_start, run_end, next_start, members) of the keys of all names that entities have.

    Repeated rows of a name are one member after a partial aggregation, so a name with any number
    of rows costs no more than others. A member has its whole hash, its earliest arrival and
    deletion. With as many keys as names a run is short and its members few.
    """
    names = entities.where("project_name is not null and qualified_name is not null").select(
        *[c.alias(n) for n, c in _identity(F.col("project_name"), F.col("qualified_name")).items()], "ingested_at", "deleted_at"
    )
    once = names.groupBy("id", "id2").agg(F.min("ingested_at").alias("arrived"), F.min("deleted_at").alias("deleted"))
    order = Window.partitionBy("block").orderBy("key")
    # a key that follows its predecessor, or equals it, goes on with its run
    opens = F.coalesce(F.col("key") - F.lag("key").over(order) > 1, F.lit(True))
    keys = _keyed(once, bits).withColumn("opens", opens)
    keys = keys.withColumn("run_start", F.max(F.when(F.col("opens"), F.col("key"))).over(order))
    runs = keys.groupBy("block", "run_start").agg(F.max("key").alias("run_end"), F.collect_list(F.struct("id", "id2", "arrived", "deleted")).alias("members"))
    return runs.withColumn("next_start", F.lead("run_start").over(Window.partitionBy("block").orderBy("run_start")))


def match_runs(references: DataFrame, runs: DataFrame, bits: int) -> DataFrame:
    """`references` with `beyond`, and `arrived` and `deleted` of the record they name.

    The as-of match is a join on the block with the bounds of the run that starts last at or before
    the key, so each reference meets one run at most; a third of all references to one name are one
    side of an outer join, which can be split.
    """
    keyed = _keyed(references.withColumns(_identity(F.col("project"), F.col("target"))), bits)
    # the lead is unknown to a run that is the last of its block
    last = F.coalesce(F.col("next_start"), (F.col("r.block") + 1) * (1 << BLOCK_BITS))
    matched = keyed.alias("k").join(runs.alias("r"), (F.col("k.block") == F.col("r.block")) & (F.col("run_start") <= F.col("key")) & (F.col("key") < last), "left")
    same = F.filter("members", lambda m: (m["id"] == F.col("k.id")) & (m["id2"] == F.col("k.id2")))
    within = F.when(F.col("key") <= F.col("run_end"), F.try_element_at(same, F.lit(1)))
    found = matched.withColumn("record", within)
    return found.select("project", "target", "entity_id", "field", "seen", "indexed", F.col("record").isNull().alias("beyond"), "record.arrived", "record.deleted")


def key_bits(entities: DataFrame) -> int:
    """Bits of the keys: there are as many keys as entities, to the next power of two."""
    return max(BLOCK_BITS + 1, min(62, math.ceil(math.log2(max(2, entities.count())))))


def find_orphans(entities: DataFrame) -> DataFrame:
    """(entity_id, field, target, reason, indexed) of references to nothing.

    Reasons in this order: `missing`, no record of the project has the name; `deleted`, it ceased
    to exist not after the referring entity's index time; `late`, it arrived after the referring
    entity. Repeated rows and elements count once: a redelivered row arrived later, so if any row
    of the entity arrived before the record, the earliest did. A null time on either side gives no
    reason of its kind. Without rows there are none.
    """
    bits = key_bits(entities)
    matched = match_runs(entity_references(entities), parent_runs(entities, bits), bits)
    rank = F.when(F.col("beyond"), 1).when(F.col("deleted") <= F.col("indexed"), 2).when(F.col("arrived") > F.col("seen"), 3)
    orphans = matched.select("entity_id", "field", "target", rank.alias("rank"), "indexed").where("rank is not null")
    once = orphans.groupBy("entity_id", "field", "target").agg(F.min("rank").alias("rank"), F.min("indexed").alias("indexed"))
    reason = F.element_at(F.array(F.lit("missing"), F.lit("deleted"), F.lit("late")), F.col("rank"))
    return once.select("entity_id", "field", "target", reason.alias("reason"), "indexed")


def orphan_report(entities: DataFrame) -> DataFrame:
    """Orphan references counted by field, month of the referring entity's index time, and reason."""
    return find_orphans(entities).groupBy("field", F.date_format("indexed", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n"))
