"""Mixing sources to target weights by a Pfair schedule of blocks.

The tokens of a source, read pass after pass, are cut into blocks, through the documents. Block k
of a source with weight w may run from slot floor(k / w) and must have run by slot
ceil((k + 1) / w); running the eligible block with the earliest deadline in each slot keeps every
source within one block of its share of any prefix. The schedule is made once for a frame of slots
and repeats; its size is a parameter and doesn't grow with the data.
"""

from __future__ import annotations

import math
from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.tokens import count_tokens
from lodestrata.session import cut

#: Most slots of a frame; weights with a smaller common denominator are met exactly, others to the nearest slot.
FRAME_SLOTS = 2000
BLOCK_TOKENS = 512
#: Documents whose tokens one task adds up in order, about.
RANGE_DOCUMENTS = 20_000


def apportion(weights: dict[str, float], slots: int = FRAME_SLOTS) -> dict[str, int]:
    """Whole slots of a frame for each source: exact if the weights' common denominator allows it.

    Otherwise `slots` (as many as sources, at least) by largest remainders, at least one for a positive weight.
    """
    parts = {s: Fraction(str(w)).limit_denominator(10**6) for s, w in weights.items() if w > 0}
    total = sum(parts.values())
    exact = {s: x / total for s, x in parts.items()}
    common = math.lcm(*[x.denominator for x in exact.values()]) if exact else 1
    if common <= slots:
        return {s: int(x * common) for s, x in exact.items()}
    slots = max(slots, len(exact))
    whole = {s: max(1, math.floor(x * slots)) for s, x in exact.items()}
    short = sorted(exact, key=lambda s: (whole[s] - exact[s] * slots, s))
    for s in short[: max(0, slots - sum(whole.values()))]:
        whole[s] += 1
    while sum(whole.values()) > slots:
        whole[max((s for s in whole if whole[s] > 1), key=lambda s: (whole[s] - exact[s] * slots, s))] -= 1
    return whole


def pfair_schedule(slots_of: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block of it in the frame) of each slot, the earliest deadline of the eligible first."""
    frame = sum(slots_of.values())
    released: list[list[str]] = [[] for _ in range(frame + 1)]
    released[0] = sorted(slots_of)
    done = dict.fromkeys(slots_of, 0)
    eligible: list[tuple[int, str]] = []
    order = []
    for slot in range(frame):
        for source in released[slot]:
            heappush(eligible, (-(-(done[source] + 1) * frame // slots_of[source]), source))
        _, best = heappop(eligible)
        order.append((best, done[best]))
        done[best] += 1
        if done[best] < slots_of[best]:
            released[max(slot + 1, done[best] * frame // slots_of[best])].append(best)
    return order


def _running_totals(docs: DataFrame) -> DataFrame:
    """Adds `begins`, the tokens of the source before each document in the order of `rank`.

    A source may hold any share of the rows, so its order is cut into ranges of hash values: sums
    of the ranges are added up first, then the documents within each range. There are the more
    ranges the more documents there are.
    """
    bits = max(4, math.ceil(math.log2(max(1, docs.count() / RANGE_DOCUMENTS))))
    ranged = docs.withColumn("part", F.shiftright(F.col("rank"), 64 - bits))
    sums = ranged.groupBy("source", "part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("part_begins", F.coalesce(F.sum("in_part").over(before), F.lit(0))).drop("in_part")
    within = Window.partitionBy("source", "part").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(starts, ["source", "part"]).select("source", "doc_id", "rank", "n_tokens", (F.col("part_begins") + F.col("inside")).alias("begins"))


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS, frame_slots: int = FRAME_SLOTS) -> DataFrame:
    """(slot, source, doc_id, pass, begins, n_tokens) of the largest mix that meets the targets.

    * A row is the part of a document that lies in a slot's block: `n_tokens` tokens from its token
      `begins` on. A long document goes on in the source's next block, short ones share one.
    * `docs` (doc_id, text, source): rows without a source, of a source that isn't listed, or
      without tokens have no part in it. Repeated doc_ids count once.
    * `targets` (source, target_share, max_repeats), a row per source: a null or non-positive
      share or repeat count takes no part; of repeated sources the row with the largest share
      counts. Shares of listed sources without documents go to the others in proportion.
    * The size is the largest at which no document is used more than `max_repeats` times, less
      under a token a block; the scarcest source sets it. All blocks are equally long, at most
      `block_tokens`; each source deviates by less than one from its share in any prefix of slots,
      and by nothing at the end of a frame.
    * Without documents or targets the result is empty.

    `slot` orders the mix; within a slot the documents follow one another by pass and rank.
    """
    wanted = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    )
    texts = docs.join(wanted.select("source"), "source", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    counts = count_tokens(texts, path=path)
    sized = cut(counts.where("n_tokens > 0").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")))
    # as many rows as sources are listed
    sources = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).join(wanted, "source").collect()
    spark = docs.sparkSession
    schema = "slot long, source string, doc_id long, pass int, begins long, n_tokens long"
    if not sources:
        return spark.createDataFrame([], schema)
    slots_of = apportion({r.source: r.target_share for r in sources}, frame_slots)
    frame = sum(slots_of.values())
    whole = math.floor(min(Fraction(r.max_repeats * r.tokens, slots_of[r.source]) for r in sources) * frame)
    frames = max(1, math.ceil(Fraction(whole, frame * block_tokens)))
    block = whole // (frame * frames)
    if not block:
        return spark.createDataFrame([], schema)
    plan = spark.createDataFrame(
        [(r.source, r.tokens, r.max_repeats, slots_of[r.source], frames * slots_of[r.source] * block) for r in sources],
        "source string, tokens long, max_repeats int, frame_blocks long, quota long",
    )
    slots = spark.createDataFrame([(s, k, i) for i, (s, k) in enumerate(pfair_schedule(slots_of))], "source string, block long, place long")
    ranked = _running_totals(sized.withColumn("rank", F.xxhash64("doc_id")))
    passes = F.sequence(F.lit(1), F.least(F.col("max_repeats").cast("long"), F.ceil(F.col("quota") / F.col("tokens"))).cast("int"))
    copies = ranked.join(plan, "source").withColumn("pass", F.explode(passes))
    copies = copies.withColumn("starts", (F.col("pass") - 1) * F.col("tokens") + F.col("begins")).where("starts < quota").withColumn("ends", F.least(F.col("starts") + F.col("n_tokens"), F.col("quota")))
    pieces = copies.withColumn("nth", F.explode(F.expr(f"sequence(starts div {block}, (ends - 1) div {block})")))
    opens = F.greatest(F.col("starts"), F.col("nth") * block)
    closes = F.least(F.col("ends"), (F.col("nth") + 1) * block)
    blocks = pieces.select(
        "source", "doc_id", F.col("pass").cast("int").alias("pass"), (opens - F.col("starts")).alias("begins"), (closes - opens).alias("n_tokens"),
        F.expr("nth % frame_blocks").alias("block"), F.expr("nth div frame_blocks").alias("frame"),
    )
    placed = blocks.join(slots, ["source", "block"])
    return placed.select((F.col("frame") * frame + F.col("place")).alias("slot"), "source", "doc_id", "pass", "begins", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, copies, most_repeats, n_tokens, actual_share) of each listed source.

    A source without part in the mix has zeros.
    """
    used = mixed.groupBy("source", "doc_id").agg(F.count_if(F.col("begins") == 0).alias("times"), F.sum("n_tokens").alias("n_tokens"))
    parts = used.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("times").alias("copies"), F.max("times").alias("most_repeats"), F.sum("n_tokens").alias("n_tokens")
    )
    whole = parts.agg(F.sum("n_tokens").alias("all_tokens"))
    joined = targets.where("source is not null").select("source", "target_share").join(parts, "source", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    share = F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0))
    return joined.select("source", "target_share", *[zero(c) for c in ("documents", "copies", "most_repeats", "n_tokens")], share.alias("actual_share"))
