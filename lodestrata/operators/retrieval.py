"""Vector search, scores, fusion of evidence, and the planning of questions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import ship

#: Weights of graph and vector evidence by intent, and the base weights of the other intents.
INTENT_WEIGHTS = {
    "find_callers": (0.8, 0.2), "find_callees": (0.8, 0.2), "find_call_chain": (0.9, 0.1), "find_hierarchy": (0.85, 0.15), "find_usages": (0.7, 0.3), "find_dependencies": (0.75, 0.25),
    "locate_entity": (0.6, 0.4), "locate_file": (0.5, 0.5), "explain_implementation": (0.5, 0.5), "explain_relationship": (0.6, 0.4), "explain_data_flow": (0.65, 0.35),
    "find_similar": (0.2, 0.8), "search_functionality": (0.3, 0.7), "search_pattern": (0.25, 0.75),
}
BASE_GRAPH, BASE_VECTOR, CENTRALITY, CONTEXT, ENTITY_BONUS, RELATION_BONUS, QUALITY = 0.5, 0.5, 0.2, 0.1, 0.3, 0.15, 0.1
PER_FILE, TOTAL = 5, 50
#: Literal words of a question that give its intent, first group first.
INTENT_WORDS = (
    ("find_callers", ("what calls", "who calls", "callers of")), ("find_callees", ("calls what", "what does.*call")), ("find_call_chain", ("call chain", "eventually call", "path from.*to")),
    ("find_hierarchy", ("extends", "inherits", "subclass", "hierarchy")), ("explain_implementation", ("how does", "how is.*implemented", "implementation of")),
    ("locate_entity", ("where is", "find the", "locate")), ("find_similar", ("similar to", "like")),
)
#: How names of code are written in a question: words run together, words joined by underscores, anything in backquotes.
QUESTION_NAMES = (r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z]+(?:_[a-z]+)+)\b", r"`([^`]+)`")
#: How much a step away costs a match and what is left at least, the worth of relations, the degree that counts in full, and the worth of what is known of an entity.
STEP, LEAST_MATCH, FULL_DEGREE = 0.2, 0.3, 50.0
RELATIONS = {"primary": 1.0, "caller": 0.8, "callee": 0.7}
OTHER_RELATION = 0.5
KNOWN = {"summary": 0.3, "docstring": 0.2, "signature": 0.2, "content": 0.3}
#: Quality of a content by its length, the bounds exclusive.
QUALITIES = ((100, 2000, 0.8), (50, 3000, 0.5))
OTHER_QUALITY = 0.3
HOP_WORDS = ("eventually", "indirectly", "chain", "path", "through", "via")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double; null for a zero vector."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    u, v = wide(a), wide(b)
    return F.try_divide(dot(u, v), F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)))


def vector_top(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The k nearest rows (vec_id, label, score) to one vector, which goes into the plan as a literal."""
    if not query or k < 1:
        raise ValueError("a query vector and a positive k are needed")
    rows = vectors if where is None else vectors.where(where)
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select("vec_id", "label", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


#: Vectors and queries that a block of a search holds, about.
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 50_000
#: Queries, and vectors at most, that are multiplied at once, and the vectors at first.
TILE_QUERIES, TILE_ROWS, FIRST_ROWS = 1_024, 8_192, 64
Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best_of_rows(vectors: np.ndarray, asked: np.ndarray, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> Best:
    """(query, row, score) of the k best rows of `vectors` for each row of `asked`, equal ones in their order; no vector is zero.

    Products in single precision only rule out what can't be among the k best, by a bound of their
    error; the others are computed again in double. More and more rows are taken at once, as the k best so far rule out more.
    """
    lengths = [np.linalg.norm(x, axis=1) for x in (vectors, asked)]
    rough, rough_asked = ((x / n[:, None]).astype(np.float32) for x, n in zip((vectors, asked), lengths))
    # the error of a product, and twice the rounding of a score
    slack = np.float32((vectors.shape[1] + 8) * 2.0**-23 + 2e-6)
    order = np.random.default_rng(0).permutation(len(vectors))
    rough = rough[order]
    parts: list[Best] = []
    for first in range(0, len(asked), TILE_QUERIES):
        tile = rough_asked[first : first + TILE_QUERIES]
        query, row, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        least = np.full((len(tile), 1), -np.inf, dtype=np.float32)
        begin, size = 0, FIRST_ROWS
        while begin < len(order):
            taken = order[begin : begin + size]
            at, column = np.divmod(np.flatnonzero(tile @ rough[begin : begin + size].T >= least), len(taken))
            new, new_query = taken[column], at + first
            open_to = allowed(new_query, new)
            new, new_query = new[open_to], new_query[open_to]
            if len(new):
                products = [np.einsum("ij,ij->i", asked[new_query[i : i + 20_000]], vectors[new[i : i + 20_000]]) for i in range(0, len(new), 20_000)]
                exact = np.concatenate(products) / (lengths[1][new_query] * lengths[0][new])
                exact = np.sign(exact) * np.floor(np.abs(exact) * 1e6 + 0.5) / 1e6
                query, row, score = np.concatenate([query, new_query]), np.concatenate([row, new]), np.concatenate([score, exact])
                best = np.lexsort((row, -score, query))
                query, row, score = query[best], row[best], score[best]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                full = place == k - 1
                least[query[full] - first, 0] = score[full].astype(np.float32) - slack
                query, row, score = query[place < k], row[place < k], score[place < k]
            begin, size = begin + size, min(2 * size, TILE_ROWS)
        parts.append((query, row, score))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _best_of_block(k: int, same: str | None, differ: str | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best rows of a block of vectors for each query of a block of queries."""

    def best(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("vec_id")
        ids, askers = vectors["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        parts: list[Best] = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        if len(ids) and len(askers):
            sides = [np.asarray(list(rows), dtype=np.float64) for rows in (vectors["embedding"], asked["query"])]
            scored = [np.isfinite(n) & (n > 0) for n in (np.linalg.norm(x, axis=1) for x in sides)]
            codes = {c: np.split(pd.factorize(pd.concat([vectors[c], asked[f"asked_{c}"]]), use_na_sentinel=c == same)[0], [len(ids)]) for c in (same, differ) if c}
            barred = lambda query, row: (askers[query] == ids[row]) | ((codes[differ][1][query] == codes[differ][0][row]) if differ else False)
            groups = [(np.arange(len(ids)), np.arange(len(askers)))]
            if same:
                groups = [tuple(np.flatnonzero(side == value) for side in codes[same]) for value in np.intersect1d(*codes[same]) if value >= 0]
            for rows, queries in groups:
                some, whom = rows[scored[0][rows]], queries[scored[1][queries]]
                if len(some) and len(whom):
                    query, row, score = _best_of_rows(sides[0][some], sides[1][whom], lambda q, r, some=some, whom=whom: ~barred(whom[q], some[r]), k)
                    parts.append((whom[query], some[row], score))
                # rows without a score come last, by their ids
                held = np.bincount(parts[-1][0], minlength=len(askers)) if len(some) and len(whom) else np.zeros(len(askers), dtype=np.int64)
                for asker in queries[held[queries] < k]:
                    rest = rows[~scored[0][rows]] if scored[1][asker] else rows
                    rest = rest[~barred(np.full(len(rest), asker), rest)][: k - held[asker]]
                    parts.append((np.full(len(rest), asker), rest, np.full(len(rest), np.nan)))
        query, row, score = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"query_id": askers[query], "vec_id": ids[row], "score": score})

    return best


def vector_top_of_queries(vectors: DataFrame, queries: DataFrame, k: int = 10, same: str | None = None, differ: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, place): the k nearest vectors of each query (query_id, query) among all rows, the query itself excepted.

    Each block of queries meets each block of vectors, and there are the more of both the more rows
    there are; a meeting keeps its k best before they are merged, so what moves on is k rows per query and
    block. `same` names a column that must be equal on both sides, `differ` one that must not. A zero
    vector is nearest to none and has no score.
    """
    columns = [c for c in (same, differ) if c]
    blocks, rounds = (max(1, math.ceil(df.count() / size)) for df, size in ((vectors, BLOCK_ROWS), (queries, BLOCK_QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    sides = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *columns, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).withColumn("turn", every(rounds))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query", *[F.col(c).alias(f"asked_{c}") for c in columns], F.pmod(F.xxhash64("query_id"), F.lit(rounds)).alias("turn")).withColumn("block", every(blocks))
    ship(vectors.sparkSession)
    kept = sides.groupBy("block", "turn").cogroup(asked.groupBy("block", "turn")).applyInPandas(_best_of_block(k, same, differ), "query_id long, vec_id long, score double")
    merged = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("place", merged).where(F.col("place") <= k)


def question_plan(question: Column) -> dict[str, Column]:
    """Columns intent, search_type, entities, multi_hop and max_hops of a question. The words are literal, also those with a dot."""
    low = F.lower(question)
    intent = F.lit("search_functionality")
    for name, words in reversed(INTENT_WORDS):
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        intent = F.when(hit, name).otherwise(intent)
    kind = F.when(intent.isin("explain_implementation", "search_functionality"), "hybrid").when(intent == "find_similar", "vector").otherwise("graph")
    find = lambda pattern: F.regexp_extract_all(question, F.lit(pattern), F.lit(1))
    entities = F.concat(*[find(pattern) for pattern in QUESTION_NAMES])
    hops = F.lit(False)
    for word in HOP_WORDS:
        hops = hops | low.contains(word)
    return {"intent": intent, "search_type": kind, "entities": entities, "multi_hop": hops, "max_hops": F.when(hops, 3).otherwise(1)}


def weight(intent: Column, which: int) -> Column:
    """Weight of graph (0) or vector (1) evidence for an intent."""
    column = F.lit((BASE_GRAPH, BASE_VECTOR)[which])
    for name, pair in INTENT_WEIGHTS.items():
        column = F.when(intent == name, pair[which]).otherwise(column)
    return column


def graph_score(intent: Column, bucket: Column, depth: Column, entity_match: Column, degree: Column, summary: Column, docstring: Column, signature: Column, content: Column) -> Column:
    """Score of a graph result: match by bucket and depth, entity match, relation, centrality and richness of context."""
    there = lambda c, w: F.when(F.coalesce(c, F.lit("")) != "", w).otherwise(0.0)
    match = F.when(bucket.isin("caller", "callee"), F.greatest(F.lit(LEAST_MATCH), 1.0 - STEP * (depth - 1))).otherwise(1.0)
    relation = F.lit(OTHER_RELATION)
    for name, worth in RELATIONS.items():
        relation = F.when(bucket == name, worth).otherwise(relation)
    central = F.least(F.lit(1.0), F.coalesce(degree, F.lit(0)) / FULL_DEGREE)
    context = there(summary, KNOWN["summary"]) + there(docstring, KNOWN["docstring"]) + there(signature, KNOWN["signature"]) + there(content, KNOWN["content"])
    return match * weight(intent, 0) + entity_match * ENTITY_BONUS + relation * RELATION_BONUS + central * CENTRALITY + context * CONTEXT


def vector_score(intent: Column, similarity: Column, entity_match: Column, degree: Column, content_length: Column) -> Column:
    """Score of a vector result: similarity, entity match, centrality and quality by length, whose bounds are exclusive."""
    n = content_length
    quality = F.lit(OTHER_QUALITY)
    for low, high, worth in reversed(QUALITIES):
        quality = F.when((n > low) & (n < high), worth).otherwise(quality)
    quality = F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(quality)
    central = F.least(F.lit(1.0), F.coalesce(degree, F.lit(0)) / FULL_DEGREE)
    return similarity * weight(intent, 1) + entity_match * ENTITY_BONUS + central * CENTRALITY + quality * QUALITY


#: Fixed value: what the merged score of two keeps of each, half of it and a tenth more.
MERGED = 0.5 * 1.1


def merge_scores(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: results in order of `ord` are folded, each later score s giving (score + s) / 2 * 1.1.

    The fold isn't associative, but each score's share of it is known from its place among the
    key's: so places are numbered and shares added up, and no key's rows are held together.
    `source` is hybrid for several, `first_ord` the place of the first.
    """
    whole = Window.partitionBy(*keys)
    placed = results.withColumns({"_place": F.row_number().over(whole.orderBy("ord", "score", "source")), "_n": F.count("*").over(whole)})
    share = F.pow(F.lit(MERGED), F.col("_n") - F.col("_place") + (F.col("_place") > 1).cast("int"))
    first = lambda c: F.max(F.when(F.col("_place") == 1, F.col(c)))
    grouped = placed.groupBy(*keys).agg(F.sum(F.col("score") * share).alias("score"), F.when(F.max("_n") > 1, "hybrid").otherwise(first("source")).alias("source"), first("ord").alias("first_ord"))
    return grouped.select(*keys, "score", "source", "first_ord")


def cap_per_file(ranked: DataFrame, file: list[str], per_file: int = PER_FILE) -> DataFrame:
    """At most `per_file` rows of a file, best first."""
    in_file = F.row_number().over(Window.partitionBy(*file).orderBy(F.desc("score"), F.col("first_ord")))
    return ranked.withColumn("in_file", in_file).where(F.col("in_file") <= per_file).drop("in_file")


def cap_results(ranked: DataFrame, group: list[str], file: str, per_file: int = PER_FILE, total: int = TOTAL) -> DataFrame:
    """At most `per_file` rows of a file and `total` of a group, best first; adds `place`."""
    kept = cap_per_file(ranked, [*group, file], per_file)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.col("first_ord")))
    return kept.withColumn("place", place).where(F.col("place") <= total)


def min_max(rows: DataFrame, score: str, group: str) -> DataFrame:
    """Adds `normalized`, the score between the least and largest of its group; 1 where all are equal."""
    ends = rows.groupBy(group).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    width = F.col("hi") - F.col("lo")
    return rows.join(ends, group).withColumn("normalized", F.when(width == 0, 1.0).otherwise((F.col(score) - F.col("lo")) / width)).drop("lo", "hi")
