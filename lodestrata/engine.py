"""Questions about code answered from the graph and the vectors, as lazy plans."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.models import hash_embeddings
from lodestrata.operators import graph, index, resolve, retrieval
from lodestrata.operators.chunks import chunk_files
from lodestrata.session import local_session, table

#: Which evidence a question's intent asks for; others ask for callers, callees and methods within two steps.
GATHER = {
    "find_callers": ("caller",), "find_usages": ("caller",), "find_callees": ("callee",), "find_call_chain": ("chain",), "find_hierarchy": ("ancestor", "descendant"),
    "find_implementations": ("ancestor", "descendant"), "explain_implementation": ("caller", "callee", "sibling", "method"), "find_dependencies": ("sibling",), "find_dependents": ("sibling",), "find_similar": (),
}
COMPREHENSIVE = ("caller", "callee", "method")
#: In this order evidence is ranked where scores are equal.
BUCKETS = ("primary", "caller", "callee", "ancestor", "descendant", "method", "sibling", "chain")
FUZZY, NEAREST = 10, 20


@dataclass
class Plan:
    question: str
    intent: str
    search_type: str
    entities: list[str]
    multi_hop: bool
    max_hops: int


class QueryEngine:
    """Reads the tables of a folder; each method gives a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, chunks: DataFrame | None = None):
        self.spark, self.folder = spark, folder
        self.entities = table(spark, folder, "code_entities")
        self._index = chunks

    @property
    def chunks(self) -> DataFrame:
        """The index given, or one made of the tables."""
        if self._index is None:
            self._index = index.build_index(chunk_files(table(self.spark, self.folder, "files"), self.entities))
        return self._index

    def plan(self, question: str) -> Plan:
        if not question or not question.strip():
            raise ValueError("a question is needed")
        columns = retrieval.question_plan(F.col("q"))
        row = self.spark.createDataFrame([(question,)], "q string").select(*[c.alias(n) for n, c in columns.items()]).first()
        return Plan(question, row.intent, row.search_type, list(row.entities), row.multi_hop, row.max_hops)

    def primary(self, plan: Plan) -> DataFrame:
        """(project, qn, label, file_path) of the entities that the question names, by name or qualified name; if there are none, of the nearest ones that contain a name."""
        known = graph.nodes(self.entities)
        exact = known.where(F.col("name").isin(plan.entities or [""]) | F.col("qn").isin(plan.entities or [""])).select("project", "qn", "label", "file_path")
        if not plan.entities or not exact.isEmpty():
            return exact
        words = self.spark.createDataFrame([(name,) for name in plan.entities], "word string")
        best = graph.name_search(self.entities, words).orderBy("match_score", "name", "qn").limit(FUZZY)
        return best.select("project", "qn").distinct().join(known.select("project", "qn", "label", "file_path"), ["project", "qn"])

    def gather(self, plan: Plan, found: DataFrame) -> DataFrame:
        """(project, qn, bucket, depth) of what the intent asks for about the entities found."""
        wanted = GATHER.get(plan.intent, COMPREHENSIVE)
        hops = plan.max_hops if plan.multi_hop else 1
        hops = hops if plan.intent in GATHER else 2
        calls = graph.call_edges(self.entities)
        known = graph.nodes(self.entities)
        zero = F.lit(0)
        rows = [found.select("project", "qn", F.lit("primary").alias("bucket"), zero.alias("depth"))]
        of = lambda df, bucket: df.select("project", F.col("reached").alias("qn"), F.lit(bucket).alias("bucket"), "depth")
        if "caller" in wanted:
            rows.append(of(graph.reach(calls, found, hops, forward=False), "caller"))
        if "callee" in wanted:
            rows.append(of(graph.reach(calls, found, hops), "callee"))
        if "ancestor" in wanted:
            extends = graph.extends_edges(self.entities)
            rows += [of(graph.reach(extends, found, 5), "ancestor"), of(graph.reach(extends, found, 5, forward=False), "descendant")]
            rows.append(of(graph.reach(calls, found.where("label not in ('Class', 'Interface')"), hops, forward=False), "caller"))
        if "method" in wanted:
            owned = known.where("label = 'Method'").select("project", F.regexp_extract("qn", r"(?s)^(.*)\.", 1).alias("owner"), F.col("qn").alias("reached"))
            rows.append(of(owned.join(found.select("project", F.col("qn").alias("owner")), ["project", "owner"], "left_semi").withColumn("depth", F.lit(1)), "method"))
        if "sibling" in wanted:
            beside = known.select("project", "file_path", F.col("qn").alias("reached")).join(found.select("project", "file_path").distinct(), ["project", "file_path"], "left_semi")
            rows.append(of(beside.join(found.select("project", F.col("qn").alias("reached")), ["project", "reached"], "left_anti").withColumn("depth", F.lit(1)), "sibling"))
        if "chain" in wanted and len(plan.entities) > 1:
            rows.append(self.chain(plan.entities[0], plan.entities[1]))
        every = reduce(DataFrame.unionByName, rows)
        order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
        return every.groupBy("project", "qn").agg(F.min(F.struct(order.alias("o"), "bucket", "depth")).alias("b")).select("project", "qn", "b.bucket", "b.depth")

    def chain(self, source: str, target: str, hops: int = 10) -> DataFrame:
        """(project, qn, bucket, depth) of what lies on the shortest call chains from one named entity to another."""
        known = graph.nodes(self.entities)
        named = lambda word, column: known.where((F.col("name") == word) | (F.col("qn") == word)).select("project", F.col("qn").alias(column))
        ways = graph.shortest_paths(graph.call_edges(self.entities), hops).join(named(source, "origin"), ["project", "origin"], "left_semi").join(named(target, "reached"), ["project", "reached"], "left_semi")
        steps = ways.select("project", F.posexplode(F.split("route", ">")).alias("depth", "qn"))
        return steps.groupBy("project", "qn").agg(F.min("depth").alias("depth")).select("project", "qn", F.lit("chain").alias("bucket"), "depth")

    def evidence(self, plan: Plan) -> DataFrame:
        """(project, qn, file_path, score, source, ord) of graph and vector evidence."""
        found = self.primary(plan)
        nodes = graph.nodes(self.entities).select("project", "qn", "file_path", "docstring", "signature")
        degrees = graph.centrality(graph.call_edges(self.entities)).select("project", "qn", "total_degree")
        texts = self.entities.select(F.col("project_name").alias("project"), F.col("qualified_name").alias("qn"), "code").groupBy("project", "qn").agg(F.min("code").alias("code"))
        rows = self.gather(plan, found).join(nodes, ["project", "qn"]).join(degrees, ["project", "qn"], "left").join(texts, ["project", "qn"], "left")
        intent = F.lit(plan.intent)
        match = F.when(F.col("bucket") == "primary", 1.0).otherwise(0.0)
        scored = rows.withColumn("score", retrieval.graph_score(intent, F.col("bucket"), F.col("depth"), match, F.col("total_degree"), F.lit(None), F.col("docstring"), F.col("signature"), F.col("code")))
        place = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
        graph_side = scored.select("project", "qn", "file_path", "score", F.lit("graph").alias("source"), F.concat_ws(":", place, F.lpad(F.col("depth").cast("string"), 2, "0"), "qn").alias("ord"))
        if plan.search_type == "graph" and not found.isEmpty():
            return graph_side
        return graph_side.unionByName(self.nearest(plan, degrees))

    def nearest(self, plan: Plan, degrees: DataFrame, k: int = NEAREST) -> DataFrame:
        """The k chunks of entities nearest to the question, as evidence."""
        near = index.search_index(self.chunks.where("graph_node_id is not null"), hash_embeddings([plan.question])[0].tolist(), k)
        rows = near.select(F.col("project_name").alias("project"), F.col("graph_node_id").alias("qn"), "file_path", "score", F.length("content").alias("n")).join(degrees, ["project", "qn"], "left")
        match = F.when(F.substring_index("qn", ".", -1).isin(plan.entities or [""]) | F.col("qn").isin(plan.entities or [""]), 1.0).otherwise(0.0)
        weighed = retrieval.vector_score(F.lit(plan.intent), F.col("score"), match, F.col("total_degree"), F.col("n"))
        return rows.select("project", "qn", "file_path", weighed.alias("score"), F.lit("vector").alias("source"), F.concat_ws(":", F.lit("9"), "qn").alias("ord"))

    def search(self, question: str, limit: int = 15) -> DataFrame:
        """(project, qn, file_path, source, score) of the best entities for a question: evidence merged by entity, at most five a file, best first."""
        merged = retrieval.merge_scores(self.evidence(self.plan(question)), ["project", "qn", "file_path"])
        capped = retrieval.cap_per_file(merged, ["project", "file_path"])
        best = capped.orderBy(F.desc("score"), "first_ord", "qn").limit(limit)
        return best.select("project", "qn", "file_path", "source", F.round("score", 6).alias("score"))

    def context(self, question: str, limit: int = 15) -> DataFrame:
        """`search`, each entity with its signature, documentation, callers and callees, to be read by a model or a person."""
        known = graph.nodes(self.entities).select("project", "qn", "signature", "docstring", "start_line", "end_line")
        around = graph.implementation_context(self.entities).select("project", "qn", "callers", "callees")
        return self.search(question, limit).join(known, ["project", "qn"]).join(around, ["project", "qn"], "left").orderBy(F.desc("score"), "qn")

    def calls(self) -> DataFrame:
        """All calls of the entities, resolved."""
        return resolve.resolve_calls(self.entities, table(self.spark, self.folder, "imports"), resolve.annotated_parameters(self.entities))

    def statistics(self) -> DataFrame:
        return graph.nodes(self.entities).groupBy("label").agg(F.count("*").alias("n"))


def main(arguments: list[str]) -> None:
    """search FOLDER QUESTION | context FOLDER QUESTION | status FOLDER"""
    command, folder, *rest = arguments
    engine = QueryEngine(local_session(), folder)
    shown = {"search": lambda: engine.search(" ".join(rest)), "context": lambda: engine.context(" ".join(rest)), "status": engine.statistics}[command]()
    shown.show(50, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
