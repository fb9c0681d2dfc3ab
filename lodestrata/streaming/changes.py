"""Change streams applied to tables of current states.

Actions come as a stream; each micro-batch keeps the last action of a key and replaces the rows of
the keys it touches. A state is parted by the hash of its key, and only parts that are touched are
written again, as parts of the batch's version. What is current is read from the folder alone, so
a stream that starts again goes on from where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.tables import last_of

COLUMNS = ("key", "ts", "action", "payload")
PARTS = 16
#: Extensions that are indexed, and names of folders and files that aren't.
EXTENSIONS = ("py", "js", "jsx", "ts", "tsx")
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".egg-info")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class State:
    """A table in `folder`, keyed by `key`, of which batches replace the rows of some keys."""

    def __init__(self, spark: SparkSession, folder: str, key: str, parts: int = PARTS):
        self.spark, self.folder, self.key, self.parts = spark, folder, key, parts

    def current(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows after all versions, or all before one, of some parts or all; None if nothing was written."""
        if not _exists(self.spark, f"{self.folder}/done"):
            return None
        done = self.spark.read.parquet(f"{self.folder}/done")
        done = done if before is None else done.where(F.col("version") < before)
        newest = done.groupBy("part").agg(F.max("version").alias("version")).collect()
        paths = [f"{self.folder}/rows/version={r.version}/part={r.part}" for r in newest if only is None or r.part in only]
        paths = [path for path in paths if _exists(self.spark, path)]
        return self.spark.read.parquet(*paths) if paths else None

    def replace(self, version: int, touched: DataFrame, rows: DataFrame) -> None:
        """Writes a version in which the touched keys have `rows` and no others; the same version again has the same outcome."""
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        keys = touched.select(self.key).distinct()
        parts = [r[0] for r in keys.select(part).distinct().collect()]
        if not parts:
            return
        old = self.current(version, parts)
        new = rows.select(*(old.columns if old is not None else rows.columns))
        if old is not None:
            new = old.join(keys, self.key, "left_anti").select(*old.columns).unionByName(new)
        new.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/rows/version={version}")
        marks = self.spark.createDataFrame([(p,) for p in parts], "part int")
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/version={version}")


def _run(stream: DataFrame, folder: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream to its present end; its progress lies in `folder`."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def run_changes(actions: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of actions (key, ts, action, payload) to its present end and gives the rows that are there.

    `changed` puts a row in, `deleted` takes it out; of a key's rows the last by ts and payload
    counts, and deletions stay as marks, so that late older rows don't undo them. `folder` is
    shared by all workers and holds state and progress.
    """
    state = State(actions.sparkSession, f"{folder}/state", "key")

    def apply(batch: DataFrame, number: int) -> None:
        new = batch.select(*COLUMNS)
        old = state.current(number)
        both = new if old is None else new.unionByName(old.join(new.select("key").distinct(), "key", "left_semi").select(*COLUMNS))
        state.replace(number, new, last_of(both, ["key"], [F.desc("ts"), F.desc("payload")]))

    _run(actions, folder, apply)
    rows = state.current()
    if rows is None:
        rows = actions.sparkSession.createDataFrame([], actions.select(*COLUMNS).schema)
    return rows.where("action = 'changed'").select("key", "ts", "payload")


def relevant(files: DataFrame) -> DataFrame:
    """Rows whose path has an extension that is indexed and no part that is ignored."""
    parts = F.split(F.coalesce("relative_path", "path"), r"[/\\]")
    known = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*EXTENSIONS)
    return files.where(known & ~F.exists(parts, lambda part: part.isin(*IGNORED) | F.endswith(part, F.lit(".egg-info"))))


def run_index(files: DataFrame, folder: str, extract: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame | None]:
    """Keeps what is made of files current: a stream of files (path, content, content_hash, ingested_at, ...) gives the tables `files` and `rows`.

    Of a batch the last row of a path counts. A path whose content is null is gone, one whose hash is
    the one already indexed is left alone; of all others the rows are made anew by `extract`
    (path, ...) and replace those of before, so that nothing of an older content stays.
    """
    spark = files.sparkSession
    known, made = State(spark, f"{folder}/files", "path"), State(spark, f"{folder}/rows", "path")

    def apply(batch: DataFrame, number: int) -> None:
        last = last_of(relevant(batch), ["path"], [F.desc("ingested_at"), F.desc("content_hash")]).persist()
        old = known.current(number)
        fresh = last
        if old is not None:
            same = old.select("path", "content_hash").where("content_hash is not null")
            fresh = last.where("content is null").unionByName(last.where("content is not null").join(same, ["path", "content_hash"], "left_anti").select(*last.columns))
        fresh = fresh.persist()
        kept = fresh.where("content is not null")
        made.replace(number, fresh, extract(kept))
        known.replace(number, fresh, kept.drop("content"))
        fresh.unpersist()
        last.unpersist()

    _run(files, folder, apply)
    return {"files": known.current(), "rows": made.current()}
