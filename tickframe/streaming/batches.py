"""Sinks that keep a record of each batch: what was taken and why not, and the latest row of each key.

A batch writes folders of its own number, then its commit record. A batch that is run again replaces its folders, and
readers see committed batches only, so a row is there once whatever fails.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import removed

_COMMIT = "batch long, rows long"


def _put(rows: DataFrame, folder: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def _commit(spark: SparkSession, out: str, number: int, rows: int) -> None:
    spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").json(f"{out}/commits/batch={number}")


def commits(spark: SparkSession, out: str) -> DataFrame:
    """batch and rows of the batches that are whole."""
    try:
        return spark.read.schema("rows long, batch long").json(f"{out}/commits").select("batch", "rows")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _COMMIT)
        raise


def committed(spark: SparkSession, out: str, part: str, schema) -> DataFrame:
    """``part`` (rows or reasons) of all whole batches, with batch."""
    rows = spark.read.schema(schema).parquet(f"{out}/{part}").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(commits(spark, out).select("batch"), "batch", "left_semi")


def take(lines: DataFrame, out: str, reasons: Iterable[str], reason: str = "reason"):
    """Write the streaming rows whose ``reason`` is null to ``out``/rows and the counts of each reason to ``out``/reasons (reason, n); returns a stream writer.

    Counts are observed while rows are written: no second pass. Rows taken count as ``taken`` and reasons that aren't
    in ``reasons`` as ``other``. No shuffle may lie between the source and here, or a stage that is run again counts twice.
    """
    named = list(dict.fromkeys(reasons))
    if clash := {"taken", "other"} & set(named):
        raise ValueError(f"reasons may not be named {sorted(clash)}")

    def run(batch: DataFrame, number: int) -> None:
        spark, seen, r = batch.sparkSession, Observation(), F.col(reason)
        counts = [F.count_if(r == x).alias(f"r{i}") for i, x in enumerate(named)]
        marked = batch.observe(seen, F.count("*").alias("all"), F.count_if(r.isNull()).alias("taken"), *counts)
        _put(marked.where(r.isNull()).drop(reason), f"{out}/rows", number)
        found = seen.get
        table = {"taken": found["taken"], **{x: found[f"r{i}"] for i, x in enumerate(named)}}
        table["other"] = found["all"] - sum(table.values())
        _put(spark.createDataFrame([(x, n) for x, n in table.items() if n], "reason string, n long").coalesce(1), f"{out}/reasons", number)
        _commit(spark, out, number, table["taken"])

    return lines.writeStream.foreachBatch(run)


def drop_reasons(spark: SparkSession, out: str) -> DataFrame:
    """reason and n over all whole batches of ``take``."""
    return committed(spark, out, "reasons", "reason string, n long, batch long").groupBy("reason").agg(F.sum("n").alias("n"))


def keep_latest(rows: DataFrame, out: str, keys: tuple[str, ...], order: tuple[str, ...], kept: int = 2):
    """Keep the row of the greatest ``order`` of each key over the whole stream; returns a stream writer.

    A batch merges its rows with the last whole snapshot and writes the next one, a row a key. Only the last ``kept``
    snapshots (two or more: the one before is what a batch that is run again reads) and their records stay. Rows that
    are alike in key and order are told apart by their other columns, so a rerun chooses the same.
    """
    if kept < 2:
        raise ValueError("a batch that is run again needs the snapshot before it: keep two or more")
    rest = [c for c in rows.columns if c not in keys]
    schema = rows.schema

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        whole = sorted(r.batch for r in commits(spark, out).collect())  # at most kept + 1 of them
        before = [n for n in whole if n < number]
        if before:
            batch = batch.unionByName(spark.read.schema(schema).parquet(f"{out}/state/batch={before[-1]}"))
        best = F.max_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order)))
        seen = Observation()
        _put(batch.groupBy(*keys).agg(best.alias("_")).select(*keys, "_.*").select(*rows.columns).observe(seen, F.count("*").alias("n")), f"{out}/state", number)
        _commit(spark, out, number, seen.get["n"])
        for old in [*before, number][:-kept]:
            removed(spark, f"{out}/commits/batch={old}", f"{out}/state/batch={old}")

    return rows.writeStream.foreachBatch(run)


def latest(spark: SparkSession, out: str, schema) -> DataFrame:
    """The last whole snapshot of ``keep_latest``; no rows before the first."""
    last = commits(spark, out).agg(F.max("batch")).first()[0]
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{out}/state/batch={last}")
