"""Logs to feature and label files, at once or as files arrive."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import without_existing
from ..operators.bars import bars
from ..operators.book import market_events
from ..operators.features import core_features
from ..operators.labels import distribution, label_targets
from ..schemas import LEVELS, SECONDS, TARGETS, TICK
from ..session import written
from ..sources import files, logs


def resolution_plan(names: str | list[str], levels: int | None = None) -> dict[str, int]:
    """Resolutions of a comma list or list, each once, in their order, with book levels; none means the fastest."""
    wanted = [n.strip().lower() for n in (names.split(",") if isinstance(names, str) else names)]
    wanted = list(dict.fromkeys(n for n in wanted if n)) or ["fast"]
    if unknown := [n for n in wanted if n not in SECONDS]:
        raise ValueError(f"unknown resolutions: {unknown}")
    return {n: max(1, LEVELS if levels is None else levels) for n in wanted}


def feature_rows(events: DataFrame, resolution: str, tick: float = TICK) -> DataFrame:
    return core_features(bars(events, SECONDS[resolution]), tick)


def mid_series(events: DataFrame) -> DataFrame:
    """Quotes as label anchors."""
    return events.where("kind = 'quote'").select("stem", "seq", "ts_ns", F.col("mid").alias("price"))


def preprocess(rows: DataFrame, out: str, resolutions: tuple[str, ...] = ("fast", "mid", "slow"), targets: dict = TARGETS, tick: float = TICK, levels: int = LEVELS, skip_existing: bool = False, dry_run: bool = False, mode: str = "append") -> None:
    """Write ``out``/features and ``out``/labels of parsed log rows (see ``logs.parse``).

    Events feed every resolution and the labels, so they are written once and read by each, all side by side: none waits
    for the last tasks of another. ``skip_existing``
    leaves out stems that have all of their outputs and makes all of any others again in their place;
    ``dry_run`` computes all and writes no output. ``mode`` is append, or replace: rows of a stem's folder give way
    to new ones.
    """
    spark = rows.sparkSession
    if skip_existing:
        mode = "replace"
        done = files.finished_stems(spark, f"{out}/features", f"{out}/labels", resolutions)
        if done is not None:
            rows = without_existing(rows, written(done, "finished"), ["stem"])
    events = written(market_events(rows, levels), "events")

    def features(resolution: str) -> None:
        made = feature_rows(events, resolution, tick)
        files.dry_run(made) if dry_run else files.write_features(made, f"{out}/features", resolution, mode)

    def labels() -> None:
        made = label_targets(mid_series(events), targets, tick)
        files.dry_run(made) if dry_run else files.write_labels(made, f"{out}/labels", mode)

    target = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(resolutions) + 1) as pool:
        running = [pool.submit(target(features), r) for r in dict.fromkeys(resolutions)] + [pool.submit(target(labels))]
    for r in running:
        r.result()


def label_report(spark: SparkSession, out: str, targets: dict = TARGETS) -> DataFrame:
    return distribution(spark.read.parquet(f"{out}/labels"), [f"outcome_{t}" for t in targets])


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, **options):
    """Preprocess log files as they arrive, each once; returns the started query.

    A file is a stem and is whole when it appears, so each micro-batch is a batch run over its files; the
    stream's checkpoint says which are done. A batch that is run again after a failure replaces what it
    wrote, so each stem's rows are there exactly once.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").text(folder)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    placed = lines.select(stem.alias("stem"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batch: DataFrame, number: int) -> None:
        ordered = batch.withColumn("seq", F.struct("block", F.monotonically_increasing_id().alias("line"))).drop("block")
        preprocess(logs.parse(ordered), out, **{"mode": "replace", **options})

    return placed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
