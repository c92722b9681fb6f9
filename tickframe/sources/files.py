"""Feature and label files: reading, writing, resuming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES


def _write(rows: DataFrame, path: str, mode: str, *folders: str) -> None:
    """``replace`` puts new rows in the place of those of the same folders, so writing twice is writing once."""
    writer = rows.write.partitionBy(*folders)
    writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if mode == "replace" else writer.mode(mode)
    writer.parquet(path)


def write_features(rows: DataFrame, path: str, resolution: str, mode: str = "append") -> None:
    """``resolution=.../stem=...`` folders of the 64 columns; resolutions may be written side by side."""
    _write(rows.select("stem", *FEATURES), f"{path}/resolution={resolution}", mode, "stem")


def read_features(spark: SparkSession, path: str, resolution: str, columns: list[str], stems: list[str] | None = None) -> DataFrame:
    """Asked-for columns, each once, of one resolution: folders and columns are pruned by the scan."""
    rows = spark.read.parquet(path).where(F.col("resolution") == resolution)
    if stems is not None:
        rows = rows.where(F.col("stem").cast("string").isin(stems))
    return rows.select(F.col("stem").cast("string").alias("stem"), *dict.fromkeys(["start_timestamp_ns", *columns]))


def write_labels(labels: DataFrame, path: str, mode: str = "append") -> None:
    _write(labels, path, mode, "stem")


def write_json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def dry_run(rows: DataFrame) -> None:
    """Compute everything, write nothing."""
    rows.write.format("noop").mode("overwrite").save()


def existing_stems(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("stem").cast("string").alias("stem")).distinct()


def finished_stems(spark: SparkSession, features: str, labels: str, resolutions: tuple[str, ...]) -> DataFrame | None:
    """Stems that have features of every resolution and labels; None where either folder is still missing."""
    try:
        made = spark.read.parquet(features).where(F.col("resolution").isin(*resolutions)).select(F.col("stem").cast("string").alias("stem"), "resolution").distinct()
        whole = made.groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") == len(set(resolutions))).select("stem")
        return whole.join(existing_stems(spark, labels), "stem", "left_semi")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_state(states: DataFrame) -> DataFrame:
    """The scaler state of the greatest stem of each channel, whatever order the stems were finished in."""
    rest = [c for c in states.columns if c != "channel"]
    return states.groupBy("channel").agg(F.max_by(F.struct(*rest), "stem").alias("s")).select("channel", "s.*")


def small_files(spark: SparkSession, path: str, least_bytes: int = 10 * 1024) -> DataFrame:
    """Files below a size: reported, not removed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return found.where(F.col("length") < least_bytes)
