"""A growing log file as a streaming source by byte offsets, and payload streams."""

from __future__ import annotations

import os
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Why lines are dropped, in the order in which that is told.
REASONS = ("blank", "malformed", "resolution", "no_features")
PAYLOAD = "resolution string, bar_index long, start_timestamp_ns long, end_timestamp_ns long, features map<string,double>"


#: Bytes of one partition of a backlog.
STEP = 32 << 20


class _Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _TailReader(DataSourceStreamReader):
    """Whole lines between two offsets, at most about ``limit`` bytes a batch; a file that has shrunk is read anew.

    Spark gives no start to ``latestOffset``; the reader keeps the end of the last batch that it planned. A stream that
    is started again plans an empty batch at its place first.
    """

    def __init__(self, path: str, from_end: bool, limit: int | None = None):
        self.path, self.from_end, self.limit, self.at = path, from_end, limit, 0

    def initialOffset(self) -> dict:
        self.at = self._last_line() if self.from_end else 0
        return {"at": self.at}

    def _last_line(self) -> int:
        """Where the last whole line ends."""
        if not os.path.exists(self.path):
            return 0
        with open(self.path, "rb") as f:
            f.seek(0, os.SEEK_END)
            at = f.tell()
            while at > 0:
                step = min(4096, at)
                f.seek(at - step)
                cut = f.read(step).rfind(b"\n")
                if cut >= 0:
                    return at - step + cut + 1
                at -= step
        return 0

    def latestOffset(self) -> dict:
        end = self._last_line()
        start = self.at if self.at <= end else 0
        if self.limit and end - start > self.limit:
            with open(self.path, "rb") as f:  # to the end of the line that the limit falls into
                f.seek(start + self.limit - 1)
                f.readline()
                end = min(end, f.tell())
        return {"at": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Spans of about ``STEP`` bytes that end with a line, read side by side."""
        self.at = end["at"]
        first = start["at"] if start["at"] <= end["at"] else 0
        cuts = [first]
        with open(self.path, "rb") as f:
            for at in range(first + STEP, end["at"], STEP):
                f.seek(at)
                f.readline()
                if cuts[-1] < f.tell() < end["at"]:
                    cuts.append(f.tell())
        return [_Span(a, b) for a, b in pairwise([*cuts, end["at"]]) if b > a]

    def read(self, partition: _Span):
        with open(self.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").option("path", file)``: columns at (byte offset), value.

    ``from`` is start (the default) or end; ``bytes_a_batch`` cuts a backlog into several batches (with the trigger
    ``availableNow`` a start does one of them). Executors open the path themselves: see ``tail_lines``.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "at long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        limit = int(self.options["bytes_a_batch"]) if "bytes_a_batch" in self.options else None
        if limit is not None and limit < 1:
            raise ValueError("bytes_a_batch must be 1 or more")
        return _TailReader(self.options["path"], self.options.get("from", "start") == "end", limit)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)


def tail_lines(spark: SparkSession, path: str, from_end: bool = False, bytes_a_batch: int | None = None, shared: bool = False) -> DataFrame:
    """Lines (at, value) of a growing file. On a cluster all nodes must see the file at ``path``; say so by ``shared``."""
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"executors open {path} themselves: put it where all nodes see it and pass shared=True")
    register(spark)
    reader = spark.readStream.format("log_tail").option("path", path).option("from", "end" if from_end else "start")
    return (reader if bytes_a_batch is None else reader.option("bytes_a_batch", bytes_a_batch)).load()


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Feature payloads from JSON lines as files arrive."""
    return spark.readStream.schema(PAYLOAD).json(folder)


def checked(lines: DataFrame, resolution: str) -> DataFrame:
    """Adds ``p`` (the payload) and ``reason`` (why a line is dropped, or null) to lines (value)."""
    p = F.from_json("value", PAYLOAD)
    rows = lines.withColumn("p", p)
    reason = (
        F.when(F.trim("value") == "", "blank").when(F.col("p").isNull() | F.col("p.resolution").isNull(), "malformed").when(F.col("p.resolution") != resolution, "resolution").when(F.col("p.features").isNull(), "no_features")
    )
    return rows.withColumn("reason", reason)
