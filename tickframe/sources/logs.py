"""Order-book and trade logs: discovery, reading in line order, parsing, and the reverse.

``L2;side;YYYYMMDDhhmmss;100 ns;op;level;maker;price;size`` and ``L1;side;YYYYMMDDhhmmss;100 ns;price;size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUT_OF_RANGE = 2**31 - 1


def number(x: Column) -> Column:
    """Decimal comma or point; empty is 0."""
    text = F.replace(F.trim(x), F.lit(","), F.lit("."))
    return F.when(text == "", 0.0).otherwise(text.try_cast("double"))


def timestamp_ns(stamp: Column, offset: Column) -> Column:
    seconds = F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))
    ticks = F.when(F.coalesce(F.trim(offset), F.lit("")) == "", F.lit(0)).otherwise(F.trim(offset).try_cast("bigint"))
    return seconds * 1_000_000_000 + ticks * 100


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """stem, seq, value: lines of one file, or of all .csv files below a folder, in their order within each file."""
    reader = spark.read
    if not path.lower().endswith((".csv", ".txt", ".log")):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]")
    lines = reader.text(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    # Ids rise with the partition and the line; splits of one file come in order of their offsets.
    return lines.select(stem.alias("stem"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value").withColumn(
        "seq", F.struct("block", "line")
    )


def parse(lines: DataFrame, strict: bool = False, seq: str = "seq") -> DataFrame:
    """stem, seq, ts_ns, kind, side, op, lvl, price, size of (stem, seq, value).

    Blank lines, other kinds and depth lines of another side are left out. An unknown operation is an
    update and a level that is no number is out of range. A malformed number or time fails the job if
    ``strict``, else drops its line.
    """
    f = F.split(F.trim("value"), ";")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    rows = lines.where(F.trim("value") != "").withColumn("kind", at(0)).where(F.col("kind").isin("L1", "L2"))
    depth = F.col("kind") == "L2"
    side = F.when(at(1) == "0", "ask").when(at(1) == "1", "bid")
    rows = rows.where(~depth | side.isNotNull())
    level = F.coalesce(at(5).try_cast("int"), F.lit(OUT_OF_RANGE))
    out = rows.select(
        "stem",
        F.col(seq).alias("seq"),
        timestamp_ns(at(2), at(3)).alias("ts_ns"),
        "kind",
        side.alias("side"),
        F.when(depth, F.when(at(4) == "0", "add").when(at(4) == "2", "remove").otherwise("update")).alias("op"),
        F.when(depth, F.when(level < 0, OUT_OF_RANGE).otherwise(level)).cast("int").alias("lvl"),
        number(F.when(depth, at(7)).otherwise(at(4))).alias("price"),
        number(F.when(depth, at(8)).otherwise(at(5))).alias("size"),
        "value",
    )
    bad = F.col("ts_ns").isNull() | F.col("price").isNull() | F.col("size").isNull()
    if strict:
        return out.withColumn("ts_ns", F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), "value")).cast("bigint")).otherwise(F.col("ts_ns"))).drop("value")
    return out.where(~bad).drop("value")


def format_lines(rows: DataFrame) -> DataFrame:
    """The log line of each row, decimal commas and all."""
    stamp = F.date_format(F.timestamp_seconds(F.expr("ts_ns div 1000000000")), "yyyyMMddHHmmss")
    offset = F.expr("(ts_ns % 1000000000) div 100").cast("string")
    side = F.when(F.col("side") == "ask", "0").when(F.col("side") == "bid", "1").otherwise("")
    comma = lambda c: F.replace(F.format_string("%.4f", F.col(c)), F.lit("."), F.lit(","))
    op = F.when(F.col("op") == "add", "0").when(F.col("op") == "remove", "2").otherwise("1")
    depth = F.concat_ws(";", F.lit("L2"), side, stamp, offset, op, F.col("lvl").cast("string"), F.lit(""), comma("price"), comma("size"))
    trade = F.concat_ws(";", F.lit("L1"), side, stamp, offset, comma("price"), comma("size"))
    return rows.select("stem", "seq", F.when(F.col("kind") == "L2", depth).otherwise(trade).alias("value"))
