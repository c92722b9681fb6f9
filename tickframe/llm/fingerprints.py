"""Document fingerprints: a canonical exact digest.

A text is normalised (NFKC), case-folded, normalised again and its white space folded to single blanks;
the fingerprint is the 128-bit xxh3 of its UTF-8. It tells equal from unequal and nothing between, so a
likeness is 1.0 or 0.0. Groups are made by digest and confirmed by comparing bytes with the bucket's
first document; a bucket is never gathered in one place.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize, small_batches, text_bytes
from .ordered import in_ranges, text_key


def canonical(text: str | None) -> bytes:
    text = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(unicodedata.normalize("NFKC", text).split()).encode()


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _digests(batches):
    for batch in batches:
        prints = [digest(canonical(t)) for t in column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "h"), pa.array(prints, pa.string())], ["doc_id", "h", "fingerprint"])


_COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, packed binary"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary()]


def compared(text: str, following: str, doubtful: bool, press: zstandard.ZstdCompressor) -> tuple:
    """Everything but its id about a text and its successor; a doubtful text also brings its canonical bytes, compressed."""
    new = edited(text, following)
    own, its, next_ = canonical(text), canonical(new), canonical(following)
    a, b, c = digest(own), digest(its), digest(next_)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, float(a == b and own == its), float(a == c and own == next_), press.compress(own) if doubtful else None


def _compare(batches):
    """Rows of one range in order, marks of doubtful texts before the texts they speak of.

    A row's successor may lie in the next batch, so one row always waits. What waits at the end of the
    range leaves as its last text, and the range's first text leaves too: ``_seams`` joins them.
    """
    part, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
    waiting, mark, first = None, None, True
    for batch in batches:
        rows, ids, seams = [], [], []
        named = column(batch, "doc_id")
        for i, (h, is_mark, text) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("h", "is_mark", "text")))):
            key = (named[i].as_py(), h)
            if is_mark:
                mark = key
                continue
            text = text or ""
            if waiting is not None:
                ids.append(waiting[0])
                rows.append(compared(waiting[1], text, waiting[2], press))
            waiting = (key[0], text, key == mark)
            if first:
                seams.append((True, None, text, False))
                first = False
        yield _batch(part, ids, rows, seams, named.type)
        last = named.type
    if waiting is not None:
        yield _batch(part, [], [], [(False, waiting[0], waiting[1], waiting[2])], last)


def _batch(part: int, ids: list, rows: list[tuple], seams: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Finished rows, then seams (is_first, doc_id, text, doubtful)."""
    n, m = len(rows), len(seams)
    columns = [pa.array([r[i] for r in rows] + [None] * m, t) for i, t in enumerate(_TYPES)]
    seam = [pa.array([None] * n + [s[i] for s in seams], t) for i, t in ((0, pa.bool_()), (2, pa.string()), (3, pa.bool_()))]
    names = ["part", "doc_id", *(f.split()[0] for f in _COMPARED.split(", ")), "is_first", "text", "doubtful"]
    return pa.RecordBatch.from_arrays([pa.array([part] * (n + m), pa.int32()), pa.array(ids + [s[1] for s in seams], kind), *columns, *seam], names)


def _join_seams(batches):
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        rows = [compared(t, n, d, press) for t, n, d in zip(*(column(batch, c).to_pylist() for c in ("text", "following", "doubtful")))]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES))], ["doc_id", *(f.split()[0] for f in _COMPARED.split(", "))])


def _seams(rows: DataFrame, kind: str) -> DataFrame:
    """The last row of each range with the first text of the next one that has any, the last range's with the first's."""
    first = rows.where("is_first").select("part", F.col("text").alias("following"))
    # part numbers alone meet in one place, one a range
    follows = first.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("then"))
    last = rows.where("not is_first").select("part", "doc_id", "text", "doubtful").join(follows, "part")
    joined = last.join(first.withColumnRenamed("part", "then"), "then").select("doc_id", "text", "following", "doubtful")
    return joined.mapInArrow(_join_seams, f"doc_id {kind}, {_COMPARED}")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, their likenesses, and groups of equal canonical texts.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id (least
    doc_id of the group), n_copies. Documents follow each other by ascending doc_id (of any type that has an
    order), null ids first, equal ids by the xxhash64 of their text, and the last by the first; a single
    document is followed by itself. Null texts count as empty. Only texts whose digest is met twice are
    moved for comparison: equal bytes compress to equal bytes, and a digest that unequal bytes share would
    split into groups by SHA-256. Repeated rows are copies; a group of null ids only has a null group_id. An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_key().alias("h"), "text")
    met = materialize(source.mapInArrow(_digests, f"doc_id {kind}, h long, fingerprint string"), "digests")
    twice = met.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    marks = materialize(met.join(twice, "fingerprint").select("doc_id", "h").distinct(), "doubtful")
    both = source.select("doc_id", "h", F.lit(False).alias("is_mark"), "text").union(marks.select("doc_id", "h", F.lit(True), F.lit(None).cast("string")))
    dealt = in_ranges(both.withColumn("turn", ~F.col("is_mark")), text_bytes(source), "turn").select("doc_id", "h", "is_mark", "text")
    rows = materialize(dealt.mapInArrow(_compare, f"part int, doc_id {kind}, {_COMPARED}, is_first boolean, text string, doubtful boolean"), "fingerprints")
    names = ["doc_id", *(f.split()[0] for f in _COMPARED.split(", "))]
    rows = materialize(rows.where("is_first is null").select(names).union(_seams(rows, kind).select(names)), "compared")
    doubtful = rows.where(F.col("packed").isNotNull()).select("fingerprint", "doc_id", "packed")
    # Both are written: a join whose sides are bare exchanges, and counts pre-aggregated apart from it, leave no large group to one task.
    first = materialize(doubtful.groupBy("fingerprint").agg(F.min_by("packed", "doc_id").alias("first")), "firsts")
    same = F.coalesce(F.col("packed") == F.col("first"), F.lit(False))
    variant = F.when(F.col("packed").isNotNull(), F.when(same, "").otherwise(F.sha2("packed", 256)))
    rows = materialize(rows.join(first, "fingerprint", "left").withColumn("variant", variant).drop("packed", "first"), "variants")
    groups = rows.where(F.col("variant").isNotNull()).groupBy("fingerprint", "variant").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    rows = rows.join(materialize(groups, "groups"), ["fingerprint", "variant"], "left")
    order = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.select(*order, F.when(F.col("variant").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
