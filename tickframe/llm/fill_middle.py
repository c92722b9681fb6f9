"""Fill-in-middle: a text's units are cut into prefix, middle and suffix, and the middle moves to the end.

The tokenizers library's ``Split`` pre-tokenizer cuts a text by a regex into isolated matches and tells
their places in code points; nothing is trained. The number of matches is n, and the ends of two matches,
ranked by a hash of the row's id, bound the middle. Every row is made by itself: one narrow pass.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, small_batches

#: Units of a text: its lines, each with its end.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
MADE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@lru_cache
def _splitter(pattern: str):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), "isolated")


def unit_ends(text: str, pattern: str = LINES) -> list[int]:
    """Where each unit ends, in code points."""
    return [end for _, (_, end) in _splitter(pattern).pre_tokenize_str(text)] if text else []


def rearranged(text: str, ranks: tuple[int, int, int, int], pattern: str = LINES, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix length, middle length, output) of a text; ``ranks`` choose both cuts, whether and how to move."""
    ends = unit_ends(text, pattern)
    n = len(ends)
    if not text or ranks[2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((ranks[0] % (n + 1), ranks[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    spm = ranks[3] % 100 < spm_rate
    return n, "spm" if spm else "psm", a, b - a, (suffix + prefix if spm else prefix + suffix) + middle


def _ranks(key: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def _rows(pattern: str, rate: int, spm_rate: int):
    def rows(batches):
        for batch in batches:
            ranks = zip(*(column(batch, f"_h{i}").to_pylist() for i in range(4)))
            made = [rearranged(t or "", h, pattern, rate, spm_rate) for t, h in zip(column(batch, "text").to_pylist(), ranks)]
            names, kinds = ("n", "form", "prefix_chars", "middle_chars", "output"), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*made) if made else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *columns], ["doc_id", *names])

    return rows


def fill_in_middle(docs: DataFrame, seed: int = SEED, pattern: str = LINES, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every whole text; one row for each input row.

    ``rate`` of 100 rows are rearranged and ``spm_rate`` of 100 of these put the suffix first (``spm``), the others
    the prefix (``psm``). A null text counts as empty; empty texts and texts that hold one of the three marks stay
    as they are (``plain``, lengths null), so an output can always be undone. Cuts depend on the id alone: rows of one id
    are cut at the same ranks, and a null id counts as an empty one. Ids of any type are taken as text. Columns other than
    doc_id and text are left aside; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text", *(h.alias(f"_h{i}") for i, h in enumerate(_ranks(F.col("doc_id"), seed))))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(MADE).fields])
    return source.mapInArrow(_rows(pattern, rate, spm_rate), schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of: no text holds a mark, so marks part the output into its pieces."""
    pieces = F.split(F.col(output), "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    order = lambda *at: F.concat(*(pieces[i] for i in at))
    return F.when(F.col(form) == "psm", order(1, 3, 2)).when(F.col(form) == "spm", order(2, 3, 1)).otherwise(F.col(output))


def fill_digests(docs: DataFrame, **options) -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the text rebuilt from it in place of the output."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_in_middle(docs, **options)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))
