"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: a leaf covers up to ``LEAF`` pre-tokens and holds
their code points, bytes and tokens, an inner node its subtree's sums. ``token_trees`` makes the trees,
``edited`` applies edits to texts and the trees stored with them, as often as there are edits. Where one
pre-token ends and the next begins depends on a few characters only, so an edit is answered by
re-encoding the leaves it touches and their neighbours within ``CONTEXT`` bytes, with as many bytes more
as context, and updating the sums on the path to the root. Code points are found by descending the
tree. The rest of the text is neither read by the tokenizer nor counted again. New leaves take the
places of the old; where they need more, the leaves are dealt anew and only sums are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import column, slices, small_batches, utf8

LEAF = 16
#: Bytes of context on either side of a re-encoded region; boundaries depend on four characters at most.
CONTEXT = 24
SLICE_BYTES = 2 << 20
CHARS, BYTES, TOKENS = 0, 1, 2


class TokenTree:
    """Sums of (code points, bytes, tokens) in heap order: node i has children 2i and 2i + 1, and leaf k is node ``width`` + k."""

    def __init__(self, leaves: np.ndarray):
        """From a row of (code points, bytes, tokens) a leaf."""
        self.width = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        self.sums[self.width : self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def stored(cls, flat: np.ndarray) -> "TokenTree":
        tree = cls.__new__(cls)
        tree.sums = np.array(flat, np.int64).reshape(-1, 3)
        tree.width = len(tree.sums) // 2
        return tree

    @property
    def leaves(self) -> np.ndarray:
        return self.sums[self.width :]

    @property
    def total(self) -> int:
        return int(self.sums[1, TOKENS])

    def leaf_at(self, place: int, by: int = BYTES) -> tuple[int, np.ndarray]:
        """(leaf that holds a byte or code point, sums before it); past the end, the last leaf that holds anything."""
        place = min(max(0, place), max(0, int(self.sums[1, by]) - 1))
        node, before = 1, np.zeros(3, np.int64)
        while node < self.width:
            node *= 2
            if place - before[by] >= self.sums[node, by]:
                before += self.sums[node]
                node += 1
        return node - self.width, before

    def replace(self, first: int, last: int, new: np.ndarray) -> int:
        """Leaves first..last give way to ``new`` ones; returns how many inner nodes were added up again."""
        if len(new) > last - first + 1:
            old = self.leaves
            kept = np.concatenate([old[:first], new, old[last + 1 :]])
            self.__init__(kept[kept[:, BYTES] > 0])
            return self.width - 1
        self.leaves[first : last + 1] = 0
        self.leaves[first : first + len(new)] = new
        lo, hi, touched = (self.width + first) // 2, (self.width + last) // 2, 0
        while lo:
            self.sums[lo : hi + 1] = self.sums[2 * lo : 2 * hi + 2 : 2] + self.sums[2 * lo + 1 : 2 * hi + 2 : 2]
            touched += hi + 1 - lo
            lo, hi = lo // 2, hi // 2
        return touched


def _leaves(starts: np.ndarray, counts: np.ndarray, points: np.ndarray, end: int) -> np.ndarray:
    """Rows (code points, bytes, tokens) of each ``LEAF`` pre-tokens; points: running code points by byte."""
    at = np.arange(0, len(starts), LEAF)
    edges = np.append(starts[at], end)
    return np.stack([np.diff(points[edges]), np.diff(edges), np.add.reduceat(counts, at) if len(at) else counts], axis=1)


def _points(data: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


def build(coder: bpe.Bpe, data: np.ndarray, offsets: np.ndarray) -> list[TokenTree]:
    starts, counts = coder.counts(data, offsets)
    at, points = np.searchsorted(starts, offsets), _points(data)
    return [TokenTree(_leaves(starts[i:j], counts[i:j], points, end)) for i, j, end in zip(at[:-1].tolist(), at[1:].tolist(), offsets[1:].tolist())]


def _byte_of(tree: TokenTree, text: bytearray, point: int) -> int:
    """The byte at which a code point starts: down the tree, then along one leaf; past the end, the end."""
    if point >= tree.sums[1, CHARS]:
        return len(text)
    leaf, before = tree.leaf_at(point, CHARS)
    first = int(before[BYTES])
    body = np.frombuffer(bytes(text[first : first + int(tree.leaves[leaf, BYTES])]), np.uint8)
    return first + int(np.flatnonzero((body & 0xC0) != 0x80)[point - int(before[CHARS])])


def _whole(coder: bpe.Bpe, text: bytearray, cut: int, side: int) -> int:
    """``cut`` moved outwards (side -1 or 1) off the inside of a character or of an added token's string."""
    cut = min(max(0, cut), len(text))
    longest = max(map(len, coder.added), default=0)
    for word in coder.added:
        at = text.find(word, max(0, cut - longest + 1), cut + longest - 1)
        if 0 <= at < cut < at + len(word):
            return at if side < 0 else at + len(word)
    while 0 < cut < len(text) and text[cut] & 0xC0 == 0x80:
        cut += side
    return cut


def _region(coder: bpe.Bpe, tree: TokenTree, text: bytearray, start: int, end: int, new: bytes) -> tuple[int, int, int, bytes, int]:
    """(first leaf, last leaf, bytes of the new region, text to encode with context, bytes of left context)."""
    a, before = tree.leaf_at(start - CONTEXT)
    b, b_before = tree.leaf_at(end + CONTEXT)
    begin, stop = int(before[BYTES]), max(end, int(b_before[BYTES] + tree.leaves[b, BYTES]))
    left, right = text[_whole(coder, text, begin - CONTEXT, -1) : begin], text[stop : _whole(coder, text, stop + CONTEXT, 1)]
    core = text[begin:start] + new + text[end:stop]
    return a, b, len(core), bytes(left + core + right), len(left)


def apply_edits(coder: bpe.Bpe, texts: list[bytearray], edits: list[list[tuple[int, int, str]]], trees: list[TokenTree]) -> np.ndarray:
    """Apply each text's edits one after the other; texts and trees are updated in place. Returns bytes re-encoded."""
    again = np.zeros(len(texts), np.int64)
    for turn in range(max(map(len, edits), default=0)):
        rows, work = [i for i, e in enumerate(edits) if len(e) > turn], []
        for i in rows:
            start, end, new = edits[i][turn]
            s = _byte_of(trees[i], texts[i], max(0, start))
            e = max(s, _byte_of(trees[i], texts[i], max(0, start, end)))
            work.append((s, e, new.encode(), _region(coder, trees[i], texts[i], s, e, new.encode())))
        data, offsets = utf8(pa.array([w[3][3] for w in work], pa.binary()))
        (starts, counts), points = coder.counts(data, offsets), _points(data)
        for i, (s, e, new, (a, b, size, _, left)), at in zip(rows, work, offsets[:-1].tolist()):
            lo, hi = np.searchsorted(starts, [at + left, at + left + size])
            trees[i].replace(a, b, _leaves(starts[lo:hi], counts[lo:hi], points, at + left + size))
            again[i] += size
            texts[i][s:e] = new
    return again


# --------------------------------------------------------------------------- Spark
def _flat(trees: list[TokenTree]) -> pa.Array:
    sums = [t.sums.ravel() for t in trees]
    cuts = np.append(0, np.cumsum([len(x) for x in sums])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sums) if sums else np.zeros(0, np.int64)))


def _make(path: str):
    def make(batches):
        coder = bpe.load(path)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            for a, b in slices(offsets, SLICE_BYTES):
                trees = build(coder, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t.total for t in trees], pa.int64()), _flat(trees)], [*batch.schema.names, "n_tokens", "tree"])

    return make


def _edit(path: str, keep: bool):
    def edit(batches):
        coder = bpe.load(path)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            edits = [[(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in row or [] if e is not None] for row in column(batch, "edits").to_pylist()]
            stored = column(batch, "tree")
            for a, b in slices(offsets, SLICE_BYTES):
                raw = data[offsets[a] : offsets[b]].tobytes()
                texts = [bytearray(raw[i - offsets[a] : j - offsets[a]]) for i, j in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())]
                trees = [TokenTree.stored(np.asarray(stored[i].values)) if stored[i].is_valid else None for i in range(a, b)]
                if None in trees:  # without a tree: count the text itself
                    fresh = build(coder, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    trees = [t or new for t, new in zip(trees, fresh)]
                before = [t.total for t in trees]
                again = apply_edits(coder, texts, edits[a:b], trees)
                numbers = (before, [t.total for t in trees], [len(t) for t in texts], again)
                out = [column(batch, "doc_id").slice(a, b - a), *(pa.array(x, pa.int64()) for x in numbers)]
                if keep:
                    out += [pa.array([bytes(t).decode() for t in texts], pa.string()), _flat(trees)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_tokens_edited", "n_bytes_edited", "n_bytes_reencoded", "text", "tree"][: len(out)])

    return edit


def token_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` with n_tokens and ``tree``: sums of (code points, bytes, tokens) in heap order, three numbers a node.

    Null texts count as empty. All columns stay; a table that has one of these two already is refused. One row for each
    input row; an empty table gives an empty result.
    """
    if taken := {"n_tokens", "tree"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has {', '.join(sorted(taken))}: rename it first")
    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_tokens long, tree array<bigint>"
    return docs.mapInArrow(_make(tokenizer_path), schema)


def edited(trees: DataFrame, edits: Column, tokenizer_path: str, keep: bool = True) -> DataFrame:
    """Apply edits to stored texts and their trees (doc_id, text, tree): the operator that later edits start from.

    ``edits`` is an array of (start, end, text): code points start..end are replaced by text, one edit
    after the other, each placed on the text so far; places past the end mean the end, an end before its
    start means none is removed, nulls count as 0 or empty; a null tree is made of its text. Returns doc_id, n_tokens, n_tokens_edited,
    n_bytes_edited, n_bytes_reencoded and, if ``keep``, text and tree after the edits.
    """
    small_batches(trees.sparkSession)
    kind = trees.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_bytes_edited long, n_bytes_reencoded long" + ", text string, tree array<bigint>" * keep
    return trees.select("doc_id", "text", "tree", edits.alias("edits")).mapInArrow(_edit(tokenizer_path, keep), schema)


def token_counts(docs: DataFrame, edits: Column, tokenizer_path: str, keep: bool = False) -> DataFrame:
    """Tokens of every whole text before and after its edits: ``token_trees``, then ``edited``.

    One row for each input row. Columns that ``edits`` doesn't name are left aside; an empty table gives an
    empty result.
    """
    rows = docs.select("doc_id", "text", edits.alias("edits"))
    return edited(token_trees(rows, tokenizer_path), F.col("edits"), tokenizer_path, keep)


def middle_edit() -> Column:
    """One edit a text: from its third on, a 50th of it is replaced by a note with its doc_id."""
    n = F.coalesce(F.length("text"), F.lit(0))
    start = F.floor(n / 3).cast("long")
    return F.array(F.struct(start.alias("start"), (start + F.floor(n / 50)).cast("long").alias("end"), F.concat(F.lit(" (edited: it's no. "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(") ")).alias("text")))
