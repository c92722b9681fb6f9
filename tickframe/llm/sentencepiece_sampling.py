"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The lattice stands on UTF-8 bytes, a blank written for the model's blank mark and one put in front. A
piece of merge rank r has weight 1 / (r + 1) to the power ``theta``; a character that is no piece falls
back to the model's byte pieces. A segmentation is drawn with probability proportional to the product
of its weights: forward sums give each position's total, and the last piece before a position is then
drawn from the end backwards.

Two bytes that no piece holds side by side are always cut apart, so a text is a row of small units, and
units draw independently. Equal units of a slice share their forward sums; each occurrence draws with its
own numbers, hashed from the seed, the row key and the position in the text: a row's segmentation
does not depend on the rows it is processed with. Decoding joins the pieces' bytes and is exact.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, U64, between, column, mix, prefix, slices, small_batches, utf8

THETA, SEED = 0.7, 1
SLICE_BYTES = 1 << 20
_MARK = "▁".encode()
_LOADED: dict[tuple, "Lattice"] = {}


def load(path: str, theta: float = THETA) -> "Lattice":
    if (path, theta) not in _LOADED:
        _LOADED[path, theta] = Lattice(path, theta)
    return _LOADED[path, theta]


def _keys(texts: list[bytes]) -> np.ndarray:
    data, offsets = utf8(pa.array(texts, pa.binary()))
    return _hash(prefix(BYTE[data]), offsets[:-1], offsets[1:])


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(between(sums, start, end) + (end - start).astype(U64))


class Lattice:
    """Pieces, the prefixes that lead to them, and which byte pairs they hold."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        pieces = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = model.id_to_piece(i).encode().replace(_MARK, b" ")
                pieces[self.bytes[i]] = i
        rank = {i: r for r, i in enumerate(sorted(pieces.values(), key=lambda i: (-model.get_score(i), i)))}
        self.fallback = -theta * np.log(n + 1.0)
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        keys = _keys(prefixes)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.piece = np.array([pieces.get(p, -1) for p in prefixes], np.int32)[order]
        self.weight = np.array([-theta * np.log(rank[pieces[p]] + 1.0) if p in pieces else 0.0 for p in prefixes])[order]
        self.longest = max(map(len, pieces), default=1)
        self.joined = np.zeros((256, 256), bool)
        for p in pieces:
            for a, b in zip(p, p[1:]):
                self.joined[a, b] = True
        #: Buckets of the top 18 bits: most hold one key or none.
        self.bucket = np.searchsorted(self.keys, np.arange(1 << 18, dtype=U64) << U64(46), "left").astype(np.int32)
        self.bucket = np.append(self.bucket, np.int32(len(self.keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index among prefixes, or -1."""
        top = (keys >> U64(46)).astype(np.int32)
        at, end = self.bucket[top], self.bucket[top + 1]
        out = np.full(len(keys), -1, np.int32)
        rest = np.flatnonzero(at < end)
        at, end = at[rest], end[rest]
        while len(rest):
            same = self.keys[at] == keys[rest]
            out[rest[same]] = at[same]
            more = ~same & (at + 1 < end)
            rest, at, end = rest[more], at[more] + 1, end[more]
        return out

    # ----------------------------------------------------------------- forward
    def units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of the units; ``data`` already has its blank in front of each row."""
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joined[data[:-1], data[1:]]
        cut[offsets[:-1]] = True
        return np.flatnonzero(cut)

    def edges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, id, log weight) of all pieces inside units, by byte positions; units: (start, end)."""
        sums = prefix(BYTE[data])
        size = end - start
        first = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        limit = np.repeat(end, size)
        lead = (data[first] & 0xC0) != 0x80
        at, stop, single = first[lead], limit[lead], np.zeros(len(data) + 1, bool)
        width = np.where(data[at] < 0xC0, 1, np.where(data[at] < 0xE0, 2, np.where(data[at] < 0xF0, 3, 4)))
        found = [[], [], [], []]
        for k in range(1, self.longest + 1):
            inside = at + k <= stop
            at, stop, width = at[inside], stop[inside], width[inside]
            if not len(at):
                break
            where = self.find(_hash(sums, at, at + k))
            on = where >= 0
            at, stop, width, where = at[on], stop[on], width[on], where[on]
            piece = self.piece[where]
            real = piece >= 0
            for out, x in zip(found, (at[real], at[real] + k, piece[real], self.weight[where[real]])):
                out.append(x)
            single[at[real & (width == k)]] = True
        # bytes of characters that are no piece
        head = self._head(data, first)
        bare = ~single[head]
        for out, x in zip(found, (first[bare], first[bare] + 1, self.byte_id[data[first[bare]]], np.full(bare.sum(), self.fallback))):
            out.append(x)
        return tuple(np.concatenate(x) for x in found)

    @staticmethod
    def _head(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First byte of the character of each position."""
        at = at.copy()
        for _ in range(3):
            at -= (data[at] & 0xC0) == 0x80
        return at

    def forward(self, n: int, start: np.ndarray, end: np.ndarray, edges) -> tuple[np.ndarray, ...]:
        """Edges sorted by their end, each end's first edge, and the running share of each edge in its end."""
        a, b, ids, w = edges
        origin = np.zeros(n + 1, np.int64)  # by position past a unit's start: the unit's start
        size = end - start
        origin[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum()) + 1] = np.repeat(start, size)
        depth = b - origin[b]
        order = np.argsort((depth << 40) | (b << 12) | (4095 - (b - a)))  # by depth, end and start
        a, b, ids, w, depth = a[order], b[order], ids[order], w[order], depth[order]
        enter = np.zeros(n + 1)  # forward sums by end position; a unit's start counts 0
        share = np.empty(len(a))
        group_start = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
        level = np.searchsorted(depth[group_start], np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        sizes = np.diff(np.append(group_start, len(b)))
        for d in range(len(level) - 1):
            g0, g1 = level[d], level[d + 1]
            if g0 == g1:
                continue
            lo, hi = group_start[g0], group_start[g1 - 1] + sizes[g1 - 1]
            heads = group_start[g0:g1] - lo
            inner = a[lo:hi] != origin[b[lo:hi]]
            v = w[lo:hi] + np.where(inner, enter[a[lo:hi]], 0.0)
            top = np.maximum.reduceat(v, heads)
            part = np.exp(v - np.repeat(top, sizes[g0:g1]))
            sums = np.add.reduceat(part, heads)
            enter[b[lo:hi][heads]] = top + np.log(sums)
            part /= np.repeat(sums, sizes[g0:g1])
            run = np.cumsum(part)
            share[lo:hi] = run - np.repeat(np.append(0.0, run)[heads], sizes[g0:g1])
        first_edge = np.full(n + 1, -1)
        first_edge[b[group_start]] = group_start
        count = np.zeros(n + 1, np.int64)
        count[b[group_start]] = sizes
        return a, ids, share, first_edge, count

    # ----------------------------------------------------------------- backward
    def sample(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each row). keys: a 64-bit key of each row."""
        rows = len(offsets) - 1
        size = np.diff(offsets)
        at = offsets + np.arange(rows + 1)
        body = np.full(at[-1], 32, np.uint8)
        body[np.arange(len(data)) + np.repeat(np.arange(rows) + 1, size)] = data
        start = self.units(body, at)
        end = np.append(start[1:], len(body))
        row = np.searchsorted(at, start, "right") - 1
        distinct, first, which = np.unique(_hash(prefix(BYTE[body]), start, end), return_index=True, return_inverse=True)
        order = np.argsort(start[first])
        model_start, model_end = start[first][order], end[first][order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[which]
        a, ids, share, first_edge, count = self.forward(len(body), model_start, model_end, self.edges(body, model_start, model_end))
        salt = mix(keys ^ mix(np.array([seed], U64)))
        # every occurrence walks back from its end; places in its model unit are its own places shifted
        shift = model_start[which] - start
        pos, live = end.copy(), np.arange(len(start))
        taken = np.zeros(len(start), np.int64)
        steps = []
        while len(live):
            here = pos[live]
            there = here + shift[live]
            base, n = first_edge[there], count[there]
            own = here - at[row[live]]
            draw = (mix(salt[row[live]] + own.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) / (1 << 53)
            pick = base.copy()
            for k in range(1, int(n.max())):
                pick += (n > k) & (draw >= share[base + np.minimum(k - 1, n - 1)])
            steps.append((live, ids[pick]))
            taken[live] += 1
            pos[live] = a[pick] - shift[live]
            live = live[pos[live] > start[live]]
        total = np.append(0, np.cumsum(taken))
        out = np.empty(total[-1], np.int32)
        last = total[1:] - 1
        for k, (who, piece) in enumerate(steps):
            out[last[who] - k] = piece
        return out, total[np.searchsorted(start, at)]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all pieces, one after the other."""
        if not hasattr(self, "flat"):
            self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
            self.sizes = np.array([len(x) for x in self.bytes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[ids]
        total = np.append(0, np.cumsum(sizes))
        return self.flat[np.arange(total[-1]) + np.repeat(self.starts[ids] - total[:-1], sizes)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids])[1:].decode()


def _encode(path: str, theta: float, seed: int, keep_ids: bool, carried: tuple[str, ...]):
    def encode(batches):
        lattice = load(path, theta)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            keys = np.asarray(column(batch, "k")).astype(np.int64).view(U64)
            for a, b in slices(offsets, SLICE_BYTES):
                body, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, first = lattice.sample(body, at, keys[a:b], seed)
                # Read back: each row is its blank and its text.
                back, sizes = lattice.spelled(ids), np.append(0, np.cumsum(lattice.sizes[ids]))[first]
                wrong = np.diff(sizes) != np.diff(at) + 1
                if not wrong.any():
                    text = np.ones(len(back), bool)
                    text[sizes[:-1]] = False
                    differs = np.append(0, np.cumsum(back[text] != body))
                    wrong = (differs[at[1:]] > differs[at[:-1]]) | (back[sizes[:-1]] != 32)
                little, bounds = ids.astype("<u4"), first.tolist()
                out = [
                    column(batch, "doc_id").slice(a, b - a),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([zlib.crc32(little[i:j]) for i, j in zip(bounds[:-1], bounds[1:])], pa.int64()),
                    pa.array(~wrong, pa.bool_()),
                ]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
                names = ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"][: len(out)]
                yield pa.RecordBatch.from_arrays(out + [column(batch, c).slice(a, b - a) for c in carried], names + list(carried))

    return encode


def sample_pieces(docs: DataFrame, model_path: str, theta: float = THETA, seed: int = SEED, keep_ids: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """A sampled segmentation of every whole text: doc_id, n_pieces, ids_crc32, lossless and, if wanted, ids and columns ``carried`` along.

    The row key is doc_id, or a hash of the text where that is null, so a rerun draws the same pieces and
    rows of equal doc_id and text draw alike. ``theta`` 0 draws evenly among all segmentations; large
    values come near the best one. ``lossless`` says that decoding gave the text back. Null and empty texts
    are the blank put in front alone. Other columns are left aside; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * keep_ids + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    own = F.col("doc_id").cast("long") if kind in ("bigint", "int") else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    key = F.coalesce(own, F.xxhash64("text"))
    return docs.select("doc_id", "text", key.alias("k"), *carried).mapInArrow(_encode(model_path, theta, seed, keep_ids, carried), schema)


def _decode(path: str):
    def decode(batches):
        lattice = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([None if x is None else lattice.decode(x) for x in column(batch, "ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return decode


def decode_pieces(pieces: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.select("doc_id", "ids").mapInArrow(_decode(model_path), f"doc_id {kind}, text string")
