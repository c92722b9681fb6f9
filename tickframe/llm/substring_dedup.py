"""Substring de-duplication by fixed-block anchors.

Any window of ``window`` words holds one whole aligned block of ``(window + 1) // 2`` words. So:

1. index each document's non-overlapping blocks and probe them with every rolling block-long window
   of every document; a block is an anchor if its hash is met at another place too;
2. extend each anchor to all windows around it, and find by wide fingerprints (96 bits) which of
   these start at two places or more; runs of such windows are the maximal exact repeats.

No pairs of places are made: a passage in a million documents costs one entry a chunk and hash.
Documents are dealt once into chunks of bounded bytes; hashes travel as sorted compact lists
(see ``exchange``), cut by hash range, and the answers are one bit an entry.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import U64, chunk_of, column, grams, mix, parts, slices, small_batches, spaced, text_bytes, utf8, word_hashes, word_spans, NOT_BLANK

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
_WIRE = "bucket int, chunk int, payload binary"


class _Chunk:
    """One chunk's documents in a fixed order, and the hashes of their words."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.data, self.offsets = utf8(column(self.table, "text"))
        self.words, self.first = word_hashes(self.data, self.offsets)
        self.window, self.block = window, (window + 1) // 2
        self.doc_start = np.repeat(self.first[:-1], np.diff(self.first))

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ascending distinct probe keys with (met twice here, aligned here) as two low bits; then aligned places and their keys."""
        hashed, whole = grams(self.words, self.first, self.block)
        keys = hashed >> U64(64 - bits)
        aligned = np.flatnonzero(whole & ((np.arange(len(keys)) - self.doc_start[: len(keys)]) % self.block == 0))
        mark = np.zeros(len(keys), U64)
        mark[aligned] = 1
        marked = np.sort(((keys << U64(1)) | mark)[whole])
        plain = marked >> U64(1)
        last = np.append(plain[1:] != plain[:-1], True) if len(plain) else np.zeros(0, bool)
        twice = np.append(False, plain[1:] == plain[:-1]) if len(plain) else np.zeros(0, bool)
        entries = (plain[last] << U64(2)) | (twice[last].astype(U64) << U64(1)) | (marked[last] & U64(1))
        return entries, aligned, keys[aligned], keys

    def candidates(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor; anchors: word places of hit blocks."""
        n = max(0, len(self.words) - self.window + 1)
        hit = np.zeros(len(self.words) + self.block, bool)
        hit[anchors] = True
        at = np.arange(n)
        start = self.doc_start[:n]
        inside = at + self.window <= np.repeat(self.first[1:], np.diff(self.first))[:n]
        return np.flatnonzero(inside & hit[start + -(-(at - start) // self.block) * self.block])

    def fingerprints(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide, _ = grams(self.words, self.first, self.window)
        more, _ = grams(mix(self.words ^ U64(0x5851F42D4C957F2D)), self.first, self.window, 1)
        return wide[starts], (more[starts] >> U64(32)).astype(np.uint32)


def _distinct(wide: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints, how often each is met, and each place's entry."""
    order = np.lexsort((more, wide))
    w, m = wide[order], more[order]
    new = np.append(True, (w[1:] != w[:-1]) | (m[1:] != m[:-1])) if len(w) else np.zeros(0, bool)
    which = np.empty(len(w), np.int64)
    which[order] = np.cumsum(new) - 1
    return w[new], m[new], np.bincount(which, minlength=int(new.sum())), which


def _wire(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, c, p = zip(*rows) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array(c, pa.int32()), "payload": pa.array(p, pa.binary())})


def _send_probes(window: int, bits: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        entries, *_ = _Chunk(table, window).probes(bits)
        return _wire([(b, chunk, X.pack(entries[start:end])) for b, start, end in X.pieces(entries >> U64(2), bits, buckets)])

    return send


def _answer_probes(table: pa.Table) -> pa.Table:
    """For each chunk's aligned keys of this bucket: is the key met elsewhere too?"""
    lists = [X.unpack(x) for x in table.column("payload").to_pylist()]
    entries = np.concatenate(lists)
    keys = entries >> U64(2)
    order = np.argsort(keys, kind="stable")
    new = np.append(True, np.diff(keys[order]) != 0)
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    met = np.bincount(group, weights=1.0 + ((entries >> U64(1)) & U64(1)).astype(float))
    hit, own = met[group] >= 2, (entries & U64(1)).astype(bool)
    out, at = [], 0
    for x, bucket, chunk in zip(lists, table.column("bucket").to_pylist(), table.column("chunk").to_pylist()):
        here = slice(at, at + len(x))
        out.append((bucket, chunk, X.bits(hit[here][own[here]])))
        at += len(x)
    return _wire(out)


def _replies(table: pa.Table) -> list[tuple[int, bytes]]:
    return sorted(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()))


def _places(keys: np.ndarray, bits: int, buckets: int) -> dict[int, tuple[int, int]]:
    return {b: (start, end) for b, start, end in X.pieces(keys, bits, buckets)}


def _send_windows(window: int, bits: int, probe_buckets: int, buckets: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _wire([])
        number = table.column("chunk")[0].as_py()
        chunk = _Chunk(table, window)
        entries, aligned, aligned_keys, _ = chunk.probes(bits)
        own = entries[(entries & U64(1)).astype(bool)] >> U64(2)
        at, hit = _places(own, bits, probe_buckets), np.zeros(len(own), bool)
        for b, data in _replies(answers):
            start, end = at.get(b, (0, 0))  # a bucket that got no own key answers with no bit
            hit[start:end] = X.flags(data, end - start)
        anchors = aligned[hit[np.searchsorted(own, aligned_keys)]] if len(own) else aligned
        starts = chunk.candidates(anchors)
        mask = np.zeros(len(chunk.words), bool)
        mask[starts] = True
        w, m, count, _ = _distinct(*chunk.fingerprints(starts))
        rows = [(number % buckets, number, b"\0" + X.bits(mask))]
        for b, start, end in X.pieces(w, 64, buckets):
            keys = X.pack(w[start:end])
            rows.append((b, number, b"\1" + len(keys).to_bytes(4, "little") + keys + m[start:end].tobytes() + X.bits(count[start:end] > 1)))
        return _wire(rows)

    return send


def _answer_windows(table: pa.Table) -> pa.Table:
    """One bit a fingerprint: does its window start at two places or more? Marks of candidates pass through."""
    out, wide, more, twice, of = [], [], [], [], []
    for bucket, chunk, x in zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "payload"))):
        if x[:1] == b"\0":
            out.append((-1, chunk, x[1:]))
            continue
        size = int.from_bytes(x[1:5], "little")
        wide.append(X.unpack(x[5 : 5 + size]))
        n = len(wide[-1])
        more.append(np.frombuffer(x[5 + size : 5 + size + 4 * n], np.uint32))
        twice.append(X.flags(x[5 + size + 4 * n :], n))
        of.append((bucket, chunk))
    if of:
        _, _, count, which = _distinct(np.concatenate(wide), np.concatenate(more))
        local = np.zeros(len(count), bool)
        np.logical_or.at(local, which[np.concatenate(twice)], True)
        repeated, at = ((count > 1) | local)[which], 0
        for (bucket, chunk), x in zip(of, wide):
            out.append((bucket, chunk, X.bits(repeated[at : at + len(x)])))
            at += len(x)
    return _wire(out)


def _covered(chunk: _Chunk, answers: pa.Table, buckets: int) -> np.ndarray:
    """Which words lie in a window that also starts elsewhere."""
    replies = _replies(answers)
    mask = next((x for b, x in replies if b == -1), b"")
    starts = np.flatnonzero(X.flags(mask, len(chunk.words))) if mask else np.zeros(0, np.int64)
    w, _, _, which = _distinct(*chunk.fingerprints(starts)) if len(starts) else (np.zeros(0, U64), 0, 0, starts)
    at, repeated = _places(w, 64, buckets), np.zeros(len(w), bool)
    for b, x in replies:
        if b >= 0:
            start, end = at[b]
            repeated[start:end] = X.flags(x, end - start)
    edge = np.zeros(len(chunk.words) + 1, np.int32)
    hit = starts[repeated[which]] if len(starts) else starts
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + chunk.window, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(window: int, buckets: int, keep_text: bool):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window)
        gone = _covered(chunk, answers, buckets)
        taken = np.append(0, np.cumsum(gone))
        n_words, n_gone = np.diff(chunk.first), taken[chunk.first[1:]] - taken[chunk.first[:-1]]
        kept = []
        for a, b in slices(chunk.offsets):
            body, at = spaced(chunk.data[chunk.offsets[a] : chunk.offsets[b]], chunk.offsets[a : b + 1] - chunk.offsets[a])
            s, e, _ = word_spans(body, at, NOT_BLANK)
            left = ~gone[chunk.first[a] : chunk.first[b]]
            body[e] = 32
            edge = np.zeros(len(body) + 2, np.int8)
            edge[s[left]] += 1
            edge[e[left] + 1] -= 1
            use = np.cumsum(edge[: len(body)], dtype=np.int8) > 0
            text, cut = body[use].tobytes(), np.append(0, np.cumsum(use))[at]
            kept += [text[i : max(i, j - 1)] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        out = {
            "doc_id": column(chunk.table, "doc_id"),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_gone, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if keep_text:
            out["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
        return pa.table(out)

    return remove


def substring_dedup(docs: DataFrame, window: int = 35, keep_text: bool = True, chunk_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """Words left of each row once every repeated ``window``-word passage is taken out, all copies alike.

    Words are runs of `[^\\x20\\x09-\\x0D]`. Returns doc_id, n_words, n_removed, kept_sha256 and, if
    ``keep_text``, kept_text (kept words joined by one blank), one row for each input row: repeated
    rows are places of their own, so rows of ``window`` words or more that occur twice lose all.
    Null and empty texts have no words (digest of no bytes). An empty table gives an empty result.
    Null ids stay null. Other columns are left aside, whatever their names.

    ``chunk_bytes`` of text are one group in a task (about 15 times that in memory) and ``bucket_bytes`` of
    text give the hashes of one bucket. A list goes from each chunk to each bucket, so their number grows
    with the square of the corpus over both: on a corpus of many TB, give both what executors can hold.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    total = text_bytes(source)
    n_chunks, buckets = parts(total, chunk_bytes or CHUNK_BYTES), parts(total, bucket_bytes or BUCKET_BYTES)
    bits = min(61, max(24, math.ceil(math.log2(total + 2)) + 8))  # about one false anchor in thousands, at any size
    dealt = source.withColumn("chunk", chunk_of(n_chunks)).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")
    probes = dealt.groupBy("chunk").applyInArrow(_send_probes(window, bits, buckets), _WIRE)
    hits = probes.groupBy("bucket").applyInArrow(_answer_probes, _WIRE)
    windows = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_send_windows(window, bits, buckets, buckets), _WIRE)
    repeats = windows.groupBy("bucket").applyInArrow(_answer_windows, _WIRE)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_remove(window, buckets, keep_text), schema)
