"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

A-Z are lower-cased and words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. The automaton's alphabet is
the benchmark's own words, so a text is scanned once as word numbers and a word the benchmark lacks
sends it back to the root. Hits are word ranges, mapped to code points of the original text.

The automaton is a handful of arrays, built once and broadcast. Its trie holds, for every word of the
benchmark, the ``window`` words from there on (fewer at an item's end): every suffix of a path is then a
path too, so each failure link leads to the state of exactly one word less. A state is (place, depth):
the first place in the benchmark where those words stand. Going on along that place needs no table;
only branches are listed, at most one a place. That is some 40 bytes a benchmark word, whatever the
window, against 10 nodes a word of a plain trie.

Texts are scanned side by side: runs of known words are cut into pieces that overlap by ``window`` - 1
words, and all pieces of a batch take each step together in numpy.

``PASS_BYTES`` bounds what is broadcast. A benchmark beyond it is done in passes over the documents, each
with an automaton of its own whose marks are written before the next begins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_LOWER, U64, column, materialize, mix, parts, slices, small_batches, text_bytes, utf8, word_hashes, word_spans

WINDOW = 10
#: Text of one automaton: 64 MB of benchmark make about 0.5 GB of arrays in the driver and in each Python worker.
PASS_BYTES = 64 << 20
#: Words of one piece of a scan, besides its overlap.
PIECE = 64
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


# --------------------------------------------------------------------------- the automaton
def _branch(place: np.ndarray, depth, word: np.ndarray) -> np.ndarray:
    """The key of a branch from state (place, depth) by ``word``."""
    return mix((place.astype(U64) << U64(32)) ^ (word.astype(U64) + U64(1)) ^ mix(np.atleast_1d(depth).astype(U64) + U64(0x1F123BB5)))


def build(items: list[tuple[str, str | None]], window: int) -> dict:
    """The automaton's arrays of (item_id, text).

    words: word numbers from 1, a 0 after each item; own: the depth from which a place stands for itself;
    link: the place that stands for its words one less; keys, to: branches; roots: the first place of each
    word; full, full_at, full_items: items of each state of ``window`` words; short likewise for items of
    fewer words (their keys are place * window + depth).
    """
    hashes, first = word_hashes(*utf8(pa.array([t for _, t in items], pa.string())), BYTE_LOWER, WORD)
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    n_words = np.diff(first)
    item = np.repeat(np.arange(len(items)), n_words)
    at = np.arange(len(hashes)) + item  # one free place after each item
    words = np.zeros(len(hashes) + len(items), np.int32)
    words[at] = numbers + 1
    end = np.repeat(first[1:] + np.arange(len(items)), n_words)
    of = np.full(len(words), -1, np.int32)
    of[at] = item
    own = np.full(len(words), window + 1, np.int8 if window < 127 else np.int32)
    link = np.full(len(words), -1, np.int32)
    stands, keys, to = np.zeros(len(words), np.int32), [], []
    live, roots = at, np.zeros(len(vocabulary) + 1, np.int32)
    state = np.zeros(len(words), np.int64)  # number of the state that a place's first words lead to
    short_keys, short_items = [], []
    size = np.minimum(n_words, window)  # words of each item's windows
    for depth in range(1, window + 1):
        live = live[live + depth <= end[live - of[live]]]
        key = (state[live] << 32) | words[live + depth - 1]
        _, where, which = np.unique(key, return_index=True, return_inverse=True)
        before, stands[live], state[live] = stands[live], live[where[which]], which
        new = stands[live] == live
        fresh = live[new & (own[live] > depth)]
        own[fresh] = depth
        if depth == 1:
            roots[words[fresh]] = fresh
        else:
            branch = new & (before != live)
            link[live[branch]] = before[branch]
            keys.append(_branch(before[branch], depth - 1, words[live[branch] + depth - 1]))
            to.append(live[branch].astype(np.int32))
        link[live[~new]] = stands[live[~new]]
        whole = live[(size[of[live]] == depth) & (depth < window)] if depth < window else live[:0]
        short_keys.append(stands[whole].astype(np.int64) * window + depth)
        short_items.append(of[whole])
    keys, to = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, U64), (to, np.int32)))
    order = np.argsort(keys)
    tables = {}
    for name, k, i in (("full", stands[live].astype(np.int64), of[live]), ("short", np.concatenate(short_keys), np.concatenate(short_items))):
        pairs = np.unique(np.stack([k, i]), axis=1) if len(k) else np.zeros((2, 0), np.int64)
        states, start = np.unique(pairs[0], return_index=True)
        tables |= {name: states, f"{name}_at": np.append(start, pairs.shape[1]), f"{name}_items": pairs[1].astype(np.int32)}
    sizes = sorted(set(size[(size > 0) & (size < window)].tolist()))
    return {"window": window, "names": [i for i, _ in items], "vocabulary": vocabulary, "words": words, "own": own, "link": link, "keys": keys[order], "to": to[order], "roots": roots, "sizes": sizes, "least": min([*sizes, window]), **tables}


class Matcher:
    """Scans texts with an automaton's arrays."""

    def __init__(self, arrays: dict):
        self.a = arrays
        self.window = arrays["window"]

    def _standing(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place of the ``depth`` words from ``place`` on."""
        place = place.copy()
        left = np.flatnonzero((depth < self.a["own"][place]) & (depth > 0))
        while len(left):
            place[left] = self.a["link"][place[left]]
            left = left[depth[left] < self.a["own"][place[left]]]
        return place

    def step(self, place: np.ndarray, depth: np.ndarray, word: np.ndarray) -> None:
        """Take one word each, in place; 0 is a word that the benchmark lacks."""
        a = self.a
        depth[word == 0] = 0
        full = np.flatnonzero(depth == self.window)
        if len(full):
            self._fail(place, depth, full)
        left = np.flatnonzero(word > 0)
        while len(left):
            p, d, w = place[left], depth[left], word[left]
            root = d == 0
            on = ~root & (a["words"][p + d] == w)
            target = np.where(root, a["roots"][w], p)
            open_ = np.flatnonzero(~root & ~on)
            if len(open_) and len(a["keys"]):
                key = _branch(p[open_], d[open_], w[open_])
                where = np.minimum(np.searchsorted(a["keys"], key), len(a["keys"]) - 1)
                hit = a["keys"][where] == key
                target[open_[hit]] = a["to"][where[hit]]
                on[open_[hit]] = True
            go = root | on
            done = left[go]
            place[done] = target[go]
            depth[done] += 1
            left = left[~go]
            self._fail(place, depth, left)

    def _fail(self, place: np.ndarray, depth: np.ndarray, rows: np.ndarray) -> None:
        depth[rows] -= 1
        place[rows] = self._standing(place[rows] + 1, depth[rows])

    def matches(self, place: np.ndarray, depth: np.ndarray):
        """(table, positions, table's entries, words) of every pattern that ends in these states."""
        found = np.flatnonzero(depth == self.window)
        if len(found):
            yield "full", found, np.searchsorted(self.a["full"], place[found]), self.window
        for size in self.a["sizes"]:
            found = np.flatnonzero(depth >= size)
            at = self._standing(place[found] + depth[found] - size, np.full(len(found), size)).astype(np.int64) * self.window + size
            where = np.minimum(np.searchsorted(self.a["short"], at), len(self.a["short"]) - 1)
            hit = self.a["short"][where] == at
            yield "short", found[hit], where[hit], size

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """(word marks, each row's first word, items of each row that has any)."""
        words, first = word_hashes(data, offsets, BYTE_LOWER, WORD)
        vocabulary, items = self.a["vocabulary"], {}
        edge = np.zeros(len(words) + 1, np.int64)
        if not len(vocabulary) or not len(words):
            return np.zeros(len(words), bool), first, items
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        numbers = np.where(vocabulary[at] == words, at + 1, 0).astype(np.int32)
        known, row = numbers > 0, np.zeros(len(words) + 1, bool)
        row[first] = True
        start = np.flatnonzero(known & (~np.append(False, known[:-1]) | row[:-1]))
        end = np.flatnonzero(known & (~np.append(known[1:], False) | row[1:])) + 1
        long = end - start >= self.a["least"]
        start, end = start[long], end[long]
        # pieces: each counts matches that end in its own PIECE words, after window - 1 words of run-up
        n = -(-(end - start) // PIECE)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin, stop = np.repeat(start, n) + nth * PIECE, np.repeat(end, n)
        stop = np.minimum(begin + PIECE, stop)
        at = np.maximum(begin - (self.window - 1), np.repeat(start, n))
        order = np.argsort(at - stop, kind="stable")  # longest first
        at, begin, stop = at[order], begin[order], stop[order]
        place, depth = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        met: dict[str, list] = {"full": [], "short": []}
        live = len(at)
        for _ in range(PIECE + self.window):
            live = int(np.searchsorted(-(stop - at)[:live], 0, "left"))  # pieces that have words left stay in front
            if not live:
                break
            here = at[:live]
            self.step(place[:live], depth[:live], numbers[here])
            for table, found, entry, size in self.matches(place[:live], depth[:live]):
                counts = here[found] >= begin[:live][found]
                last, entry = here[found][counts], entry[counts]
                np.add.at(edge, last + 1 - size, 1)
                np.add.at(edge, last + 1, -1)
                met[table].append(np.stack([np.searchsorted(first, last, "right") - 1, entry]))
            at[:live] += 1
        for table, found in met.items():
            if found:
                rows, entries = np.unique(np.concatenate(found, axis=1), axis=1)
                lo, hi = self.a[f"{table}_at"][entries], self.a[f"{table}_at"][entries + 1]
                for r, i, j in zip(rows.tolist(), lo.tolist(), hi.tolist()):
                    items.setdefault(r, set()).update(self.a[f"{table}_items"][i:j].tolist())
        return np.cumsum(edge[:-1]) > 0, first, items


# --------------------------------------------------------------------------- Spark
def _passes(benchmark: DataFrame, window: int):
    """One broadcast automaton for each ``PASS_BYTES`` of benchmark, one at a time; an empty one for none."""
    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    n = parts(text_bytes(source), PASS_BYTES)
    for i in range(n):
        mine = source if n == 1 else source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield i == n - 1, benchmark.sparkSession.sparkContext.broadcast(build([(r.item_id, r.text) for r in mine.collect()], window))


def _char_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> list[dict]:
    """Merged ranges of hit words as code points of one text."""
    point = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    first = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
    last = np.flatnonzero(hit & ~np.append(hit[1:], False))
    return [{"start": int(point[start[a]]), "end": int(point[end[b]])} for a, b in zip(first, last)]


def _report(shared):
    def report(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            old_marks, old_items = column(batch, "marks").to_pylist(), column(batch, "items").to_pylist()
            n_words, n_hit, marks, names, spans = [], [], [], [], []
            for a, b in slices(offsets):
                body, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hit, first, items = matcher.scan(body, at)
                n_words += np.diff(first).tolist()
                for i in range(b - a):
                    own = hit[first[i] : first[i + 1]]
                    if old_marks[a + i] is not None:
                        own = own | np.unpackbits(np.frombuffer(old_marks[a + i], np.uint8), count=len(own)).astype(bool)
                    met = {matcher.a["names"][x] for x in items.get(i, ())} | set(old_items[a + i] or ())
                    count = int(own.sum())
                    n_hit.append(count)
                    names.append(sorted(met))
                    marks.append(np.packbits(own).tobytes() if count else None)
                    if count:
                        text = body[at[i] : at[i + 1]]
                        s, e, _ = word_spans(text, np.array([0, len(text)]), WORD)
                        spans.append(_char_spans(text, s, e, own))
                    else:
                        spans.append([])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "text"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(marks, pa.binary()), pa.array(names, pa.list_(pa.string())), pa.array(spans, kind)],
                ["doc_id", "text", "n_words", "n_hit", "marks", "items", "spans"],
            )

    return report


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Benchmark passages in each text: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    An item's windows are its runs of ``window`` words; an item of fewer words, but not none, is one window.
    A word inside any occurrence of a window is hit. Null, empty and wordless texts and items have no
    windows. Items of one id count once; a null id goes by the name ``null``. ``spans`` are merged ranges of
    the original text in code points. One row for each input row, repeated or not; other columns are left
    aside. An empty table gives an empty result and an empty benchmark no hits.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("items"))
    schema = f"doc_id {kind}, text string, n_words long, n_hit long, marks binary, items array<string>, spans array<struct<start:long,end:long>>"
    for last, shared in _passes(benchmark, window):
        found = found.select("doc_id", "text", "marks", "items").mapInArrow(_report(shared), schema)
        if not last:
            found = materialize(found, "marks")
            shared.unpersist()
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans"
    )


def _drop(shared):
    def drop(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            clean = np.ones(len(offsets) - 1, bool)
            for a, b in slices(offsets):
                _, _, items = matcher.scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                clean[[a + i for i in items]] = False
            yield batch.filter(pa.array(clean))

    return drop


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark window."""
    small_batches(docs.sparkSession)
    for last, shared in _passes(benchmark, window):
        docs = docs.mapInArrow(_drop(shared), docs.schema)
        if not last:
            docs = materialize(docs, "clean")
            shared.unpersist()
    return docs


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
