"""Language-model scores of whole texts: a self-attention model over subword ids beside add-one word counts.

1. Documents are read once, in chunks of ``CHUNK_BYTES`` inside their own task. A chunk becomes one row (its documents
   as numbers of the chunk's distinct words, the words' subword ids, and the number of windows of its training documents)
   and one row a distinct word with its count in training documents. These are written to the shared folder.
2. Spark adds up each word's counts over all chunks and sends them back to the chunks: words travel, texts don't.
3. Each distinct training word's subwords are counted, times the word's count: statistics of the whole corpus.
4. All tasks side by side learn from every window of every training document, each from its own chunks, and the weights
   are averaged. They start from weights that the driver has fitted to a few of these windows.
5. Each chunk scores its documents: words' counts for the base, overlapping windows for the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import attention, bpe
from .attention import Attention, Vocabulary
from .common import BYTE, NOT_BLANK, U64, between, column, materialize, mix, prefix, slices, small_batches, utf8, word_spans

#: Text of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Words whose subwords a worker remembers from chunk to chunk.
REMEMBERED = 1 << 18
#: Windows that the weights start from, and passes over them; passes of the tasks over all windows, learning rate and windows of a step.
SAMPLE, EPOCHS, ROUNDS, REFINE_RATE, REFINE_BATCH = 24_000, 3, 1, 0.008, 256
#: Windows of a chunk, those of whole documents, that are cut at once.
WINDOWS_AT_ONCE = 1 << 17
MERGES = 64
#: Words of whole documents that are scored at once.
WORDS_AT_ONCE = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def remainder() -> Column:
    """crc32 of doc_id as text, modulo 7; documents of remainder 2 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7


# --------------------------------------------------------------------------- packed numbers
def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    values = values.astype(np.uint32)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[start:start + size] of each one after another, where each begins)."""
    first = np.append(0, np.cumsum(sizes))
    return values[np.arange(first[-1]) + np.repeat(starts - first[:-1], sizes)], first


# --------------------------------------------------------------------------- chunks
class Chunk:
    """Whole texts as numbers of their distinct words, A-Z lower-cased; words in order of their first place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, trained: np.ndarray):
        hashes, where, firsts, done, data = [], [], [np.zeros(1, np.int64)], 0, _LOWER[data]
        for a, b in slices(offsets):
            body, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            s, e, first = word_spans(body, at, NOT_BLANK)
            hashes.append(mix(between(prefix(BYTE[body]), s, e) + (e - s).astype(U64)))
            where.append((np.stack([s, e]) + offsets[a]).astype(np.int32 if offsets[-1] < 1 << 31 else np.int64))
            firsts.append(first[1:] + done)
            done += len(s)
        spans = np.concatenate(where, axis=1) if where else np.zeros((2, 0), np.int64)
        #: Each document's first word.
        self.first = np.concatenate(firsts)
        _, at, number = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, U64), return_index=True, return_inverse=True)
        order = np.argsort(at)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.local, self.spans, self.trained = rank[number], spans[:, at[order]], trained
        self.counts = np.bincount(self.local[np.repeat(trained, np.diff(self.first))], minlength=len(order))
        sizes = self.spans[1] - self.spans[0].astype(np.int64)
        self.letters, self.starts = ragged(data, self.spans[0], sizes)

    def words(self) -> pa.Array:
        kind = pa.int64()
        return pa.LargeStringArray.from_buffers(len(self.starts) - 1, pa.array(self.starts, kind).buffers()[1], pa.py_buffer(self.letters.tobytes())).cast(pa.string())

    def subwords(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        return subwords(self.letters, self.starts, path)


def subwords(letters: np.ndarray, starts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each word): a word is encoded with a blank before it, whatever stands before it in a text."""
    n = len(starts) - 1
    out = np.full(len(letters) + n, 32, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(n), np.diff(starts)) + 1] = letters
    found, firsts, done, offsets, coder = [], [np.zeros(1, np.int64)], 0, starts + np.arange(n + 1), bpe.load(path)
    if len(coder.known) > REMEMBERED:
        coder._forget()
    for a, b in slices(offsets):
        ids, first = coder.encode(out[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append(ids.astype(np.int64))
        firsts.append(first[1:] + done)
        done += len(ids)
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(firsts)


def training_blocks(first: np.ndarray, local: np.ndarray, sizes: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents of a chunk to learn from, windows of each); ``sizes``: subwords of each word."""
    rows = np.flatnonzero(trained)
    tokens = np.append(0, np.cumsum(sizes[local], dtype=np.int64))[first]
    return rows, -(-(np.diff(tokens)[rows] + 1) // attention.BLOCK)


def training_windows(first: np.ndarray, local: np.ndarray, sizes: np.ndarray, ids: np.ndarray, rows: np.ndarray, blocks: np.ndarray, picked: np.ndarray, end: int) -> np.ndarray:
    """The windows ``picked`` (ascending) among all those of ``rows``; ``blocks``: how many each has."""
    done, starts = np.cumsum(blocks), np.append(0, np.cumsum(sizes))
    row = np.searchsorted(done, picked, "right")
    block = picked - (done - blocks)[row]
    mine, row = np.unique(row, return_inverse=True)
    words, at = ragged(local, first[rows[mine]], np.diff(first)[rows[mine]])
    tokens, place = ragged(ids, starts[words], sizes[words])
    return attention.windows(tokens, place[at], end, row, block)


def _chunks(path: str, kind: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    own = to_arrow_type(kind)
    names = "chunk ids held first local sizes subwords n_windows word number n".split()
    kinds = [pa.int64(), pa.list_(own), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64()]

    def rows(values: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values[c] if c in values else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def made(held: list, number: int):
        texts, ids, out = pa.concat_arrays([t for t, _, _ in held]), pa.concat_arrays([i for _, i, _ in held]), pa.concat_arrays([h for _, _, h in held])
        data, offsets = utf8(texts)
        trained = ~out.to_numpy(zero_copy_only=False).astype(bool)
        chunk = Chunk(data, offsets, trained)
        subs, starts = chunk.subwords(path)
        _, blocks = training_blocks(chunk.first, chunk.local, np.diff(starts), trained)
        one = lambda value, kind: pa.array([value], kind)
        yield rows({
            "chunk": one(number, kinds[0]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "held": pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), out), "first": one(packed(chunk.first), pa.binary()),
            "local": one(packed(chunk.local), pa.binary()), "sizes": one(packed(np.diff(starts)), pa.binary()), "subwords": one(packed(subs), pa.binary()), "n_windows": one(int(blocks.sum()), pa.int64()),
        }, 1)
        words, n = chunk.words(), len(chunk.counts)
        if n:
            yield rows({"chunk": pa.array(np.full(n, number)), "word": words, "number": pa.array(np.arange(n, dtype=np.int32)), "n": pa.array(chunk.counts.astype(np.int64))}, n)

    def run(batches):
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = column(batch, "text")
            _, offsets = utf8(texts)
            for a, b in slices(offsets, CHUNK_BYTES):
                more = int(offsets[b] - offsets[a])
                if held and size + more > CHUNK_BYTES:
                    yield from made(held, number)
                    held, size, number = [], 0, number + 1
                held.append((texts.slice(a, b - a), column(batch, "doc_id").slice(a, b - a), column(batch, "held_out").slice(a, b - a)))
                size += more
        if held:
            yield from made(held, number)

    return run


def chunked(docs: DataFrame, path: str) -> DataFrame:
    """Rows of chunks and of their words, written to the shared folder."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    source = docs.select("doc_id", (remainder() == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = f"chunk long, ids array<{kind.simpleString()}>, held array<boolean>, first binary, local binary, sizes binary, subwords binary, n_windows long, word string, number int, n long"
    return materialize(source.mapInArrow(_chunks(path, kind), schema), "lm-chunks")


# --------------------------------------------------------------------------- counts
def word_totals(chunks: DataFrame) -> DataFrame:
    """chunk, number, c (the word's count in all training documents), word (in one chunk only, else null); written."""
    words = chunks.where("word is not null").select("chunk", "number", "n", "word", F.xxhash64("word").alias("h"))
    same = Window.partitionBy("h", "word")  # the hash in front sorts fast
    found = words.select("chunk", "number", F.sum("n").over(same).alias("c"), F.when(F.min("chunk").over(same) == F.col("chunk"), F.col("word")).alias("word"))
    return materialize(found, "lm-words")


def subword_counts(totals: DataFrame, path: str) -> np.ndarray:
    """How often each subword occurs in all training documents; the driver gets one row an id of the tokenizer."""

    def count(batches):
        seen = np.zeros(bpe.load(path).size + 1)
        for batch in batches:
            letters, starts = utf8(column(batch, "word"))
            ids, first = subwords(letters, starts, path)
            seen += np.bincount(ids, np.repeat(column(batch, "c").to_numpy(), np.diff(first)), len(seen))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], ["id", "n"])

    own = totals.where("word is not null and c > 0").select("word", "c").mapInArrow(count, "id int, n double")
    out = np.zeros(bpe.load(path).size + 1)
    for r in own.groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


# --------------------------------------------------------------------------- fit
def _flat(weights: dict[str, np.ndarray]) -> bytes:
    return b"".join(w.tobytes() for w in weights.values())


def _shaped(data: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, w in like.items():
        out[k] = data[at : at + w.size].reshape(w.shape).astype(np.float32)
        at += w.size
    return out


#: What windows are cut from.
PARTS = ["chunk", "held", "first", "local", "sizes", "subwords"]


def _stored(batch: pa.RecordBatch):
    """(chunk, first, local, sizes, subwords, documents to learn from, windows of each) of each chunk."""
    get = lambda c, i: unpacked(column(batch, c)[i].as_py())
    for i in range(batch.num_rows):
        first, local, sizes, ids = (get(c, i) for c in PARTS[2:])
        held = column(batch, "held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
        yield column(batch, "chunk")[i].as_py(), first, local, sizes, ids, *training_blocks(first, local, sizes, ~held)


def _training(batch: pa.RecordBatch, end: int):
    """(chunk, number of windows, their cut by number) of each chunk."""
    for number, first, local, sizes, ids, rows, blocks in _stored(batch):
        yield number, int(blocks.sum()), lambda picked: training_windows(first, local, sizes, ids, rows, blocks, picked, end)  # noqa: B023


def _start(chunks: DataFrame, total: int, end: int) -> np.ndarray:
    """About ``SAMPLE`` of all training windows, each as likely as another."""

    def pick(batches):
        for batch in batches:
            for number, n, cut in _training(batch, end):
                kept = cut(np.flatnonzero(np.random.default_rng([23, number]).random(n) * total < SAMPLE))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(kept.ravel())], pa.binary())], ["chunk", "windows"])

    found = chunks.where("n_windows > 0").select(PARTS).mapInArrow(pick, "chunk long, windows binary").collect()
    return np.concatenate([unpacked(bytes(r.windows)).reshape(-1, 2 * attention.BLOCK + 1) for r in sorted(found, key=lambda r: r.chunk)])


def refined(chunks: DataFrame, model: Attention, end: int, seed: int) -> DataFrame:
    """part, n, weights: what each task has learnt from all ``n`` training windows of its chunks, weights times n."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # bounded: the vocabulary and some hundred thousand weights
    shape = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("weights", pa.binary())])

    def refine(batches):
        from pyspark import TaskContext

        own, total = Attention(shared.value.vocabulary, {k: w.copy() for k, w in shared.value.weights.items()}), 0
        for batch in batches:
            for _, first, local, sizes, ids, rows, blocks in _stored(batch):
                starts, n = np.append(0, np.cumsum(sizes)), np.diff(first)
                for a, b in slices(np.append(0, np.cumsum(blocks)), WINDOWS_AT_ONCE):  # whole documents
                    words, at = ragged(local, first[rows[a:b]], n[rows[a:b]])
                    tokens, place = ragged(ids, starts[words], sizes[words])
                    total += own.learn_rows(tokens, place[at], end, REFINE_RATE, seed, REFINE_BATCH)
        mean = np.frombuffer(_flat(own.weights), np.float32).astype(float) * total
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total]), pa.array([mean.tobytes()], pa.binary())], schema=shape)

    return chunks.where("n_windows > 0").select(PARTS).mapInArrow(refine, "part long, n long, weights binary").where("n > 0")


def _averaged(chunks: DataFrame, model: Attention, end: int, seed: int) -> dict[str, np.ndarray]:
    """Weights that all tasks refined from the model's on their own windows, averaged by number of windows."""
    shape = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("weights", pa.binary())])

    def merged(batches):
        n, total = 0, None
        for batch in batches:
            for more, data in zip(column(batch, "n").to_pylist(), column(batch, "weights").to_pylist()):
                n, total = n + more, np.frombuffer(data) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], schema=shape)

    kind = "part long, n long, weights binary"
    found = refined(chunks, model, end, seed).repartition(MERGES, "part").sortWithinPartitions("part").mapInArrow(merged, kind).collect()
    if not found:
        return model.weights
    total = sum(np.frombuffer(bytes(r.weights)) for r in sorted(found, key=lambda r: (r.n, bytes(r.weights))))
    return _shaped(total / sum(r.n for r in found), model.weights)


def fit(chunks: DataFrame, counts: np.ndarray, path: str) -> Attention:
    """A model of all training documents: counts of all their subwords, weights by all their windows."""
    coder = bpe.load(path)
    heads = np.array([(coder.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(coder.size)] + [True])
    model = Attention(Vocabulary(counts, heads))
    total = chunks.agg(F.sum("n_windows")).first()[0] or 0
    if total:
        model.train(_start(chunks, total, coder.size), EPOCHS)
        for i in range(ROUNDS):
            model.weights = _averaged(chunks, model, coder.size, i)
    return model


# --------------------------------------------------------------------------- scores
def _scored(shared, words: int, distinct: int, ends: int, kind: T.StructField):
    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        model, out = shared.value, []
        counts = np.zeros(right.num_rows, np.int64)
        counts[right.column("number").to_numpy()] = right.column("c").to_numpy()
        for i in range(left.num_rows):
            get = lambda c: unpacked(left.column(c)[i].as_py())  # noqa: B023, E731
            first, local, sizes, subs = get("first"), get("local"), get("sizes"), get("subwords")
            starts, n = np.append(0, np.cumsum(sizes)), np.diff(first)
            logs, known = np.append(np.log10(counts + 1.0)[local], 0.0), np.append((counts > 0)[local], False).astype(np.int64)
            whole = lambda x: np.where(n > 0, np.add.reduceat(x, first[:-1]), 0) if len(n) else x[:0]  # noqa: B023, E731
            base = whole(logs) + np.log10(ends + 1.0) - (n + 1) * np.log10(words + 1.0 * (distinct + 1))
            scores = np.empty(len(n))
            for a, b in slices(first, WORDS_AT_ONCE):
                tokens, at = ragged(subs, starts[local[first[a] : first[b]]], sizes[local[first[a] : first[b]]])
                scores[a:b] = model.scores(tokens, at[first[a : b + 1] - first[a]], len(model.vocabulary.member) - 1) / np.log(10)
            ids, held = left.column("ids").combine_chunks()[i].values, left.column("held").combine_chunks()[i].values
            columns = [ids, held, pa.array(n + 1), pa.array(whole(known) + (ends > 0)), pa.array(np.full(len(n), words)), pa.array(base), pa.array(scores)]
            out.append(pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out) if out else shape.empty_table()

    from pyspark.sql.pandas.types import to_arrow_type

    shape = pa.schema([("doc_id", to_arrow_type(kind.dataType)), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
    return score


def language_model_scores(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text; one row for each input row.

    ``path`` is the file of a byte-level tokenizer. A null text counts as empty: its one token is the end. ``base_score``
    is exact over all training words; ``score`` is the model's log10 probability of the text, its words lower-cased and
    parted by one blank. Without training documents the model knows nothing: all subwords are equally likely. Rows alike
    count once each; a null id counts as an empty one for holding out. Other columns are left aside, ids of any type
    are passed on, and an empty table gives an empty result.
    """
    chunks = chunked(docs, path)
    totals = word_totals(chunks)
    ends = docs.where(remainder() != 2).count()
    found = totals.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("c"))), F.sum((F.col("word").isNotNull() & (F.col("c") > 0)).cast("long"))).first()
    words, distinct = (found[0] or 0) + ends, (found[1] or 0) + (ends > 0)
    counts = subword_counts(totals, path)
    counts[-1] = ends
    shared = docs.sparkSession.sparkContext.broadcast(fit(chunks, counts, path))  # bounded, as above
    left = chunks.where("ids is not null").select("chunk", "ids", "held", "first", "local", "sizes", "subwords")
    kind = docs.schema["doc_id"]
    schema = T.StructType([kind, *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return left.groupBy("chunk").cogroup(totals.select("chunk", "number", "c").groupBy("chunk")).applyInArrow(_scored(shared, words, distinct, ends, kind), schema)
