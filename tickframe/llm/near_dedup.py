"""Near-duplicate groups by circulant MinHash.

Two permutations give every signature coordinate: ``sigma`` spreads a shingle over 2**32 places once,
and coordinate k is the least value of ``pi`` shifted circularly by k: min over x of
pi(sigma(x) + k mod 2**32). ``BANDS`` bands of ``ROWS`` coordinates make candidates: two documents of
similarity 0.75 share none with probability (1 - 0.75**5)**48, about 2e-6. Every candidate link is then
confirmed by exact Jaccard similarity of the full shingle sets.

No pairs are emitted for a group of copies. Equal sets are one node, told by a 64-bit sum that a
128-bit digest of the whole set backs. Nodes joined by any bucket (as a star round its least node)
form a family; inside a family, links are found in blocks by one intersection product, and only a
spanning forest of them leaves a task. A family of more than ``BLOCK`` nodes is done in two rounds: all
its members against one sampled block; then, its nodes dealt into blocks of likely neighbours, the
blocks of nodes still outside its largest component against those blocks alone that share a band
with them. A family that chains through the corpus so costs what its bands hold, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import BATCH_ROWS, BYTE_LOWER, U64, between, column, grams, materialize, mix, parts, prefix, slices, small_batches, utf8, word_hashes

SHINGLE = 5
ROWS, BANDS = 5, 48
BLOCK = 512
BUCKET_ENTRIES = 1 << 19
BIN_BYTES = 8 << 20
#: Lists of band keys that one group takes; more are first thinned apart.
LISTS = 4096
_U32 = np.uint32


# --------------------------------------------------------------------------- sets and signatures
def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in ascending order, and where each row's begin."""
    words, first = word_hashes(data, offsets, BYTE_LOWER)
    n = np.diff(first)
    hashed, whole = grams(words, first, SHINGLE)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    sums = prefix(words)
    whole_rows = mix(between(sums, first[short], first[short + 1]) ^ n[short].astype(U64))
    out, at = [], [0]
    few = dict(zip(short.tolist(), whole_rows))
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if hi - lo >= SHINGLE:
            own = np.sort(hashed[lo : hi - SHINGLE + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        else:
            own = np.array([few[i]], U64) if hi > lo else np.zeros(0, U64)
        out.append(own)
        at.append(at[-1] + len(own))
    return np.concatenate(out) if out else np.zeros(0, U64), np.array(at)


def _pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation of 2**32, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, _U32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, _U32(factor), out=x)
    np.right_shift(x, _U32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def band_keys(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows with shingles) x BANDS keys."""
    sigma = (mix(shingles ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(_U32)
    starts = at[:-1][np.diff(at) > 0]
    keys = np.empty((len(starts), BANDS), U64)
    x, spare = np.empty_like(sigma), np.empty_like(sigma)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, U64)
        for row in range(ROWS):
            np.add(sigma, _U32(band * ROWS + row), out=x)
            low = np.minimum.reduceat(_pi(x, spare), starts)
            key = mix(key * U64(0x9E3779B97F4A7C15) + low)
        keys[:, band] = key
    return keys


def _node(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One id for each distinct set: a sum of mixed members."""
    sums = np.append(U64(0), np.cumsum(mix(shingles ^ U64(0x2545F4914F6CDD1D)), dtype=U64))
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64)).view(np.int64)


def _check(sets: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each whole set."""
    return [xxhash.xxh3_128_digest(sets[i:j]) if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def _sign(batches):
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        nodes, sizes, bands, checks = [], [], [], []
        for a, b in slices(offsets, 1 << 18):
            sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            nodes.append(_node(sets, at))
            sizes.append(np.diff(at))
            checks += _check(sets, at)
            rows = iter(band_keys(sets, at))
            bands += [next(rows).tobytes() if n else None for n in sizes[-1].tolist()]
        if not nodes:
            continue
        yield pa.RecordBatch.from_arrays(
            [*(column(batch, c) for c in ("doc_id", "text_key", "r")), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(nodes), pa.int64()), pa.array(checks, pa.binary()), pa.array(bands, pa.binary())],
            ["doc_id", "text_key", "r", "n_shingles", "node", "digest", "bands"],
        )


def _told_apart(signed: DataFrame) -> DataFrame:
    """``signed``, sets that share a node by chance given nodes of their own (none below some 1e9 sets)."""
    few = signed.where("n_shingles > 0").groupBy("node").agg(F.min("digest").alias("own"), F.max("digest").alias("other")).where("own <> other").select("node", "own")
    few = materialize(few, "collisions")
    if few.isEmpty():
        return signed
    new = F.when(F.col("own").isNull() | F.col("own").eqNullSafe(F.col("digest")), F.col("node")).otherwise(F.xxhash64("digest"))
    return materialize(signed.join(few, "node", "left").withColumn("node", new).select(signed.columns), "signatures")


# --------------------------------------------------------------------------- components
def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a graph and the least node of each one's component."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (deeper := new[new]).tobytes() != new.tobytes():
            new = deeper
        new = new[label]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.Table:
    nodes, root = _forest(a, b)
    use = nodes != root
    return pa.table({"a": pa.array(nodes[use], pa.int64()), "b": pa.array(root[use], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b), by repeated contraction.

    Each round maps a node to the least of itself and its neighbours and contracts the graph; node ids are
    hashes, so the graph shrinks by a constant factor a round. Only counts reach the driver.
    """
    edges, maps = materialize(edges.where("a <> b").distinct(), "edges"), []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "contraction")
        maps.append(least)
        of_a, of_b = least.select("a", F.col("p").alias("pa")), least.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = materialize(edges.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[0].select(F.col("a").alias("node"), F.col("p").alias("label"))
    for step in maps[1:]:
        labels = labels.join(step.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    return materialize(labels, "labels")


# --------------------------------------------------------------------------- candidates
def _spread(buckets: int):
    def spread(batches):
        """Rows (bucket, linked, payload): distinct band keys with one node each; further nodes of a key leave as local links."""
        for batch in batches:
            rows = column(batch, "bands")
            valid = np.asarray(rows.is_valid())
            if not valid.any():
                continue
            nodes = np.asarray(column(batch, "node"))[valid]
            keys = np.frombuffer(b"".join(rows.drop_null().to_pylist()), U64)
            nodes = np.repeat(nodes, BANDS)
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            new = np.append(True, keys[1:] != keys[:-1])
            hub = nodes[np.flatnonzero(new)][np.cumsum(new) - 1]
            b, p = [-1], [np.stack(_forest(hub[~new], nodes[~new])).tobytes()]
            keys, nodes = keys[new], nodes[new]
            for i, start, end in X.pieces(keys, 64, buckets):
                b.append(i)
                p.append(np.stack([keys[start:end].view(np.int64), nodes[start:end]]).tobytes())
            b = [int.from_bytes(x[:2], "little") % buckets if i < 0 else i for i, x in zip(b, p)]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([True] + [False] * (len(b) - 1)), pa.array(p, pa.binary())], ["bucket", "linked", "payload"])

    return spread


def _star_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links a, links b, keys, their least-met nodes) of one range of band keys."""
    none = np.zeros(0, np.int64)
    a, b, keys, nodes = [none], [none], [none], [none]
    for is_link, x in zip(column(table, "linked").to_pylist(), column(table, "payload").to_pylist()):
        left, right = np.frombuffer(x, np.int64).reshape(2, -1)
        (a if is_link else keys).append(left)
        (b if is_link else nodes).append(right)
    keys, nodes = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    hub = nodes[np.flatnonzero(new)][np.cumsum(new) - 1]
    return np.concatenate([*a, hub[~new]]), np.concatenate([*b, nodes[~new]]), keys[new], nodes[new]


def _thinned(table: pa.Table) -> pa.Table:
    """Some lists of one range as one list: a key that many tasks met keeps one node, the others leave as links."""
    a, b, keys, nodes = _star_lists(table)
    rows = [np.stack(_forest(a, b)), np.stack([keys, nodes])]
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * 2, pa.int32()), "linked": pa.array([True, False]), "payload": pa.array([x.tobytes() for x in rows], pa.binary())})


def _stars(table: pa.Table) -> pa.Table:
    """Candidate links of one range of band keys: a spanning forest."""
    return _edges(*_star_lists(table)[:2])


def _gather(batches):
    """The full sets of the candidates' representatives."""
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        expected, out, keep = np.asarray(column(batch, "node")), [], []
        for a, b in slices(offsets):
            sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            same = _node(sets, at) == expected[a:b]  # another text may go by the same id
            keep.append(same)
            out += [sets[i:j].tobytes() for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), same.tolist()) if ok]
        if out:
            use = pa.array(np.concatenate(keep))
            yield pa.RecordBatch.from_arrays([column(batch, "family").filter(use), column(batch, "node").filter(use), pa.array(out, pa.binary())], ["family", "node", "members"])


# --------------------------------------------------------------------------- exact links
def _matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each member that the vocabulary has."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = np.searchsorted(vocabulary, flat)
    found = col < len(vocabulary)
    found[found] = vocabulary[col[found]] == flat[found]
    return row[found], col[found]


def links(left: list[np.ndarray], right: list[np.ndarray], threshold: int = 75, width: int = 4096, height: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with 100 * |left_i & right_j| >= threshold * |left_i | right_j|, in blocks."""
    vocabulary = np.unique(np.concatenate(left))
    size_l = np.array([len(s) for s in left])
    lr, lc = _matrix(left, vocabulary)
    found_i, found_j = [], []
    for start in range(0, len(right), height):
        part = right[start : start + height]
        size_r = np.array([len(s) for s in part])
        rr, rc = _matrix(part, vocabulary)
        common = np.zeros((len(left), len(part)), np.int64)
        for at in range(0, len(vocabulary), width):
            w = min(width, len(vocabulary) - at)
            x, y = np.zeros((len(left), w), np.float32), np.zeros((len(part), w), np.float32)
            in_l, in_r = (lc >= at) & (lc < at + w), (rc >= at) & (rc < at + w)
            x[lr[in_l], lc[in_l] - at] = 1
            y[rr[in_r], rc[in_r] - at] = 1
            common += (x @ y.T).astype(np.int64)
        i, j = np.nonzero(100 * common >= threshold * (size_l[:, None] + size_r[None, :] - common))
        found_i.append(i)
        found_j.append(j + start)
    return np.concatenate(found_i), np.concatenate(found_j)


def _sets(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.asarray(column(table, "node")), [np.frombuffer(x, U64) for x in column(table, "members").to_pylist()]


def _link_small(table: pa.Table) -> pa.Table:
    """All links of whole families, as stars round each component's least node."""
    families = np.asarray(column(table, "family"))
    nodes, sets = _sets(table)
    order = np.argsort(families, kind="stable")
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows in np.split(order, np.flatnonzero(np.diff(families[order])) + 1):
        mine = [sets[r] for r in rows]
        i, j = links(mine, mine)
        a.append(nodes[rows[i]])
        b.append(nodes[rows[j]])
    return _edges(np.concatenate(a), np.concatenate(b))


def _link_blocks(queries: pa.Table, members: pa.Table) -> pa.Table:
    (q, left), (m, right) = _sets(queries), _sets(members)
    if not len(q) or not len(m):
        return _edges(np.zeros(0, np.int64), np.zeros(0, np.int64))
    i, j = links(left, right)
    return _edges(q[i], m[j])


def _key_rows(batches):
    """(family, block, key, out) of every band of every node."""
    for batch in batches:
        keys = np.frombuffer(b"".join(column(batch, "bands").to_pylist()), np.int64)
        which = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([*(column(batch, c).take(which) for c in ("family", "block", "out")), pa.array(keys, pa.int64())], ["family", "block", "out", "key"])


def _numbered(batches):
    """Adds ``block``: runs of ``BLOCK`` rows of one family and side, in the order they come."""
    task, block, n, last = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        out = []
        for mine in zip(column(batch, "family").to_pylist(), column(batch, "out").to_pylist()):
            if n == BLOCK or mine != last:
                block, n, last = block + 1, 0, mine
            out.append((task << 32) | block)
            n += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "block"])


def _against_sample(members: DataFrame, large: DataFrame) -> DataFrame:
    """Links of every member of a large family with a sampled block of its family."""
    sampled = members.join(large, "family").where(F.pmod(F.xxhash64("node", F.lit(3)), F.col("size")) < BLOCK // 2).select("family", "node", "members")
    deal = F.pmod(F.xxhash64("node", F.lit(2)), F.col("n")).cast("int").alias("m")
    sized = large.select("family", F.ceil(F.col("size") / (4 * BLOCK)).cast("int").alias("n"))
    one = sampled.join(sized, "family").select(F.col("family").alias("family"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("m"), F.col("node").alias("node"), F.col("members").alias("members"))
    two = members.join(sized, "family").select("family", deal, "node", "members")
    return one.groupBy("family", "m").cogroup(two.groupBy("family", "m")).applyInArrow(_link_blocks, "a long, b long")


def _against_neighbours(members: DataFrame, bands: DataFrame, label: DataFrame) -> DataFrame:
    """Links of nodes outside their family's largest component with all nodes that share a band with them.

    members: family, node, members; bands: node, bands; label: family, node, label, out. Nodes are sorted by
    family, side, component and first band into blocks, so that neighbours meet in few blocks; a band
    joins blocks, not nodes, and a pair of blocks is compared once however many bands it shares.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["family", "out", "label", F.substring("bands", 1, 8), "node"]
    dealt = label.join(bands, "node").repartitionByRange(n, *order).sortWithinPartitions(*order)
    kinds = dealt.schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", block long"
    dealt = materialize(dealt.mapInArrow(_numbered, schema), "blocks")
    keys = dealt.select("family", "block", "out", "bands").mapInArrow(_key_rows, "family long, block long, out boolean, key long").distinct()
    keys = materialize(keys, "block-bands")
    left, right = keys.where("out").select("key", F.col("block").alias("q")), keys.select("key", F.col("block").alias("m"))
    met = materialize(left.join(right, "key").select("q", "m").distinct(), "block-pairs")
    held = materialize(dealt.select("node", "block").join(members, "node").select("block", "node", "members"), "block-members")
    sides = []
    for own, other in (("q", "m"), ("m", "q")):  # new column ids a side: both stem from one table
        pairs = met.select(F.col(own).alias("block"), F.col(other).alias("other"))
        side = held.join(pairs, "block").select(F.col("block").alias(own), F.col("other").alias(other), F.col("node").alias("node"), F.col("members").alias("members"))
        sides.append(side.select("q", "m", "node", "members").groupBy("q", "m"))
    return sides[0].cogroup(sides[1]).applyInArrow(_link_blocks, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents whose 5-word shingle sets are linked at Jaccard similarity 0.75 or more.

    A-Z are lower-cased, words are runs of `[^\\x20\\x09-\\x0D]`; a text of 1 to 4 words is one shingle.
    Returns doc_id, n_shingles (distinct), component_id (least doc_id reachable), kept (doc_id is
    component_id), one row for each input row. Null, empty and blank texts have no shingles, link with
    nothing and are kept. Rows that repeat a doc_id share its verdict if their texts are alike. A null id
    counts for no component_id; a group of null ids only has a null component_id and is kept. Ids are of
    any type that has an order. Equal sets are told by a 64-bit sum and a 128-bit digest; links between
    different sets are always confirmed on full sets.
    """
    found = classes(docs)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each group of near-duplicates; rows without a shingle all stay.

    The row of least doc_id stays, an id before null; of different texts with that id the one of least
    MD5; of rows that repeat both, one. Verdicts go by doc_id and text, so another text under a dropped
    row's id isn't touched.
    """
    found = classes(docs).where("n_shingles > 0").select("doc_id", "text_key", "label")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"))
    found = found.join(first, "label").select("doc_id", "text_key", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("stays"))
    counted = materialize(found.groupBy("doc_id", "text_key").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "verdicts")
    gone, twice = (counted.where(c).select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")) for c in ("not stays", "stays"))
    key = F.md5(F.col("text").cast("binary"))
    here = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), key.alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_key") == F.col("of_key"))
    # The verdicts grow with the corpus: one plan at every size, rather than a broadcast while they are few.
    left = here.join(gone.hint("shuffle_hash"), same, "left_anti")
    if not twice.isEmpty():
        one = left.join(twice, same, "left_semi").dropDuplicates(["own_id", "own_key"])
        left = left.join(twice, same, "left_anti").union(one)
    return left.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (MD5), n_shingles, label (a node of the row's component, null without shingles), component_id; one row for each input row."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("text_key"), F.xxhash64("doc_id", "text").alias("r"))
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = materialize(source.mapInArrow(_sign, f"doc_id {kind}, text_key string, r long, n_shingles long, node long, digest binary, bands binary"), "signatures")
    signed = _told_apart(signed)
    n, nodes = signed.count(), signed.where("n_shingles > 0")
    # candidates
    spread = signed.select("node", "bands").mapInArrow(_spread(parts(n * BANDS, BUCKET_ENTRIES)), "bucket int, linked boolean, payload binary")
    salts = parts(n, BATCH_ROWS * LISTS)
    if salts > 1:
        spread = spread.groupBy("bucket", F.pmod(F.xxhash64("payload"), F.lit(salts)).alias("salt")).applyInArrow(_thinned, "bucket int, linked boolean, payload binary")
    family = components(spread.groupBy("bucket").applyInArrow(_stars, "a long, b long")).select("node", F.col("label").alias("family"))
    sizes = materialize(family.groupBy("family").agg(F.count("*").alias("size")), "families")
    chosen = nodes.groupBy("node", "r").agg(F.count("*").alias("copies")).groupBy("node").agg(F.min(F.struct("r", "copies")).alias("one")).select("node", "one.r", "one.copies")
    chosen = materialize(chosen.join(family, "node"), "chosen")
    texts = source.select("r", "text").join(chosen.where("copies = 1").hint("shuffle_hash"), "r").select("text", "family", "node")
    repeated = chosen.where("copies > 1")
    if not repeated.isEmpty():  # rows that repeat id and text give one set all the same
        texts = texts.union(source.select("r", "text").join(repeated.hint("shuffle_hash"), "r").select("text", "family", "node").dropDuplicates(["node", "text"]))
    members = materialize(texts.mapInArrow(_gather, "family long, node long, members binary"), "members", "snappy")
    # links: whole small families in bins
    bins = parts((members.agg(F.sum(F.octet_length("members"))).first()[0] or 0), BIN_BYTES)
    small = members.join(sizes.where(F.col("size") <= BLOCK), "family").withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(bins)).cast("int"))
    labels = small.select("bin", "family", "node", "members").groupBy("bin").applyInArrow(_link_small, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("label"))
    # links: large families, first against a sample, then what is left against its neighbours
    large = sizes.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        first = materialize(_against_sample(members, large), "links")
        label = members.join(large, "family").select("family", "node").join(components(first), "node", "left").withColumn("label", F.coalesce("label", "node"))
        main = label.groupBy("family", "label").count().groupBy("family").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        label = materialize(label.join(main, "family").select("family", "node", "label", (F.col("label") != F.col("main")).alias("out")), "sides")
        bands = nodes.join(chosen.select("node", "r"), ["node", "r"]).select("node", "bands").dropDuplicates(["node"])
        labels = labels.union(components(first.union(_against_neighbours(members, bands, label))))
    # the least id of each component
    found = nodes.groupBy("node").agg(F.min("doc_id").alias("id"))
    found = materialize(found.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label")), "classes")
    least = found.groupBy("label").agg(F.min("id").alias("component_id"))
    of = found.join(least, "label").select("node", "label", "component_id")
    shown = ("label", "component_id")
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(of, "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in shown))
