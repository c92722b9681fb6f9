"""Language identification in two levels: the language family first, then one-versus-one linear support
vector machines between the languages of that family.

Features are relative frequencies of byte trigrams round letters (A-Z lower-cased, other ASCII as blanks),
hashed to ``DIMENSIONS``. A linear model's margin is then a mean of weights over a text's places, so whole
texts of any length are scored by lookup, without feature vectors.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, slices, small_batches, utf8

DIMENSIONS = 1 << 13
#: Documents a language of the fitting sample, and of all languages together.
SAMPLE, SAMPLE_ALL = 500, 6000
#: Labels that are learnt unless ``fit`` is told otherwise, the most frequent ones: a column of stray labels does not make a model each.
MOST_LABELS = 200
SCALE, COST, EPOCHS = 40.0, 8.0, 40
# Families of ISO 639-1 codes; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi mr ne bn ur pa gu",
    "celtic": "ga cy br gd",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[[i for i in range(128) if not (65 <= i < 91 or 97 <= i < 123)]] = 32


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram of each place that is not blank, each row's first place)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    own = _MAP[data].astype(np.uint32)
    before, after = np.empty_like(own), np.empty_like(own)
    before[0], before[1:] = 32, own[:-1]
    after[-1], after[:-1] = 32, own[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    before[inner] = 32
    after[inner - 1] = 32
    at = np.flatnonzero(own != 32)
    code = (before[at] << np.uint32(16)) | (own[at] << np.uint32(8)) | after[at]
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64), np.searchsorted(at, offsets)


def _vectors(batches):
    for batch in batches:
        rows = []
        data, offsets = utf8(column(batch, "text"))
        for a, b in slices(offsets):
            hashed, first = places(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(b - a):
                used, n = np.unique(hashed[first[i] : first[i + 1]], return_counts=True)
                rows.append((used.astype(np.uint16).tobytes(), n.astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "h"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "h", "used", "n"])


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss, by dual coordinate descent."""
    rng, n = np.random.default_rng(7), len(x)
    weight = COST * n / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))  # equal say for both sides
    square = np.einsum("ij,ij->i", x, x) + 1 / (2 * weight)
    w, alpha = np.zeros(x.shape[1]), np.zeros(n)
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * weight[i])) / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """families x weights, and weights of each pair of languages of one family."""

    def __init__(self, labels: list[str], x: np.ndarray):
        self.langs = sorted(set(labels))
        self.families = sorted({family(l) for l in self.langs})
        lab, fam = np.array(labels), np.array([family(l) for l in labels])
        self.pairs = [(a, b) for f in self.families for a, b in combinations([l for l in self.langs if family(l) == f], 2)]
        columns = [svm(x, np.where(fam == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        for a, b in self.pairs:
            use = (lab == a) | (lab == b)
            columns.append(svm(x[use], np.where(lab[use] == a, 1.0, -1.0)))
        self.weights = np.array(columns) if columns else np.zeros((0, x.shape[1]))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each row."""
        hashed, first = places(data, offsets)
        rows, n = len(offsets) - 1, np.maximum(np.diff(first), 1)
        margins = np.zeros((rows, len(self.weights)))
        full = np.flatnonzero(np.diff(first) > 0)
        for k, w in enumerate(self.weights):
            if len(full):
                margins[full, k] = np.add.reduceat(w[:-1][hashed], first[:-1][full])
            margins[:, k] = SCALE * margins[:, k] / n + w[-1]
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
        many = len(self.families) if len(self.families) > 1 else 0
        if many:
            order = np.sort(margins[:, :many], axis=1)
            chosen, score = margins[:, :many].argmax(1), sure((order[:, -1] - order[:, -2]) / 2)
        else:
            chosen, score = np.zeros(rows, np.int64), np.ones(rows)
        out = np.zeros(rows, np.int64)
        for f, name in enumerate(self.families):
            mine = np.flatnonzero(chosen == f)
            langs = [l for l in self.langs if family(l) == name]
            votes, against = np.zeros((len(mine), len(langs))), np.ones((len(mine), len(langs)))
            for k, (a, b) in enumerate(self.pairs):
                if family(a) != name:
                    continue
                m = margins[mine, many + k]
                for lang, side in ((a, m), (b, -m)):
                    at = langs.index(lang)
                    votes[:, at] += (side > 0) + 1e-6 * np.tanh(side)
                    against[:, at] = np.minimum(against[:, at], sure(side))
            best = votes.argmax(1)
            out[mine] = np.array([self.langs.index(l) for l in langs])[best]
            score[mine] *= against[np.arange(len(mine)), best]
        return out, score


def remainder() -> Column:
    """crc32 of doc_id as text, modulo 4; documents of remainder 2 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, most_labels: int | None = MOST_LABELS) -> Model | None:
    """Fit on at most ``SAMPLE`` documents a language and ``SAMPLE_ALL`` in all, drawn by a hash of doc_id from those not
    held out, for the ``most_labels`` most frequent languages (ties by name), or, where it is None, for all of them: the driver then
    counts every label, and the sample has at least one document of each."""
    rows = docs.select("doc_id", "text", "lang").where((remainder() != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = {r.lang: r["count"] for r in (counted if most_labels is None else counted.limit(most_labels)).collect()}
    if not counts:
        return None
    each = max(1, min(SAMPLE, SAMPLE_ALL // len(counts)))
    whole = 1 << 30
    share = F.create_map([F.lit(x) for k, n in counts.items() for x in (k, min(whole, int(1.2 * whole * each / n) + 1))])
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(whole))).where(F.col("h") < share[F.col("lang")])
    found = rows.select("text", "lang", "h").mapInArrow(_vectors, "lang string, h long, used binary, n binary").collect()
    kept, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(found, key=lambda r: (r.lang, r.h, r.used, r.n)):
        if r.n and taken[r.lang] < each:
            taken[r.lang] += 1
            kept.append(r)
    if not kept:
        return None
    x = np.zeros((len(kept), DIMENSIONS + 1), np.float32)
    for i, r in enumerate(kept):
        n = np.frombuffer(r.n, np.uint32)
        x[i, np.frombuffer(r.used, np.uint16)] = SCALE * n / n.sum()
    x[:, -1] = 1
    return Model([r.lang for r in kept], x)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lower = data | 32
    ascii_ = np.append(0, np.cumsum((lower >= 97) & (lower < 123)))
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predictions(data: np.ndarray, offsets: np.ndarray, model: Model | None) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for a, b in slices(offsets):
        body, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        known = _has_letter(body, at) if model else np.zeros(b - a, bool)
        best, score = model.predict(body, at) if model else (known, known)
        langs += [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
        scores += [float(s) if ok else 0.0 for s, ok in zip(score.tolist(), known.tolist())]
    return langs, scores


def _predict(shared):
    def predict(batches):
        for batch in batches:
            langs, scores = predictions(*utf8(column(batch, "text")), shared.value)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; one row for each input row.

    Without ``model`` one is fitted on documents that are not held out. Null texts and texts without a
    letter are ``und`` with score 0, and so is all if no labelled text was there to learn from. The score is
    the family's confidence times the least of the chosen language's pairwise confidences. Columns other
    than doc_id, text and (for fitting) lang are left aside; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # bounded: DIMENSIONS weights a pair of languages
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", (remainder() == 2).alias("held_out")).select("doc_id", "held_out", "text").mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _keep(shared, least: float, into: str | None):
    def keep(batches):
        for batch in batches:
            langs, scores = predictions(*utf8(column(batch, "text")), shared.value)
            if into:
                at = batch.schema.get_field_index(into)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(langs, batch.schema.field(at).type))
            yield batch.filter(pa.array([l != "und" and s >= least for l, s in zip(langs, scores)], pa.bool_()))

    return keep


def identified(docs: DataFrame, least: float = 0.0, model: Model | None = None, into: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with a score of ``least`` or more; the string column ``into`` takes the language."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return docs.mapInArrow(_keep(shared, least, into), docs.schema)
