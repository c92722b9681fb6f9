import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickframe.llm import language_id as m

from tests.conftest import SF

from .cases import frame


def test_places_do_not_cross_rows():
    from tickframe.llm.common import utf8

    together, first = m.places(*utf8(pa.array(["ab", None, "c1é", "", "ABC"])))
    for i, t in enumerate(["ab", None, "c1é", "", "ABC"]):
        alone, _ = m.places(*utf8(pa.array([t], pa.string())))
        assert together[first[i] : first[i + 1]].tolist() == alone.tolist()


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(200, 5)), np.ones((200, 1))])
    y = np.where(x[:, 0] - 2 * x[:, 3] + 0.3 > 0, 1.0, -1.0)
    assert (np.sign(x @ m.svm(x, y)) == y).mean() > 0.97


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = m.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95


def test_cases(spark):
    text = {"en": "the house and the garden with this thing", "de": "das haus und der garten mit dem ding", "xx": "zzq qqz zqz"}
    rows = [(i, f"{text[l]} {i}", l, None, None, None, None, None) for i, l in enumerate(list(text) * 20)]
    rows += [(100, None, "en", *[None] * 5), (101, " 12 $ 😀", "de", *[None] * 5), (102, "", None, *[None] * 5), (None, "the garden", None, *[None] * 5), (103, "das haus", None, *[None] * 5), (103, "das haus", None, *[None] * 5)]
    got = sorted(((str(r.doc_id), r.lang_pred) for r in m.identify(frame(spark, rows)).collect()))
    want = [(str(r[0]), r[2]) for r in rows[:60]] + [("100", "und"), ("101", "und"), ("102", "und"), ("None", "en"), ("103", "de"), ("103", "de")]
    assert got == sorted(want)
    assert m.identified(frame(spark, rows)).count() == 63
    assert m.identify(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in m.identify(frame(spark, [(1, "text", *[None] * 6)])).collect()} == {"und"}
    assert {r.lang_pred for r in m.identify(frame(spark, [(1, "text", "en", *[None] * 5), (3, "more", "en", *[None] * 5)])).collect()} == {"en"}


def plain_prediction(text, model):
    """Language and score by dictionaries and loops, from the fitted weights."""
    data = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    own = [b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 else 32 for b in data]
    marks = []
    for i, b in enumerate(own):
        if b != 32:
            code = ((own[i - 1] if i else 32) << 16) | (b << 8) | (own[i + 1] if i + 1 < len(own) else 32)
            marks.append(((code * 2654435761) & 0xFFFFFFFF) >> 19)
    margin = [m.SCALE * sum(float(w[k]) for k in marks) / max(1, len(marks)) + float(w[-1]) for w in model.weights]
    sure = lambda x: 1 / (1 + math.exp(-max(-50.0, min(50.0, 3 * x))))
    families = margin[: len(model.families)]
    chosen = max(range(len(families)), key=lambda k: families[k])
    first, second = sorted(families, reverse=True)[:2]
    langs = [x for x in model.langs if m.family(x) == model.families[chosen]]
    duels = {p: margin[len(families) + k] for k, p in enumerate(model.pairs) if p[0] in langs}
    side = lambda x, p, v: v if p[0] == x else -v
    won = {x: sum((side(x, p, v) > 0) + 1e-6 * math.tanh(side(x, p, v)) for p, v in duels.items() if x in p) for x in langs}
    best = max(langs, key=lambda x: won[x])
    return best, sure((first - second) / 2) * min([sure(side(best, p, v)) for p, v in duels.items() if best in p], default=1.0)


def test_every_row_against_a_plain_prediction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = m.fit(docs)
    got = {r.doc_id: r for r in m.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, score = plain_prediction(r.text, model)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (lang, zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-6)


def test_stray_labels(spark):
    """Only the most frequent labels are learnt, or all of them where no number is given."""
    rows = [(i, f"{'der die und nicht' if i % 2 else 'the and of with'} {i}", "de" if i % 2 else "en", *[None] * 5) for i in range(80)] + [(100 + i, f"x{i}", f"stray{i}", *[None] * 5) for i in range(30)]
    held_in = [r[2] for r in rows[80:] if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert m.fit(frame(spark, rows), 2).langs == ["de", "en"]
    assert sorted(m.fit(frame(spark, rows), None).langs) == sorted(["de", "en", *held_in])


def test_documents_stay_and_texts_without_letters_go(spark):
    """The pipeline's language stage: every text with a letter stays, however short; others go."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**6, "", None), (10**6 + 1, None, None), (10**6 + 2, "12 - 34 !", None), (10**6 + 3, "oui", None), (10**6 + 4, "1 é", "fr")]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    kept = {r.doc_id for r in p.language_id(spark, both, SF).collect()}
    assert kept == {r.doc_id for r in both.collect() if any(c.isalpha() for c in r.text or "")}
