import corpus_pipeline as p
from tests.conftest import SF
from tickframe.llm import language_id, sentencepiece_sampling

from .cases import SCHEMA, corpus, frame
from .test_decontaminate import brute as contaminated
from .test_near_dedup import brute as groups
from .test_pii import brute as spans


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = language_id.fit(docs)
    got = p.language_id(spark, docs, SF).cache()
    assert got.columns == columns
    from tickframe.llm.common import utf8
    import pyarrow as pa

    rows = docs.collect()
    langs, scores = language_id.predictions(*utf8(pa.array([r.text for r in rows], pa.string())), model)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r, l, s in zip(rows, langs, scores) if l != "und" and s >= p.LEAST_SCORE}

    rows = got.collect()
    got = p.near_dedup(spark, got, SF).cache()
    assert got.columns == columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _, _, kept in groups([(r.doc_id, r.text) for r in rows]) if kept)

    rows = got.collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = p.decontamination(spark, got, SF).cache()
    assert got.columns == columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(b[0] for b in contaminated([(r.doc_id, r.text) for r in rows], items, 10) if not b[5])

    before = {r.doc_id: r.text for r in got.collect()}
    got = p.personal_data(spark, got, SF).cache()
    assert got.columns == columns
    for r in got.collect():
        assert spans(r.text) == [], r.text
        assert r.n_chars == len(r.text)
        if not spans(before[r.doc_id]) and "[" not in r.text:
            assert r.text == before[r.doc_id]

    out = p.pieces(spark, got, SF).collect()
    lattice = next(iter(sentencepiece_sampling._LOADED.values()), None) or sentencepiece_sampling.load(p.public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in got.collect()}
    assert len(out) == len(texts)
    assert all(r.lossless and lattice.decode(r.ids) == texts[r.doc_id] and r.n_pieces == len(r.ids) for r in out)
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, out))


def test_odd_rows(spark):
    rows = corpus(4)
    docs = frame(spark, rows)
    for name, stage in p.STAGES[1:]:
        docs = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert docs.columns == SCHEMA.names
    kept = [r.doc_id for r in docs.collect()]
    assert kept.count(5) <= 1 and len(kept) > 20
    for name, stage in p.STAGES:
        assert stage(spark, frame(spark, []), SF).count() == 0


def test_the_told_language_reaches_the_result(spark, tmp_path):
    """Missing and wrong labels give way to the language that the first stage tells, for every document of the result."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("doc_id") % 10 == 5, "xx").otherwise(F.col("lang"))
    docs.withColumn("lang", label).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    made = spark.read.parquet(str(tmp_path / "documents.parquet"))
    told = {r.doc_id: r.lang_pred for r in language_id.identify(made).collect()}
    got = {r.doc_id: r.lang for r in p.run(spark, str(tmp_path)).collect()}
    assert got and got == {d: told[d] for d in got}
    given = {r.doc_id: r.lang for r in made.collect()}
    assert any(given[d] is None for d in got) and any(given[d] != got[d] for d in got if given[d])
