import hashlib
import re

from pyspark.sql import functions as F

from tickframe.llm.fill_middle import fill_digests, fill_in_middle, restored, unit_ends

from .cases import corpus, frame


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["\n", "\n\n", "a\n", "\na", "a\r\nb\x0bc\x85d e\n", "<P>", "a<S\nb>", "<\n<P\n>", "ends <", "é\n😀\nx\n" * 50, "\x00\n\x00", "x\n" * 20000, "<S", "$1\\1\n^"]


def cases():
    return corpus() + [(1000 + i, t, None, "s", None, "b", 1, 1) for i, t in enumerate(ODD * 3)]


def test_against_plain_cuts(spark):
    rows = cases()
    got = sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle(frame(spark, rows)).collect() if r.doc_id is not None)
    assert got == sorted((r[0], *plain(r[0], r[1])) for r in rows if r[0] is not None)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}


def test_digests_and_restoring(spark):
    rows = cases()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((digest(plain(r[0], r[1])[4]), digest(r[1] or "")) for r in rows)
    assert sorted((r.output_sha256, r.restored_sha256) for r in fill_digests(frame(spark, rows)).collect()) == want


def test_rate_and_other_ids(spark):
    docs = frame(spark, cases()).select(F.concat(F.lit("k"), F.coalesce("doc_id", F.lit(0)).cast("string")).alias("doc_id"), "text")
    some = fill_in_middle(docs, rate=40, spm_rate=0)
    forms = {r.form: r["count"] for r in some.groupBy("form").count().collect()}
    assert forms["psm"] > 0 and forms["plain"] > 30 and "spm" not in forms
    both = some.withColumn("back", restored()).alias("a").join(docs.dropDuplicates(["doc_id", "text"]).alias("b"), "doc_id").where("a.back = coalesce(b.text, '')")
    assert both.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_units_and_empty_table(spark):
    assert unit_ends("a\nbb\n\nc") == [2, 5, 6, 7] and unit_ends("") == []
    assert fill_digests(frame(spark, [])).collect() == []
