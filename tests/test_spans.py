"""Work on spans of a key: cut at every place, it gives what a plain walk over the whole key gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import align, bars, book, rolling, spans

WIDTHS = [1, 3, 1000]


@pytest.fixture(params=WIDTHS)
def width(request, monkeypatch):
    monkeypatch.setattr(spans, "SPAN_ROWS", request.param)
    return request.param


def walk(values, alpha, start=None):
    now, out = start, []
    for v in values:
        if v is not None and not math.isnan(v):
            now = v if now is None else (1 - alpha) * now + alpha * v
        out.append(now)
    return out


def near(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("seed", [None, 5.0])
def test_averages_cut_anywhere(spark, width, seed):
    rng, rows = random.Random(width), []
    for stem, n in (("a", 17), ("b", 1), (None, 4), ("all null", 3)):
        at = -5
        for _ in range(n):
            at += rng.choice([1, 1, 2, 9])
            rows.append((stem, at, None if stem == "all null" else rng.choice([None, float("nan"), *[rng.gauss(0, 3) for _ in range(6)]])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stem string, bar_index long, v double").repartition(3)
    got = rolling.ewma(df, {"x": "v"}, alpha=0.3, seeds={"x": seed} if seed is not None else None).collect()
    assert len(got) == len(rows)
    for stem in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.stem == stem), key=lambda r: r.bar_index)
        for r, want in zip(mine, walk([r.v for r in mine], 0.3, seed), strict=True):
            assert near(None if r.x is None or math.isnan(r.x) else r.x, want)


def test_divisors_and_turns_cut_anywhere(spark, width):
    rng = random.Random(2)
    rows = [(i * 2, rng.uniform(1, 9), rng.uniform(1, 9), rng.uniform(1, 9)) for i in range(23)]
    df = spark.createDataFrame([("s", *r) for r in rows], "stem string, bar_index long, v double, add double, cancel double")
    got = rolling.channels(df, {"n": "v"}, {"f": ("add", "cancel")}, alpha=0.2).orderBy("bar_index").collect()
    before = [1.0, *walk([r[1] for r in rows], 0.2)]
    both = [x for r in rows for x in r[2:]]
    turns = [1.0, *walk(both, 0.2)]
    for i, r in enumerate(got):
        assert math.isclose(r.n_div, before[i] + 1e-12, rel_tol=1e-9) and math.isclose(r.n_rel, rows[i][1] / (before[i] + 1e-12), rel_tol=1e-9)
        assert math.isclose(r.f_add_rel, both[2 * i] / (turns[2 * i] + 1e-12), rel_tol=1e-9) and math.isclose(r.f_cancel_rel, both[2 * i + 1] / (turns[2 * i + 1] + 1e-12), rel_tol=1e-9)


def test_no_group_holds_a_stem(spark, monkeypatch):
    """One stem of 600 rows in spans of 50: as many groups, in several partitions."""
    monkeypatch.setattr(spans, "SPAN_ROWS", 50)
    df = spark.range(600).select(F.lit("s").alias("stem"), F.col("id").alias("bar_index"), F.col("id").cast("double").alias("v"))
    dealt = spans.in_spans(df, "bar_index").repartition(8, "stem", spans.SPAN).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(dealt) > 3 and max(r.n for r in dealt) < 600
    plan = rolling.ewma(df, {"x": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow [stem" in plan and "_span" in plan.split("FlatMapCoGroupsInArrow [stem")[1][:80]


def test_bars_and_books_cut_anywhere(spark, width):
    rng, rows, ts = random.Random(7), [], 0
    for i in range(120):
        ts += rng.choice([0, 1, 5, -4, 30]) * 10**9
        rows.append((rng.choice("ab"), i, ts, "L2" if rng.random() < 0.8 else "L1", rng.choice(["bid", "ask"]), rng.choice(["add", "update", "remove"]), rng.randrange(4), float(rng.randint(90, 110)), float(rng.randint(1, 9))))
    df = spark.createDataFrame(rows, "stem string, seq long, ts_ns long, kind string, side string, op string, lvl int, price double, size double").repartition(4)
    seen, latest = {}, {}
    want_bars, want_books, want_old = [], [], []
    first = {}
    for stem, seq, t, kind, side, op, lvl, px, sz in rows:
        latest[stem] = max(latest.get(stem, t), t)
        number = int(latest[stem] / (10 * 10**9))
        want_bars.append((seq, number, number - first.setdefault(stem, number)))
        if kind != "L2":
            continue
        state = seen.setdefault(stem, {})
        old = state.get((side, lvl), (0.0, 0.0))
        state[side, lvl] = (0.0, 0.0) if op == "remove" else (px, sz)
        want_books.append((seq, *([state.get((s, k), (0.0, 0.0)) for k in range(3)] for s in ("bid", "ask"))))
        if lvl < 3:
            moved = op == "remove" or op == "update" and abs(px - old[0]) > 1e-9
            cancel = old[1] if moved else old[1] - sz if op == "update" and sz < old[1] else 0
            add = sz if op == "add" or op == "update" and moved else sz - old[1] if op == "update" and sz > old[1] else 0
            want_old += [(seq, k, x) for k, x in ((0, cancel), (1, add)) if x > 0]
    assert sorted((r.seq, r.bar_id, r.bar_index) for r in bars.assign_bars(df, 10).collect()) == want_bars
    got = sorted((r.seq, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in book.book_state(df, 3).collect())
    assert got == want_books
    assert sorted((r.seq, r.sub, r.size) for r in book.order_flow(df, 3).collect()) == want_old


def test_struct_order(spark, width):
    """Lines of files are ordered by (block, line): spans never join blocks, and the result is that of whole numbers."""
    rng, rows = random.Random(11), []
    for i in range(90):
        rows.append(("s", i, i // 40 * 1000, i, rng.choice([0, 3, 25, -6]) * 10**9 + i * 10**9, "L2", rng.choice(["bid", "ask"]), rng.choice(["add", "update", "remove"]), rng.randrange(2), float(rng.randint(90, 99)), float(rng.randint(1, 9))))
    df = spark.createDataFrame(rows, "stem string, i long, block long, line long, ts_ns long, kind string, side string, op string, lvl int, price double, size double").repartition(3)
    whole, parts = df.withColumn("seq", F.col("i")), df.withColumn("seq", F.struct("block", "line"))
    for f, names in ((lambda x: bars.assign_bars(x, 10), ("i", "bar_id", "bar_index")), (lambda x: book.book_state(x, 2), ("i", "bids", "asks"))):
        keep = lambda x: sorted(tuple(map(str, r)) for r in f(x).select(*names).collect())  # noqa: B023, E731
        assert keep(parts) == keep(whole)
    assert sorted((r.seq.line, r.sub, r.size) for r in book.order_flow(parts, 2).collect()) == sorted((r.seq, r.sub, r.size) for r in book.order_flow(whole, 2).collect())


def test_rolled_up_bars_equal_bars_of_the_series(spark):
    rng, ts, rows = random.Random(9), 0, []
    for i in range(200):
        ts += rng.choice([-20, 1, 7, 45]) * 10**9
        rows.append(("d", i, ts, rng.randint(1, 400) / 4))
    series = spark.createDataFrame(rows, "stem string, seq long, ts_ns long, price double")
    want = bars.price_bars(series, 60)
    got = bars.rolled_up(bars.price_bars(series, 10), 6, 60)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("accuracy", [2, 10_000])
def test_nearest_ranks(spark, monkeypatch, accuracy):
    """Exact whatever the sketch brackets, with ties, few values and a null key."""
    monkeypatch.setattr(rolling, "ACCURACY", accuracy)
    rng, rows = random.Random(accuracy), []
    for key, values in {"wide": [rng.gauss(0, 1e6) for _ in range(500)], "ties": [float(rng.randrange(3)) for _ in range(300)], "one": [4.0], "two": [2.0, 1.0], None: [3.0, 1.0, 2.0, 5.0]}.items():
        rows += [(key, v) for v in values]
    df = spark.createDataFrame(rows, "key string, value double").repartition(5)
    shares = (0.0, 0.33, 0.66, 1.0)
    got = {r.key: (r.n, list(r.ranks)) for r in rolling.nearest_ranks(df, ("key",), shares).collect()}
    for key in {r[0] for r in rows}:
        known = sorted(v for k, v in rows if k == key)
        assert got[key] == (len(known), [known[int((len(known) - 1) * p + 0.5)] for p in shares])


def test_regimes_keep_rows_and_columns(spark):
    rows = [("s", i, float(x), "extra") for i, x in enumerate([5, 1, 3, float("inf"), 2, 4])] + [("t", 0, 1.0, None), (None, 0, 2.0, None)]
    df = spark.createDataFrame(rows, "stem string, bar_index long, m double, n string")
    out = rolling.with_regimes(df, {"m": F.col("m"), "r": F.col("m") * -1})
    got = {(r.stem, r.bar_index): (r.m, r.r, r.n) for r in out.collect()}
    # five finite values: ranks int(4 * .33 + .5) = 1 and int(4 * .66 + .5) = 3
    assert [got["s", i][0] for i in range(6)] == [1.0, -1.0, 0.0, 0.0, 0.0, 0.0] and got["t", 0][:2] == (0.0, 0.0) and got[None, 0][:2] == (0.0, 0.0) and len(got) == len(rows) and got["s", 0][2] == "extra"


@pytest.mark.parametrize("hot", [5, 10**6])
@pytest.mark.parametrize("right_first", [True, False])
def test_as_of_of_a_hot_key(spark, monkeypatch, hot, right_first):
    monkeypatch.setattr(align, "HOT_ROWS", hot)
    rng = random.Random(hot)
    key = lambda: rng.choice(["hot"] * 6 + ["cold", "left only", None])
    left = [(key(), i, rng.choice([None, *range(40)]) if i % 9 == 0 else rng.randrange(200)) for i in range(250)]
    right, used = [], set()
    for i in range(120):
        k, t = rng.choice(["hot", "hot", "hot", "cold", "right only", None]), rng.randrange(200)
        if (k, t) not in used:
            used.add((k, t))
            right.append((k, t, f"r{i}", i))
    l = spark.createDataFrame(left, "k string, id long, at long").repartition(3)
    r = spark.createDataFrame(right, "k string, when long, name string, n long").repartition(3)
    got = {x.id: (x.k, x.name, x.n) for x in align.as_of(l, r, ["name", "n"], keys=("k",), left_on="at", right_on="when", right_first=right_first).collect()}
    assert len(got) == len(left)
    for k, i, at in left:
        ok = [x for x in right if x[0] == k and at is not None and (x[1] <= at if right_first else x[1] < at)]
        best = max(ok, key=lambda x: x[1], default=(None,) * 4)
        assert got[i] == (k, best[2], best[3])
    if hot == 5:
        cut = align._cut_by_time(l.select("k", F.col("at").alias("_at"), F.lit(1).alias("_side"), F.struct("id").alias("_row"), F.lit(None).cast("string").alias("_hit")), ("k",))
        of = {x.k: x.n for x in cut.groupBy("k").agg(F.countDistinct(spans.SPAN).alias("n")).collect()}
        assert of["hot"] > 3


@pytest.mark.parametrize("width", [1, 7, None])
def test_filling_cut_anywhere(spark, width):
    rng = random.Random(3)
    rows = [(s, i, rng.choice([None, None, rng.randrange(9)]), None if s == "b" else rng.choice([None, "x", "y"])) for s in ("a", "b", None) for i in range(20)]
    df = spark.createDataFrame(rows, "stem string, start_timestamp_ns long, `v@mid` long, w string").repartition(4)
    got = align.fill_both_ways(df, ["v@mid", "w"], width=width)
    assert got.columns == df.columns
    want = []
    for s in ("a", "b", None):
        mine = [list(r) for r in rows if r[0] == s]
        for c in (2, 3):
            for step in (mine, mine[::-1]):
                now = None
                for r in step:
                    now = r[c] if r[c] is not None else now
                    r[c] = now if r[c] is None else r[c]
        want += [tuple(r) for r in mine]
    order = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
