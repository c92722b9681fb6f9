import uuid

import numpy as np

from tickframe.operators import score, simulate

NS = 10**9


def row(i, ts, price, high, low, up, down):
    return (i, ts * NS, float(price), float(high), float(low), up, down)


def test_replay_rules():
    rows = [
        row(0, 1000, 100, 101, 99, 0.9, 0.1),  # opens up
        row(1, 1100, 105, 120, 104, 0.9, 0.1),  # triggers inside the 600 s: passed over although profit was there
        row(2, 1200, 105, 106, 104, 0.1, 0.2),  # nothing
        row(3, 1300, 111, 111, 80, 0.1, 0.2),  # both sides touched: profit first
        row(4, 2000, 100, 101, 99, 0.2, 0.9),  # triggers, but an entry was under two hours ago
        row(5, 9000, 100, 100, 89, 0.9, 0.9),  # opens up (equal), stopped on its own row
    ]
    done = simulate.replay_run(rows, 0.8, 10, 10)
    assert [(t[1], t[3], t[6], t[8], t[9]) for t in done] == [("up", 0, 3, "win", 10), ("up", 5, 5, "loss", -10)]


def test_sweep_equals_single_runs(spark):
    rng = np.random.default_rng(1)
    price = 100 + np.cumsum(rng.normal(0, 2, 500))
    rows = [(i, int(i * 300 * NS), float(p), float(p + rng.random() * 5), float(p - rng.random() * 5), float(rng.random()), float(rng.random())) for i, p in enumerate(price)]
    pred = spark.createDataFrame(rows, "row long, ts_ns long, price double, high double, low double, up_prob double, down_prob double")
    sweep = simulate.sweep_of(spark, [0.6, 0.8], [5, 10], [5])
    got = simulate.replay(pred, sweep).collect()
    for c in sweep.collect():
        want = simulate.replay_run(rows, c.threshold, c["take"], c.stop)
        assert [(r.entry_row, r.exit_row, r.result) for r in sorted((r for r in got if r.combo == c.combo), key=lambda r: r.id)] == [(t[3], t[6], t[8]) for t in want]
    s = simulate.trade_summary(simulate.replay(pred, sweep), ("combo",)).collect()
    assert all(r.total == r.wins + r.losses == r.up + r.down for r in s)


def test_replay_by_cells(spark, tmp_path, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin as Grouped

    rng = np.random.default_rng(8)
    plain = Grouped.applyInPandas

    def watched(self, f, schema):
        def run(pdf):
            (tmp_path / f"{uuid.uuid4().hex}-{len(pdf)}").touch()
            return f(pdf)

        return plain(self, run, schema)

    monkeypatch.setattr(Grouped, "applyInPandas", watched)
    wanted = "row long, ts_ns long, price double, high double, low double, up_prob double, down_prob double"
    for first, step in ((-3_000, 20), (1, 7), (50_000, 97), (10, 700)):
        ts = first + np.cumsum(rng.choice([0, step, step, 2 * step], 3000))
        price = 100 + np.cumsum(rng.normal(0, 1, 3000))
        price[rng.random(3000) < 0.02] = np.nan
        up, down = rng.random(3000), rng.random(3000)
        up[5::50] = np.nan
        rows = [(i, int(ts[i]) * NS, float(price[i]), float(price[i] + rng.random() * 3), float(price[i] - rng.random() * 3), float(up[i]), float(down[i])) for i in range(3000)]
        sweep = simulate.sweep_of(spark, [0.3, 0.9, 0.995], [2, 15], [2, 10])
        got = simulate.replay(spark.createDataFrame(rows, wanted).repartition(4), sweep).collect()
        total = 0
        for c in sweep.collect():
            want = simulate.replay_run(rows, c.threshold, c["take"], c.stop)
            assert sorted(tuple(r)[4:] for r in got if r.combo == c.combo) == want
            total += len(want)
        assert total == len(got) > 0
        if step == 20:  # no group holds the whole series
            assert 0 < max(int(p.name.split("-")[1]) for p in tmp_path.iterdir()) < 1000


def test_replay_keeps_series_apart(spark):
    rng, rows = np.random.default_rng(3), {}
    for stem in ("a", "b"):
        price = 100 + np.cumsum(rng.normal(0, 2, 400))
        rows[stem] = [(i, (i + 1) * 40 * NS, float(price[i]), float(price[i] + 1), float(price[i] - 1), float(rng.random()), float(rng.random())) for i in range(400)]
    schema = "stem string, row long, ts_ns long, price double, high double, low double, up_prob double, down_prob double"
    sweep = simulate.sweep_of(spark, [0.5], [5], [5])
    got = simulate.replay(spark.createDataFrame([(s, *r) for s in rows for r in rows[s]], schema), sweep, ("stem", "combo")).collect()
    for stem in rows:
        want = simulate.replay_run(rows[stem], 0.5, 5.0, 5.0)
        assert want and sorted(tuple(r)[5:] for r in got if r.stem == stem) == want


def test_first_touch_sweep_against_pairs():
    from tickframe.operators.labels import _sweep

    rng = np.random.default_rng(2)
    close = 100 + np.cumsum(rng.normal(0, 1, 200))
    high, low = close + rng.random(200), close - rng.random(200)
    y, e = _sweep(high, low, close, 1.5, 2.0, 20)
    for i in range(200):
        want, at = 1, min(i + 20, 199)
        for j in range(i + 1, min(i + 20, 199) + 1):
            up, down = high[j] >= close[i] + 1.5, low[j] <= close[i] - 2.0
            if up or down:
                want, at = (1 if up and down else 2 if up else 0), j
                break
        assert (y[i], e[i]) == (want, at)


def test_first_touch_by_runs():
    from tickframe.operators.labels import _first

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 300):
        v = np.round(rng.normal(0, 3, n))
        for top in (True, False):
            t = v + 4 if top else v - 4
            want = [next((j for j in range(i + 1, n) if (v[j] >= t[i] if top else v[j] <= t[i])), n) for i in range(n)]
            assert _first(v, t, top).tolist() == want


def test_touches_of_a_log_file(spark, tmp_path):
    from tickframe.operators.labels import touch_events
    from tickframe.sources import logs

    (tmp_path / "d.csv").write_text("\n".join(f"L1;0;202301010000{i:02d};0;{100 + i * 7 % 13};1" for i in range(60)))
    got = touch_events(logs.parse(logs.read_lines(spark, str(tmp_path))), 2, 2, 10 * 10**9).orderBy("seq").collect()
    price = [r.price for r in got]
    for i, r in enumerate(got):
        hit = next((j for j in range(i + 1, min(i + 10, 59) + 1) if abs(price[j] - price[i]) >= 2), None)
        assert r.outcome == ("flat" if hit is None else "up" if price[hit] > price[i] else "down")
        assert r.exit_seq == (None if hit is None else got[hit].seq)


def test_convolution_is_causal():
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(2, 3, 10)), rng.normal(size=(4, 3, 2))
    out = score.causal_convolution(x, w, np.zeros(4), 2)
    for t in range(10):
        past = x[:, :, t - 2] if t >= 2 else np.zeros((2, 3))
        assert np.allclose(out[:, :, t], past @ w[:, :, 0].T + x[:, :, t] @ w[:, :, 1].T)


def test_logistic_baseline(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), 1 if a + b < 0.3 else 2) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    model = score.logistic_baseline(df, ["a", "b"], "label")
    assert model.transform(df.withColumn("_y", (df.label != 1).cast("double"))).where("prediction = _y").count() > 280


def test_cooldown_triggers_of_ties_and_missing_times(spark):
    """Of rows at one time one triggers; a row at the very end of the wait does; without a wait all do; rows without a time never."""
    from tickframe.operators.simulate import cooldown_triggers

    rows = [("a", t, label) for t, label in ((5, 2), (5, 0), (9, 2), (15, 0), (16, 1), (25, 2), (None, 2))] + [("b", None, 0), ("b", -3, 0)]
    table = spark.createDataFrame(rows, "stem string, ts_ns long, label int")
    got = lambda wait: sorted((r.stem, r.ts_ns) for r in cooldown_triggers(table, wait).collect())
    assert got(10) == [("a", 5), ("a", 15), ("a", 25), ("b", -3)]
    assert got(0) == [("a", 5), ("a", 5), ("a", 9), ("a", 15), ("a", 25), ("b", -3)]
