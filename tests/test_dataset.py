import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import dataset, profile, score, simulate
from tickframe.session import shared_dir


def next_fit(sizes, most):
    out, number, filled = [], 0, 0
    for s in sizes:
        s = max(s, 1)
        if filled and filled + s > most:
            number, filled = number + 1, 0
        out.append(number)
        filled += s
        if filled >= most:
            number, filled = number + 1, 0
    return out


def test_packing(spark):
    rng = random.Random(1)
    rows = [("ab"[i % 2], f"p{i:03d}", rng.choice([0, 1, 3, 6, 10, 25])) for i in range(120)]
    files = spark.createDataFrame(rows, "kind string, path string, bytes long")
    for most in (1, 10, 12, 100):
        got = [r.chunk for r in dataset.packed_into_chunks(files, most).orderBy("path").collect()]
        assert got == next_fit([r[2] for r in rows], most)
        by = dataset.packed_into_chunks(files, most, keys=("kind",)).orderBy("path").collect()
        assert [r.chunk for r in by if r.kind == "a"] == next_fit([r[2] for r in rows if r[0] == "a"], most)
    assert [r.chunk for r in dataset.packed_into_chunks(files.where("bytes = 6").limit(4), 10).orderBy("path").collect()] == [0, 1, 2, 3]
    assert dataset.packed_into_chunks(files.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        dataset.packed_into_chunks(files, 0)


def test_orders_and_caps(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    order = [r.id for r in dataset.shuffled(df, 3).collect()]
    assert order == [r.id for r in dataset.shuffled(df.repartition(13), 3).collect()] != sorted(order)
    assert order != [r.id for r in dataset.shuffled(df, 4).collect()]
    files = spark.createDataFrame([(f"f{i}",) for i in range(9)], "path string")
    assert [r.path for r in dataset.first_files(files, 3).collect()] == ["f0", "f1", "f2"] and dataset.first_files(files, 0).count() == 9
    assert sorted(r.id for r in dataset.capped(df, 10, ("id",)).collect()) == list(range(10))


def test_large_values_keep_their_deviation(spark):
    df = spark.range(1000).select((F.lit(1e9) + F.col("id") % 3).alias("x"))
    assert dataset.feature_stats(df, ["x"]).first().x_std == pytest.approx((2 / 3) ** 0.5, rel=1e-3)


@pytest.mark.parametrize("values", [7, 250_000])
def test_quantiles_over_ranges(spark, monkeypatch, values):
    """Against sorting, with repeats, few values, nulls and a column of nulls only; alike for many ranges and one."""
    monkeypatch.setattr(profile, "RANGE_VALUES", values)
    rng = random.Random(2)
    rows = [(float(rng.randrange(300)), rng.choice([1.0, 2.0, None]), None) for _ in range(2000)]
    got = {r.column: r for r in profile.profile(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    for i, name in enumerate("ab"):
        v = sorted(r[i] for r in rows if r[i] is not None)
        for q in profile.QUANTILES:
            at = q * (len(v) - 1)
            lo, hi = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert got[name][f"p{round(100 * q):02d}"] == pytest.approx(lo + (hi - lo) * (at - int(at)))
        mean = sum(v) / len(v)
        assert got[name]["mean"] == pytest.approx(mean) and got[name]["std"] == pytest.approx((sum((x - mean) ** 2 for x in v) / (len(v) - 1)) ** 0.5)
    assert (got["c"]["rows"], got["c"]["nulls"], got["c"]["n_unique"], got["c"]["p50"]) == (2000, 2000, 0, None)


def test_sweeps(spark):
    listed = [{"threshold": 0.6, "tp": 10, "sl": 5}, {"threshold": "0.7", "take_profit": 20, "stop_loss": 8, "tp": 1}]
    want = [(0, 0.6, 10.0, 5.0), (1, 0.7, 20.0, 8.0)]
    for config in (listed, {"combinations": listed}):
        assert [tuple(r) for r in simulate.sweep_from(spark, config).orderBy("combo").collect()] == want
    for bad in ([], {}, {"combinations": []}, [1], [{"tp": 1, "sl": 1}], [{"threshold": 0.5, "tp": 1}]):
        with pytest.raises(ValueError):
            simulate.sweep_from(spark, bad)
    assert sorted(r.threshold for r in simulate.thresholds(spark, [0.5, 0.6], 0.5).collect()) == [0.5, 0.6]
    assert simulate.sweep_index(simulate.sweep_from(spark, listed), "/out").orderBy("combo").first().log_path == "/out/combo=0/log"


def test_model_bundle(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    block = lambda i, o: {"w1": rng.normal(size=(o, i, 2)), "b1": np.zeros(o), "w2": rng.normal(size=(o, o, 2)), "b2": np.zeros(o), "down": rng.normal(size=(o, i, 1)) if i != o else None, "down_b": np.zeros(o)}
    model = {"blocks": [block(2, 4), block(4, 4)], "head": rng.normal(size=(3, 4)), "head_b": np.zeros(3), "base": 3}
    path = tmp_path / "model.npz"
    path.write_bytes(score.bundle(model))
    back = score.load_model(spark, str(path))
    x = rng.normal(size=(5, 2, 9))
    assert np.array_equal(score.forward(x, back), score.forward(x, model)) and back["base"] == 3


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_exit_rows(spark):
    """By number within a key; an exit that is null, negative, its own row or not there."""
    from tickframe.operators.align import with_exit_rows

    rows = [("a", 0, 2, 10), ("a", 1, None, 11), ("a", 2, 2, 12), ("a", -1, -1, 13), ("b", 0, 9, 14), ("b", 2, 0, 15)]
    got = with_exit_rows(spark.createDataFrame(rows, "stem string, row long, exit_row long, ts long"), {"exit_ts": "ts"})
    assert got.columns == ["stem", "row", "exit_row", "ts", "exit_ts"]
    assert sorted((r.stem, r.ts, r.exit_ts) for r in got.collect()) == [("a", 10, 12), ("a", 11, None), ("a", 12, 12), ("a", 13, None), ("b", 14, None), ("b", 15, 14)]
    with pytest.raises(ValueError):
        with_exit_rows(got, {"ts": "row"})
