import json

from tickframe.session import STATE_STORE, setting
from tickframe.sources import files
from tickframe.streaming import tail


def run(query):
    query.processAllAvailable()
    query.stop()


def test_growing_file(spark, tmp_path):
    tail.register(spark)
    log = tmp_path / "live.log"
    log.write_text("one\ntwo\npart")
    query = spark.readStream.format("log_tail").option("path", str(log)).load().writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    with log.open("a") as f:
        f.write("ial\nthree\n")
    run(query)
    assert [r.value for r in spark.sql("select value from tailed order by at").collect()] == ["one", "two", "partial", "three"]


def test_backlog_in_spans(tmp_path, monkeypatch):
    """Spans cover a backlog once, each with whole lines, however long a line is."""
    monkeypatch.setattr(tail, "STEP", 10)
    log = tmp_path / "old.log"
    lines = [f"line {i} " + "x" * (i * 7 % 40) for i in range(30)] + ["", "end"]
    log.write_text("\n".join(lines) + "\n")
    reader = tail._TailReader(str(log), False)
    spans = reader.partitions({"at": 0}, reader.latestOffset())
    assert len(spans) > 5 and [v for s in spans for _, v in reader.read(s)] == lines
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_payload_checks(spark):
    good = json.dumps({"resolution": "fast", "bar_index": 1, "start_timestamp_ns": 1, "end_timestamp_ns": 2, "features": {"a": 1.0}})
    lines = spark.createDataFrame([(good,), ("",), ("{",), (good.replace("fast", "mid"),), (json.dumps({"resolution": "fast"}),)], "value string")
    assert sorted(str(r.reason) for r in tail.checked(lines, "fast").collect()) == ["None", "blank", "malformed", "no_features", "resolution"]


def test_bars_over_several_batches(spark, tmp_path):
    from tickframe.operators.bars import price_bars
    from tickframe.streaming.bars import stream_bars

    rows = [("d", i, int(t * 1e9), float(p)) for i, (t, p) in enumerate([(0, 1), (0.5, 3), (1.2, 2), (0.9, 5), (4, 4), (4.5, 1), (9, 9)])]
    schema = "stem string, seq long, ts_ns long, price double"
    for k in range(len(rows)):
        spark.createDataFrame(rows[k : k + 1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    run(stream_bars(stream, 1).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start())
    keep = lambda df: sorted((r.bar_id, r.bar_index, r.open, r.high, r.low, r.close, r.volume, r.n_events) for r in df.collect())
    batch = keep(price_bars(spark.createDataFrame(rows, schema), 1))
    assert keep(spark.table("streamed")) == batch[:-1]


def test_sinks(spark, tmp_path):
    from tests.conftest import SF
    from tickframe.plans import queries
    from tickframe.operators.align import without_existing

    f = queries.queries()["feat_core_64"](spark, SF)
    files.write_features(f, str(tmp_path / "f"), "mid")
    back = files.read_features(spark, str(tmp_path / "f"), "mid", ["spread_ticks", "spread_ticks", "rv_log"])
    assert back.columns == ["stem", "start_timestamp_ns", "spread_ticks", "rv_log"] and back.count() == f.count()
    plan = back.where("stem = '2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bid_level_1_present" not in plan
    assert without_existing(f.select("stem").distinct(), files.existing_stems(spark, str(tmp_path / "f")), ["stem"]).count() == 0
    states = spark.createDataFrame([("v", "a", 1.0), ("v", "b", 2.0), ("d", "a", 3.0)], "channel string, stem string, ewma double")
    assert sorted((r.channel, r.stem, r.ewma) for r in files.latest_state(states).collect()) == [("d", "a", 3.0), ("v", "b", 2.0)]
    files.dry_run(f)
    (tmp_path / "few").mkdir()
    (tmp_path / "few" / "a").write_bytes(b"x" * 100)
    (tmp_path / "few" / "b").write_bytes(b"x" * 20000)
    assert [r.length for r in files.small_files(spark, str(tmp_path / "few")).collect()] == [100]


def test_live_rows_equal_the_causal_batch_joins(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from tickframe.operators.align import as_of, recent_mid
    from tickframe.streaming.live import live_rows

    rng, rows = random.Random(7), []
    for kind, seconds, n in (("fast", 1, 600), ("mid", 10, 60), ("slow", 60, 10)):
        rows += [("d", kind, i * seconds * 10**9, (i + 1) * seconds * 10**9, rng.random(), rng.random(), rng.random()) for i in range(n)]
    schema = "stem string, resolution string, start_timestamp_ns long, end_timestamp_ns long, spread_ticks double, trade_volume_sum_rel double, ofi_net_log double"
    order = {"fast": 0, "mid": 1, "slow": 2}
    rows.sort(key=lambda r: (r[3], order[r[1]]))
    for k in range(3):
        spark.createDataFrame(rows[k * 250 : (k + 1) * 250] if k < 2 else rows[500:], schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    run(live_rows(stream, ["spread_ticks"], warm_up=5).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).start())
    all_rows = spark.createDataFrame(rows, schema)
    fast, mid, slow = (all_rows.where(F.col("resolution") == r) for r in ("fast", "mid", "slow"))
    want = recent_mid(fast, mid)
    for name, other in (("mid", mid), ("slow", slow)):
        other = other.select("stem", F.col("end_timestamp_ns").alias("closed"), F.col("spread_ticks").alias(f"s_{name}"))
        want = as_of(want, other, [f"s_{name}"], left_on="end_timestamp_ns", right_on="closed", right_first=False)
    want = want.where("s_slow is not null")
    keep = lambda df, *c: sorted(tuple(round(r[x], 9) for x in c) for r in df.collect())
    assert keep(spark.table("live"), "start_timestamp_ns", "spread_ticks@mid", "spread_ticks@slow", "avg_mid_spread_abs", "sum_mid_ofi_net") == keep(want, "start_timestamp_ns", "s_mid", "s_slow", "avg_mid_spread_abs", "sum_mid_ofi_net")
    assert spark.table("live").count() == 540 and spark.table("live").where("avg_fast_spread_abs <> 0").count() == 0


def _log_rows(n=600):
    import random

    rng, rows, t = random.Random(5), [], 0
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 9]) * 10**8
        side = rng.choice(["bid", "ask"])
        stem = "b" if i % 10 == 0 and i < 300 else "a"
        at = t - 3 * 10**9 if i in (301, 400) else t
        if rng.random() < 0.2:
            rows.append((stem, i, at, "L1", rng.choice([side, None]), None, None, 100.0, float(rng.randint(1, 5))))
        else:
            lvl = rng.choice([0, 0, 1, 2, 7])
            rows.append((stem, i, at, "L2", side, rng.choice(["add", "update", "update", "remove"]), lvl, 100 + (1 + lvl + rng.randint(0, 1)) * (0.25 if side == "ask" else -0.25), float(rng.randint(1, 9))))
    return rows


LOG = "stem string, seq long, ts_ns long, kind string, side string, op string, lvl int, price double, size double"


def _finish(spark, stream, out):
    """To the end of what is there, in one partition: each has a state store of its own."""
    with setting(spark, *STATE_STORE), setting(spark, "spark.sql.shuffle.partitions", "1"):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()


def _streamed(spark, folder, out, **options):
    from tickframe.streaming.features import stream_closed

    stream = stream_closed(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), 1, **options)
    _finish(spark, stream, out)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _write(spark, rows, folder):
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(folder)


def test_streamed_columns_equal_the_batch(spark, tmp_path):
    """Bars cut by batches, late rows, deep levels, a stem that rests and ends, a restart, and a stem that comes again afterwards."""
    from tickframe.operators.bars import bars
    from tickframe.operators.book import market_events
    from tickframe.operators.features import core_features
    from tickframe.streaming.features import stream_features

    rows, end = _log_rows(), lambda stem, seq: (stem, seq, 0, "end", None, None, None, None, None)
    parts = [rows[:100], rows[100:300] + [end("b", 299)], rows[300:], [end("a", 600)], [("b", *r[1:]) for r in rows[:200] if r[0] == "a"] + [end("b", 700)]]
    out = str(tmp_path / "out")
    for k, part in enumerate(parts):
        _write(spark, part, str(tmp_path / f"in/{k}"))
        if k in (1, 4):  # two files at once, then a stream started anew
            stream = stream_features(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")), 1)
            _finish(spark, stream, out)
    keep = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())
    batch = lambda x: core_features(bars(market_events(spark.createDataFrame(x, LOG)), 1), regimes=False)
    got, want = keep(spark.read.schema(stream.schema).parquet(f"{out}/rows")), keep(batch(rows)) + keep(batch([("b", *r[1:]) for r in rows[:200] if r[0] == "a"]))
    assert len(want) > 100 and got == sorted(want)


def test_warm_start_from_files(spark, tmp_path):
    """A stream that starts from what another left, and no checkpoint, goes on with its averages."""
    from tickframe.streaming.features import last_averages

    rows = [r for r in _log_rows() if r[0] == "a"]
    cut = next(i for i in range(250, 400) if rows[i][2] // 10**9 > max(r[2] for r in rows[:i]) // 10**9)  # between two bars
    end = ("a", 900, 0, "end", None, None, None, None, None)
    _write(spark, rows + [end], str(tmp_path / "all/0"))
    _write(spark, rows[:cut] + [end], str(tmp_path / "one/0"))
    book = {(r[4], r[6]): r for r in rows[:cut] if r[3] == "L2"}.values()  # averages alone are kept: the book is given again, in one row a level
    _write(spark, [(*r[:2], rows[cut][2], *r[3:]) for r in book] + rows[cut:] + [end], str(tmp_path / "two/0"))
    whole = {r.bar_id: r for r in _streamed(spark, tmp_path / "all", tmp_path / "o0").collect()}
    files.write_json_lines(last_averages(_streamed(spark, tmp_path / "one", tmp_path / "o1")), str(tmp_path / "state"))
    state = spark.read.schema("stem string, vol double, db double, da double, bid double, ask double").json(str(tmp_path / "state"))
    got = {r.bar_id: r for r in _streamed(spark, tmp_path / "two", tmp_path / "o2", initial=state).collect()}
    first = min(got)
    assert got and set(got) == {k for k in whole if k >= first}
    for k, r in got.items():
        assert abs(r.vol_div - whole[k].vol_div) < 1e-9 and (k > first or abs(r.db_div - whole[k].db_div) < 1e-9)
    cold = {r.bar_id: r for r in _streamed(spark, tmp_path / "two", tmp_path / "o3").collect()}
    assert cold[first].vol_div != got[first].vol_div
