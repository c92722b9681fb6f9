"""Event-time bars and sessions, records of batches, read limits, and windows kept in state."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.session import STATE_STORE, setting
from tickframe.streaming import batches, tail, windows

SERIES = "stem string, seq long, ts_ns long, price double"


def _drain(writer, out):
    """To the end of what is there, on from where ``out`` was left."""
    query = writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _in_turn(spark, parts, schema, build, base):
    """Each part in a run of its own; (rows given, late rows)."""
    late = 0
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/in/{k}")
        made = build(spark.readStream.schema(schema).parquet(f"{base}/in/*"))
        with setting(spark, *STATE_STORE), setting(spark, "spark.sql.shuffle.partitions", "1"):
            late += windows.late_rows(_drain(made.writeStream.format("parquet").option("path", f"{base}/rows"), base))
    return spark.read.schema(made.schema).parquet(f"{base}/rows").collect(), late


def _at(stem, seq, seconds, price):
    return (stem, seq, int(seconds * 10**9), price)


def test_event_bars_drop_and_count_late_rows(spark, tmp_path):
    """A row out of order joins its own bar, one sent twice counts once, late ones are counted one by one; a quiet stem's bars close too."""
    first = [_at("a", 1, 5, 1.0), _at("a", 3, 25, 3.0), _at("a", 2, 12, 2.0), _at("b", 1, 3, 9.0)]
    second = [_at("a", 3, 25, 3.0), _at("a", 4, 21, 7.0), _at("a", 5, 60, 5.0)]  # sent twice; behind, but within the delay
    third = [_at("a", 6, 1, 0.0), _at("a", 7, 2, 0.0), _at("b", 2, 4, 0.0), _at("a", 8, 200, 8.0)]  # three late ones
    rows, late = _in_turn(spark, [first, second, third], SERIES, lambda s: windows.event_bars(s, 10, "20 seconds"), str(tmp_path))
    got = sorted((r.stem, r.bar_id, r.n_events, r.open, r.high, r.low, r.close, r.volume) for r in rows)
    assert got == [("a", 0, 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", 1, 1, 2.0, 2.0, 2.0, 2.0, 2.0), ("a", 2, 2, 7.0, 7.0, 3.0, 3.0, 10.0), ("a", 6, 1, 5.0, 5.0, 5.0, 5.0, 5.0), ("b", 0, 1, 9.0, 9.0, 9.0, 9.0, 9.0)]
    assert late == 3 and all(r.end_ns - r.start_ns == 10 * 10**9 and r.start_ns == r.bar_id * 10 * 10**9 for r in rows)


def test_sessions_end_by_the_watermark(spark, tmp_path):
    """A neighbour at the gap goes on, one behind it begins anew, also over batches; the last run stays open."""
    first = [_at("a", i, t, float(t)) for i, t in enumerate((100, 109, 119.5, 124))]
    second = [_at("a", 10, 134, 34.0), _at("a", 11, 160, 60.0), _at("b", 1, 161, 1.0)]
    rows, late = _in_turn(spark, [first, second, [_at("a", 12, 200, 1.0)]], SERIES, lambda s: windows.sessions(s, 10, "15 seconds"), str(tmp_path))
    got = sorted((r.stem, r.start_ns / 10**9, r.end_ns / 10**9, r.n_events, r.open, r.close) for r in rows)
    assert got == [("a", 100, 109, 2, 100.0, 109.0), ("a", 119.5, 134, 3, 119.5, 34.0), ("a", 160, 160, 1, 60.0, 60.0), ("b", 161, 161, 1, 1.0, 1.0)]
    assert late == 0


def test_event_bars_of_no_rows(spark, tmp_path):
    rows, late = _in_turn(spark, [[]], SERIES, lambda s: windows.event_bars(s, 10), str(tmp_path))
    assert rows == [] and late == 0


def test_taken_rows_and_reasons(spark, tmp_path):
    """Counts of all batches; a batch that is run again counts once, one without its record isn't seen."""
    schema, out = "id long, reason string", str(tmp_path / "out")
    parts = [[(1, None), (2, "blank"), (3, "odd")], [(4, None), (5, None), (6, "blank")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    _drain(batches.take(stream, out, ["blank"]), out)
    counts = lambda: {r.reason: r.n for r in batches.drop_reasons(spark, out).collect()}
    assert counts() == {"taken": 3, "blank": 2, "other": 1}
    assert sorted((r.batch, r.rows) for r in batches.commits(spark, out).collect()) == [(0, 1), (1, 2)]
    last = max(p for p in os.listdir(f"{out}/checkpoint/commits") if p.isdigit())
    for name in (last, f".{last}.crc"):
        os.remove(f"{out}/checkpoint/commits/{name}")
    _drain(batches.take(stream, out, ["blank"]), out)
    assert counts() == {"taken": 3, "blank": 2, "other": 1}
    spark.createDataFrame([(9,)], "id long").write.parquet(f"{out}/rows/batch=7")  # was cut off before its record
    assert sorted(r.id for r in batches.committed(spark, out, "rows", "id long").collect()) == [1, 4, 5]
    with pytest.raises(ValueError):
        batches.take(stream, out, ["taken"])


def test_latest_rows_stay_flat(spark, tmp_path):
    """Twenty batches leave two snapshots and two records; the last batch may run again; ties and nulls are told apart."""
    schema, out = "user long, at long, v string", str(tmp_path / "out")
    rows = [[(u, (k * 7 + u) % 11 if u else None, f"{k}-{u}") for u in range(4)] + [(None, k, "none")] for k in range(20)]
    stream = lambda: batches.keep_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), out, ("user",), ("at",))
    assert batches.latest(spark, out, schema).collect() == []
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02}"))
        _drain(stream(), out)
        if k > 1:
            assert len([p for p in os.listdir(f"{out}/state") if p.startswith("batch=")]) == 2 == len([p for p in os.listdir(f"{out}/commits") if p.startswith("batch=")])
    want = {}
    for user, at, v in (r for part in rows for r in part):
        rank = (at is not None, at or 0, v)
        want[user] = max(want.get(user, rank), rank)
    keep = lambda: {r.user: (r.at is not None, r.at or 0, r.v) for r in batches.latest(spark, out, schema).collect()}
    assert keep() == want
    for name in ("19", ".19.crc"):
        os.remove(f"{out}/checkpoint/commits/{name}")
    _drain(stream(), out)
    assert keep() == want
    with pytest.raises(ValueError):
        batches.keep_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), out, ("user",), ("at",), kept=1)


def test_backlog_in_batches(spark, tmp_path):
    """A backlog comes in batches of about the limit, each line once, a line over the limit whole; a stream started anew goes on behind its checkpoint."""
    log, got = tmp_path / "old.log", []
    lines = [f"{i} " + "x" * (i * 13 % 50) for i in range(40)] + ["y" * 500, "end"]
    log.write_text("\n".join(lines) + "\nopen")

    def run(**options):
        stream = tail.tail_lines(spark, str(log), bytes_a_batch=200, **options)
        query = stream.writeStream.foreachBatch(lambda df, n: got.append([r.value for r in df.orderBy("at").collect()])).option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert [x for b in got for x in b] == lines and len(got) > 6
    assert max(sum(len(x) + 1 for x in b[:-1]) for b in got) <= 200
    more = [f"more {i} " + "z" * 30 for i in range(20)]
    with log.open("a") as f:
        f.write("ed\n" + "\n".join(more) + "\n")
    before = len(got)
    run()
    assert [x for b in got[before:] for x in b] == ["opened", *more] and len(got) - before > 2
    with pytest.raises(ValueError):
        tail.LogTail({"path": str(log), "bytes_a_batch": "0"}).streamReader(None)


def test_tail_refuses_a_local_path_on_a_cluster(tmp_path):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="shared"):
        tail.tail_lines(Session(), str(tmp_path / "x"))


def _plain_scores(x, model):
    """The network of one window (channels, length), step by step and value by value."""
    relu = lambda v: v if v > 0 else 0.0
    for i, b in enumerate(model["blocks"]):
        d, n = 2**i, x.shape[1]

        def conv(x, w, bias):
            return [[bias[o] + sum(w[o][c][k] * x[c][t - (len(w[o][c]) - 1 - k) * d] for c in range(len(x)) for k in range(len(w[o][c])) if t >= (len(w[o][c]) - 1 - k) * d) for t in range(n)] for o in range(len(w))]

        y = [[relu(v) for v in row] for row in conv(x, b["w1"], b["b1"])]
        y = [[relu(v) for v in row] for row in conv(y, b["w2"], b["b2"])]
        rest = x if b.get("down") is None else [[b["down_b"][o] + sum(b["down"][o][c][0] * x[c][t] for c in range(len(x))) for t in range(n)] for o in range(len(b["down"]))]
        x = np.array([[relu(y[o][t] + rest[o][t]) for t in range(n)] for o in range(len(y))])
    z = [model["head_b"][k] + sum(model["head"][k][o] * (0.7 * x[o][-1] + 0.3 * sum(x[o]) / x.shape[1]) for o in range(len(x))) for k in range(3)]
    e = [np.exp(v) for v in z]
    return [v / sum(e) for v in e]


def test_network_of_literal_weights():
    """One block that adds the value before to each, a head on its first channel: by hand."""
    from tickframe.operators.score import softmax_scores

    block = {"w1": np.array([[[1.0, 1.0]]]), "b1": np.array([0.0]), "w2": np.array([[[0.0, 1.0]]]), "b2": np.array([-1.0]), "down": None}
    model = {"blocks": [block], "head": np.array([[0.0], [1.0], [2.0]]), "head_b": np.array([0.0, 0.0, -1.0])}
    x = np.array([[[1.0, 2.0, 0.5]]])  # sums 1, 3, 2.5; less one 0, 2, 1.5; with the rest 1, 4, 2
    pooled = 0.7 * 2.0 + 0.3 * (7.0 / 3.0)
    e = np.exp([0.0, pooled, 2 * pooled - 1.0])
    assert np.allclose(softmax_scores(x, model)[0], e / e.sum(), atol=1e-12)
    assert np.allclose(_plain_scores(x[0], model), e / e.sum(), atol=1e-12)


def test_scores_from_windows_in_state(spark, tmp_path):
    """Batches that cut windows, a short stem, one row a batch, nulls and NaN: as the plain network says, and as the batch operators do."""
    from tickframe.operators.dataset import sequences
    from tickframe.operators.score import OUTCOMES, scored
    from tickframe.plans.network import example_network
    from tickframe.streaming.scores import stream_scored

    rng, model, schema = np.random.default_rng(1), example_network(), "stem string, bar_index long, x double, y double, stem2 string"
    rows = [("a", i, float(rng.normal()), None if i % 9 == 4 else float("nan") if i % 7 == 3 else float(rng.normal()), "-") for i in range(30)] + [("b", i, 1.0, 2.0, "-") for i in range(5)] + [("c", 0, 1.0, 2.0, "-")]
    parts = [rows[12:3:-1] + rows[:4] + rows[30:33], rows[13:14], rows[14:30] + rows[33:]]
    given, _ = _in_turn(spark, parts, schema, lambda s: stream_scored(s, ["x", "y"], model, length=5), str(tmp_path))
    got = {(r.stem, r.bar_index): [r[n] for n in OUTCOMES] for r in given}
    clean = lambda v: 0.0 if v is None or v != v else v
    want = {}
    for stem in "abc":
        mine = [(clean(r[2]), clean(r[3])) for r in rows if r[0] == stem]
        want |= {(stem, i): _plain_scores(np.array(mine[i - 4 : i + 1]).T, model) for i in range(4, len(mine))}
    assert len(given) == len(got) and set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    table = spark.createDataFrame(rows, schema).withColumn("y", F.nanvl("y", F.lit(0.0)))
    batch = {(r.stem, r.bar_index): [r[n] for n in OUTCOMES] for r in scored(sequences(table, ["x", "y"], 5), model).collect()}
    assert set(batch) == set(want) and all(np.allclose(batch[k], want[k], atol=1e-9) for k in want)


def test_triggers_against_a_plain_walk(spark, tmp_path):
    """Over three batches: cooldowns of any and of the same direction, price moves, ties of the directions, rows that may not trigger."""
    import random

    from tickframe.streaming.triggers import stream_triggers

    rng, schema = random.Random(4), "stem string, seq long, ts_ns long, price double, up_prob double, down_prob double"
    odd = [None, float("nan")]
    rows = [(rng.choice("ab"), i, i * 10**9 if i % 40 else None, rng.choice([*range(8), *odd, float("inf")]) if i % 5 == 0 else rng.randint(0, 8) / 1.0, rng.choice([0.2, 0.6, 0.9, *odd]), rng.choice([0.2, 0.6, 0.9, *odd])) for i in range(400)]
    rows = [(*r[:3], None if r[3] is None else float(r[3]), *r[4:]) for r in rows]
    given, _ = _in_turn(spark, [rows[:150][::-1], rows[150:151], rows[151:]], schema, lambda s: stream_triggers(s, 0.6, 2.0, 30, 7), str(tmp_path))
    want = []
    for stem in "ab":
        newest, last = None, {}
        for _, i, ts, price, up, down in (r for r in rows if r[0] == stem):
            up, down = (0.0 if p is None or p != p else p for p in (up, down))
            way = "up" if up >= down else "down"
            if ts is None or price is None or not np.isfinite(price) or max(up, down) < 0.6 or newest is not None and ts - newest < 7 * 10**9:
                continue
            if way in last and (ts - last[way][0] < 30 * 10**9 or abs(price - last[way][1]) < 2.0):
                continue
            newest, last[way] = ts, (ts, price)
            want.append((stem, i, ts, way, max(up, down), price))
    assert len(want) > 20 and sorted(tuple(r) for r in given) == want
