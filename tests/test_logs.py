import random
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException

from tickframe.operators.book import market_events, order_flow, quotes
from tickframe.sources import logs


def lines(spark, *values):
    return spark.createDataFrame([("d", i, v) for i, v in enumerate(values)], "stem string, seq long, value string")


def parsed(line):
    """(kind, side, op, lvl, price, size, ts_ns) of a line by plain string work, or None if it is left out."""
    f = line.strip().split(";")
    if f[0] not in ("L1", "L2"):
        return None
    number = lambda x: float(x.replace(",", ".")) if x else 0.0
    ts = int(datetime.strptime(f[2], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).timestamp()) * 10**9 + int(f[3] or 0) * 100
    side = {"0": "ask", "1": "bid"}.get(f[1])
    if f[0] == "L1":
        return ("L1", side, None, None, number(f[4]), number(f[5]), ts)
    level = int(f[5]) if f[5].isdigit() else logs.OUT_OF_RANGE
    return side and ("L2", side, {"0": "add", "2": "remove"}.get(f[4], "update"), level, number(f[7]), number(f[8]), ts)


def test_parsing(spark):
    rng, written = random.Random(3), ["", "L3;0;1", "  "]
    for _ in range(200):
        at = f"{rng.choice(['20240229', '20251231'])}{rng.randrange(24):02d}{rng.randrange(60):02d}{rng.randrange(60):02d};{rng.choice(['', '0', '71', '9999999'])}"
        px, sz = rng.choice(["88,5", "1203.25", "7", ""]), rng.choice(["1", "12", "", "0,5"])
        side = rng.choice("0127")
        written.append(f"L2;{side};{at};{rng.choice('0123')};{rng.choice(['0', '3', '11', 'top'])};mm;{px};{sz}" if rng.random() < 0.7 else f"L1;{side};{at};{px};{sz}")
    got = logs.parse(lines(spark, *written), strict=True).orderBy("seq").collect()
    want = [(i, *p) for i, p in ((i, parsed(x)) for i, x in enumerate(written)) if p]
    assert [(r.seq, r.kind, r.side, r.op, r.lvl, r.price, r["size"], r.ts_ns) for r in got] == want


def test_strict_and_lenient(spark):
    bad = lines(spark, "L2;0;2023;0;0;0;;1;1", "L1;0;20230101000000;0;x;1", "L1;0;20230101000000;0;1;1")
    assert logs.parse(bad).count() == 1
    with pytest.raises(PySparkException):
        logs.parse(bad, strict=True).collect()


def test_quotes_wait_for_both_tops(spark):
    """Nothing is quoted before both sides have a top; then every depth row quotes, one out of range too."""
    rows = logs.parse(lines(spark, "L2;1;20240105120000;0;0;0;;88,50;4", "L2;1;20240105120001;0;1;0;;88,25;6", "L2;0;20240105120002;0;0;0;;89,25;2", "L2;0;20240105120003;0;0;7;;90;5", "L2;0;20240105120004;0;2;0;;;", "L2;0;20240105120005;0;0;0;;89;1"))
    events = [(r.seq, r.kind, r.op, r["size"], r.mid) for r in market_events(rows, 2).orderBy("seq", "sub").collect()]
    assert events == [
        (0, "flow", "add", 4.0, None), (1, "flow", "cancel", 4.0, None), (1, "flow", "add", 6.0, None), (2, "flow", "add", 2.0, None), (2, "quote", None, None, 88.75), (3, "quote", None, None, 88.75),
        (4, "flow", "cancel", 2.0, None), (5, "flow", "add", 1.0, None), (5, "quote", None, None, 88.625),
    ]


def test_files_in_order(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name, text in (("b.csv", "L1;0;20230101000000;0;1;1\nL1;0;20230101000001;0;2;1\n"), ("a.CSV", "L1;0;20230101000000;0;3;1\n"), ("nested/c.csv", "L1;1;20230101000000;0;4;1"), ("skip.bin", "L1;0;20230101000000;0;9;1")):
        (tmp_path / name).write_text(text)
    got = logs.parse(logs.read_lines(spark, str(tmp_path))).orderBy("stem", "seq").collect()
    assert [(r.stem, r.price) for r in got] == [("a", 3.0), ("b", 1.0), ("b", 2.0), ("c", 4.0)]


def model(rows, levels):
    """A plain walk over rows: quotes and flows."""
    book = {s: [(0.0, 0.0)] * levels for s in ("bid", "ask")}
    out_q, out_f = [], []
    for seq, side, op, lvl, px, sz in rows:
        if lvl < levels:
            old = book[side][lvl]
            flow = []
            if op == "add":
                flow = [("add", sz)]
            elif op == "remove":
                flow = [("cancel", old[1])]
            elif abs(px - old[0]) > 1e-9:
                flow = [("cancel", old[1]), ("add", sz)]
            elif sz != old[1]:
                flow = [("add", sz - old[1])] if sz > old[1] else [("cancel", old[1] - sz)]
            out_f += [(seq, o, s) for o, s in flow if s > 0]
            book[side][lvl] = (0.0, 0.0) if op == "remove" else (px, sz)
        (b, bs), (a, as_) = book["bid"][0], book["ask"][0]
        if min(b, bs, a, as_) > 0:
            out_q.append((seq, b, bs, a, as_))
    return out_q, out_f


def test_book_against_a_plain_walk(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice(["bid", "ask"]), rng.choice(["add", "update", "remove"]), rng.randrange(4), rng.choice([99.5, 100.0, 100.5]), float(rng.randint(0, 4))) for i in range(400)]
    df = spark.createDataFrame([("d", s, s, "L2", side, op, lvl, px, sz) for s, side, op, lvl, px, sz in rows], "stem string, seq long, ts_ns long, kind string, side string, op string, lvl int, price double, size double")
    want_q, want_f = model(rows, 3)
    assert [(r.seq, r.bid_px, r.bid_sz, r.ask_px, r.ask_sz) for r in quotes(df, 3).orderBy("seq").collect()] == want_q
    assert [(r.seq, r.op, r["size"]) for r in order_flow(df, 3).orderBy("seq", "sub").collect()] == want_f
