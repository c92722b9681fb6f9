import threading

import pytest

from tests.conftest import SF
from tickframe.adapters import book_log
from tickframe.plans import preprocess as p
from tickframe.sources import logs

TARGETS = {"t2": (2, 3600), "t8": (8, 7200)}


def test_logs_to_files(spark, tmp_path):
    keep = lambda where: sorted(map(str, spark.read.parquet(str(where)).collect()))
    rows = book_log(spark.read.parquet(f"{SF}/events.parquet")).where("stem <= '2024-01-04'")
    inbox = tmp_path / "in"
    inbox.mkdir()
    by_stem = {}
    for r in logs.format_lines(rows).orderBy("stem", "seq").collect():
        by_stem.setdefault(r.stem, []).append(r.value)
    for stem, lines in by_stem.items():
        (inbox / f"{stem}.csv").write_text("\n".join(lines) + "\n")
    read = logs.parse(logs.read_lines(spark, str(inbox)))
    p.preprocess(read, str(tmp_path / "a"), ("slow",), TARGETS, dry_run=True)
    assert not (tmp_path / "a").exists()
    p.preprocess(read, str(tmp_path / "a"), ("slow",), TARGETS)
    p.preprocess(read, str(tmp_path / "a"), ("slow",), TARGETS, skip_existing=True)  # adds nothing
    whole = {part: keep(tmp_path / "a" / part) for part in ("features", "labels")}
    # A stem that lacks one output is made again, whole; the others stay as they are.
    for i, folder in enumerate(("labels", "features/resolution=slow")):
        lost = sorted((tmp_path / "a" / folder).glob("stem=*"))[i]
        lost.rename(tmp_path / f"lost{i}")
        p.preprocess(read, str(tmp_path / "a"), ("slow",), TARGETS, skip_existing=True)
        assert {part: keep(tmp_path / "a" / part) for part in whole} == whole
    # A resolution that was never made counts as missing.
    p.preprocess(read, str(tmp_path / "c"), ("slow",), TARGETS)
    p.preprocess(read, str(tmp_path / "c"), ("mid", "slow"), TARGETS, skip_existing=True)
    assert spark.read.parquet(str(tmp_path / "c" / "features")).select("resolution").distinct().count() == 2
    assert keep(tmp_path / "c" / "labels") == whole["labels"]
    p.ingest(spark, str(inbox), str(tmp_path / "b"), str(tmp_path / "ck"), resolutions=("slow",), targets=TARGETS).awaitTermination()
    # A batch that runs again after a failure replaces what it wrote.
    p.ingest(spark, str(inbox), str(tmp_path / "b"), str(tmp_path / "ck2"), resolutions=("slow",), targets=TARGETS).awaitTermination()
    for part in ("features", "labels"):
        assert keep(tmp_path / "a" / part) == keep(tmp_path / "b" / part) != []
    report = {r.target: r for r in p.label_report(spark, str(tmp_path / "a"), TARGETS).collect()}
    n = spark.read.parquet(str(tmp_path / "a" / "labels")).count()
    assert all(r.total == n == r.up + r.flat + r.down for r in report.values()) and len(report) == 2


def test_outputs_are_made_side_by_side(spark, tmp_path, monkeypatch):
    """No output waits for another: each is written only once all have begun. What one fails with is raised."""
    rows = book_log(spark.read.parquet(f"{SF}/events.parquet")).where("stem <= '2024-01-02'")
    together = threading.Barrier(3, timeout=60)
    for name in ("write_features", "write_labels"):
        plain = getattr(p.files, name)
        monkeypatch.setattr(p.files, name, lambda *a, plain=plain: (together.wait(), plain(*a)))
    p.preprocess(rows, str(tmp_path / "a"), ("mid", "slow", "mid"), TARGETS)
    made = spark.read.parquet(str(tmp_path / "a" / "features"))
    assert {r.resolution for r in made.select("resolution").distinct().collect()} == {"mid", "slow"}
    assert made.count() == made.select("resolution", "stem", "bar_index").distinct().count() > 0
    monkeypatch.setattr(p.files, "write_labels", lambda *a: (together.wait(), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        p.preprocess(rows, str(tmp_path / "b"), ("mid", "slow"), TARGETS)


def test_resolution_plan():
    assert p.resolution_plan(" slow, fast,slow,") == {"slow": 5, "fast": 5}
    assert p.resolution_plan([], levels=0) == {"fast": 1}
    with pytest.raises(ValueError):
        p.resolution_plan("hourly")
