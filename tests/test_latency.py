"""Latency cells: grid, quantiles, merging, and the stream against the batch."""

from __future__ import annotations

from datetime import datetime, timedelta

from sightlines.operators import latency as L
from sightlines.streaming import start_latency

START = datetime(2024, 1, 1)


def _cell(ms: int) -> int:
    ms = max(ms, 0)
    bits = ms.bit_length() - 1
    return ms if ms < 8 else 8 * (bits - 2) + (ms >> (bits - 3) & 7)


def _log(make, rows):
    return make.table("request_log", [
        {"request_id": i, "endpoint": e, "elapsed_ms": ms, "occurred_at": None if minute is None else START + timedelta(minutes=minute)}
        for i, e, ms, minute in rows
    ])


def _cells(frame):
    return sorted(((r.started_at, r.endpoint, r.cell, r.n) for r in frame.collect()), key=repr)


def test_grid(spark):
    latencies = [-5, *range(70), 1000, 4095, 4096, 2**40 + 7, 2**62]
    found = spark.createDataFrame([(m,) for m in latencies], "ms long").selectExpr("ms", f"{L.cell_of('ms')} AS cell")
    found = found.selectExpr("ms", "cell", f"{L.least_of('cell')} AS least").collect()
    for ms, cell, least in found:
        assert cell == _cell(ms) and _cell(least) == cell
        assert least <= max(ms, 0) and (ms < 8 or max(ms, 0) - least <= ms / 8)
        assert least == 0 or _cell(least - 1) == cell - 1


def test_quantiles_and_merge(make):
    rows = [(i, "a" if i % 3 else "b", (i * 37) % 900, i) for i in range(200)]
    rows += [(900, "a", 5, None), (901, "a", None, 3), rows[7], rows[8], (902, None, -4, 1)]
    log = _log(make, rows)
    whole = L.latency_cells(log)
    halves = [L.latency_cells(log.where(f"request_id % 2 = {k}")) for k in (0, 1)]
    assert _cells(L.merged_cells(*halves)) == _cells(whole)
    groups: dict = {}
    for i, e, ms, minute in {r[0]: r for r in rows}.values():
        if minute is not None and ms is not None:
            groups.setdefault((START + timedelta(hours=minute // 60), e), []).append(max(ms, 0))
    found = {(r.started_at, r.endpoint): r for r in L.quantiles(whole).collect()}
    assert found.keys() == groups.keys()
    for key, latencies in groups.items():
        latencies.sort()
        for p in L.QUANTILES:
            exact = latencies[-(-p * len(latencies) // 100) - 1]
            assert _cell(found[key][f"p{p}"]) == _cell(exact) and found[key].n == len(latencies)


def test_stream_equals_batch(spark, make, tmp_path):
    """Restarts, a replay, an event that is a little late and one that is too late."""
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = [(i, "a", 10 * i, 2 * i) for i in range(50)]
    second = [first[49], first[48], (60, "a", 7, 95), (61, "b", 9, 120), (62, "b", None, 121)]
    third = [(70, "a", 1, 3), (71, "b", 900, 190)]  # the first comes hours after its window
    last = [(80, "end", 1, 600)]
    for part in (first, second, third, last):
        _log(make, part).coalesce(1).write.mode("append").parquet(source)
        start_latency(spark, source, sink, mark).awaitTermination(120)
    start_latency(spark, source, sink, mark).awaitTermination(120)
    expected = L.latency_cells(_log(make, first + second[2:] + third[1:]))
    assert _cells(spark.read.parquet(sink)) == _cells(expected)
