"""Range lookups whose side table is too large to broadcast."""

from __future__ import annotations

from reelspark.operators import lookups


def test_open_and_long_ranges(spark, monkeypatch):
    frames = spark.range(0, 5000, 7).withColumnRenamed("id", "frame_id")
    made = [(k * 20, k * 20 + 9, k % 3, k, 1) for k in range(200)] + [(3990, 0, 7, 7, 7), (100, 3000, 8, 8, 8)]
    ranges = spark.createDataFrame(made, "start long, end long, mode int, bitrate int, quality int")
    table = spark.createDataFrame([(0, 10, 1, "a"), (10, 40, 2, "b"), (100, 2**61, 3, "c")], "start long, end long, seed long, params string")
    timed = frames.withColumnRenamed("frame_id", "pts")
    run = lambda: (sorted(map(tuple, lookups.dynamic_rate_control(frames, ranges).collect())), sorted(map(tuple, lookups.film_grain(timed, table).collect()), key=str))
    want = run()
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 1)
    assert run() == want and {r[1] for r in want[0]} == {0, 1, 2, 7, 8, None}
