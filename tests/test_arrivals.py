"""Slices of insert requests in order of arrival."""

from vecloom.streaming.durable import arrival_slices


def test_one_arrival_time_fills_several_slices(spark):
    times = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(90)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "delivery_id bigint, received_at int")
    slices = [sorted((r.seq, r.received_at, r.delivery_id) for r in part.collect()) for part in arrival_slices(rows.repartition(5), 8)]
    assert all(0 < len(s) <= 8 for s in slices) and all(s[k][0] < s[k + 1][0] for s in slices for k in range(len(s) - 1))
    got = [(t, i) for s in slices for _, t, i in s]
    assert got == sorted(((t, i) for i, t in enumerate(times)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
