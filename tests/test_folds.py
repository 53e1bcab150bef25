"""Folds of a key's rows that many tasks share, against plain loops."""

import random

import pytest

from quarry.streaming import sessions


@pytest.mark.parametrize("floor", [None, -0.2])
def test_utilities_of_a_hot_key(spark, floor):
    r = random.Random(12)
    rows = [(0 if r.random() < 0.6 else r.randint(1, 40), i, r.choice([-1.0, 0.0, 0.5, 1.0])) for i in range(4000)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "key long, seq long, reward double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["key"]: (x["visits"], x["q"], x["reward_mean"]) for x in sessions.utilities(df, floor=floor, start=0.1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {}
    for key, _, reward in rows:
        n, q, m = expected.get(key, (0, 0.1, 0.0))
        q = 0.7 * q + 0.3 * reward
        expected[key] = n + 1, q if floor is None else max(floor, q), 0.7 * m + 0.3 * reward
    assert got == {k: (n, pytest.approx(q, abs=2e-9), pytest.approx(m, abs=2e-9)) for k, (n, q, m) in expected.items()}
    assert sessions.utilities(df.where("false")).count() == 0
