"""The value view of the visibility graph over whole series, against brute force."""

import datetime
from collections import Counter

import numpy as np

from tidemark.plans.queries import QUERIES

DAYS = 430


def test_value_view_covers_the_series(spark, tmp_path):
    rng = np.random.default_rng(9)
    series = {flag: rng.integers(1, 40, DAYS) for flag in "AN"}
    first = datetime.date(1995, 1, 1)
    rows = [(flag, first + datetime.timedelta(days=i), float(x)) for flag, v in series.items() for i, x in enumerate(v)]
    spark.createDataFrame(rows, "l_returnflag string, l_shipdate date, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = Counter()
    for flag, v in series.items():
        for i in range(DAYS):
            top = 0
            for j in range(i + 1, DAYS):
                if top < min(v[i], v[j]):
                    want[flag, float(v[i]), float(v[j])] += 1
                top = max(top, v[j])
    got = {(r.series_id, r.from_value, r.to_value): r.weight for r in QUERIES["vg_value"](spark, str(tmp_path)).collect()}
    assert got == dict(want)
