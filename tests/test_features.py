import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest

from skirmish.operators import features
from skirmish.operators.features import BitSliced, entity_features


def test_bit_sliced_addition_matches_plain_sums():
    rng = np.random.default_rng(0)
    b, want = BitSliced(), defaultdict(int)
    for _ in range(30):
        o = np.unique(rng.integers(0, 5000, 50))
        v = rng.integers(0, 2**62, len(o)).astype(np.uint64)
        b.add(o, v)
        for k, x in zip(o.tolist(), v.tolist(), strict=True):
            want[k] = (want[k] + x) % 2**64
    o = np.array(sorted(want))
    assert b.decode(o).tolist() == [want[k] for k in o.tolist()]
    assert b.ordinals().tolist() == [k for k in o.tolist() if want[k]]
    assert b.decode(np.array([4999 * 64])).tolist() == [0]


@pytest.mark.parametrize("block", [3, 65_536])
def test_two_level_fold(spark, monkeypatch, block):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        entity = rng.choice(["hot", "hot", f"e{rng.randint(0, 40)}", None])
        rows.append((rng.choice(["x", "y"]), entity, rng.choice(["a", "b", "c"]), 1, rng.choice([0, 5, -7, 2**40]), rng.choice([None, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=i)]), "extra"))
    monkeypatch.setattr(features, "ENTITIES_PER_BLOCK", block)
    monkeypatch.setattr(features, "ROWS_PER_ADD", 64)
    df = spark.createDataFrame(rows, "log string, who string, kind string, n bigint, amount bigint, ts timestamp_ntz, words string").repartition(4)
    part = entity_features(df, ["log", "who"], "kind", "n", "amount", "ts", whole_entities=False)
    out = entity_features(part, ["log", "who"], "kind", "n", "amount", "ts", whole_entities=True).collect()
    want = {}
    for log, who, kind, n, amount, ts, _ in rows:
        c = want.setdefault((log, who, kind), [0, 0, None])
        c[0] += n
        c[1] += amount
        c[2] = max(x for x in (c[2], ts) if x) if (c[2] or ts) else None
    assert len(out) == len(want)
    assert {(r.log, r.who, r.kind): [r.n, r.amount, r.ts] for r in out} == want


def test_empty(spark):
    df = spark.createDataFrame([], "who string, kind string, n bigint, amount bigint, ts timestamp_ntz")
    assert entity_features(df, ["who"], "kind", "n", "amount", "ts", whole_entities=True).count() == 0
