import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skirmish.operators.gap_tree import gap_tree, open_chain, sessionize, sessions_at, tree_nodes

T0 = dt.datetime(2019, 3, 4, 23, 0, 0)


def brute(stamps, gap):
    out = []
    for t in sorted(stamps):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
            out[-1][2] += 1
        else:
            out.append([t, t, 1])
    return sorted(map(tuple, out))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(0, 20))
def test_tree_holds_the_sessions_of_every_gap(stamps, gap):
    xs, n = np.unique(stamps, return_counts=True)
    nodes = tree_nodes(xs.tolist(), xs.tolist(), n.tolist(), [True] * len(xs), True)
    got = sorted((lo, hi, k) for g, p, lo, hi, k in nodes if g <= gap and (p is None or p > gap))
    assert got == brute(stamps, gap)


def test_open_chain_keeps_all_stamps_and_few_links():
    ts = np.arange(0, 80_000, 7)
    lo, hi, n = open_chain(ts, np.ones(len(ts), np.int64))
    assert n.sum() == len(ts) and len(lo) == 3 and lo[0] == 0 and hi[-1] == ts[-1]


def test_chunks_merge_to_the_same_sessions(spark):
    rng = random.Random(1)
    rows = []
    for key in ("a", "b", None):
        t = 0
        for _ in range(400):
            t += rng.choice([0, 1, 5, 44, 45, 46, 300, 7200, 90_000]) if rng.random() < 0.7 else rng.randint(0, 100)
            rows.append((key, T0 + dt.timedelta(seconds=t), 1))
    rows += [("c", None, 1), ("c", T0, 2), ("c", T0, 3)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, gap_us int").repartition(5)
    tree = gap_tree(df, ["k"], "ts", chunk_hours=6).cache()
    for gap in (0, 45, 300, 100_000):
        got = {(r.k, r.start_ts, r.end_ts, r.n_events, r.duration_s) for r in sessions_at(tree, gap).collect()}
        want = set()
        for key in ("a", "b", None, "c"):
            stamps = [r[1] for r in rows if r[0] == key and r[1] is not None]
            want |= {(key, a, b, n, int((b - a).total_seconds())) for a, b, n in brute(stamps, dt.timedelta(seconds=gap))}
        assert got == want
    pruned = {(r.k, r.start_ts, r.end_ts) for r in sessionize(df, ["k"], "ts", 45, 6).collect()}
    assert pruned == {(r.k, r.start_ts, r.end_ts) for r in sessions_at(tree, 45).collect()}


def test_empty_table_and_zoned_stamps(spark):
    empty = spark.createDataFrame([], "k string, ts timestamp_ntz")
    assert sessionize(empty, ["k"], "ts", 45).count() == 0
    zoned = spark.range(3).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 40 + 1_500_000_000).alias("ts"))
    assert [r.n_events for r in sessionize(zoned, ["k"], "ts", 45).collect()] == [3]
