import math
import random

import pytest

from skirmish.llm import percentiles
from skirmish.llm.percentiles import exact_percentiles, merge_counts, value_counts
from skirmish.llm.terms import term_frequencies
from skirmish.llm.topn import top_n


@pytest.mark.parametrize("parts", [1, 6])
def test_top_n(spark, parts):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        g = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        rows.append((g, rng.choice([None, 1, 2, 3, -5, 2**62]), rng.choice(["x", "y", "é", ""]), rng.choice([None, "", "p", "pp"]), 7))
    df = spark.createDataFrame(rows, "g string, v bigint, t string, u string, rank_no int").repartition(parts)
    got = {}
    for r in top_n(df, ["g"], "v", ["t", "u"], 5).collect():
        got.setdefault(r.g, {})[r.rank_no] = (r.v, r.t, r.u or "")
    want = {}
    for g in ("hot", "a", "b", "c", None):
        mine = sorted(((v, t, u or "") for gg, v, t, u, _ in rows if gg == g and v is not None), key=lambda x: (-x[0], x[1].encode(), x[2].encode()))
        want[g] = dict(enumerate(mine[:5], 1))
    assert got == want


def test_top_n_empty_and_nan(spark):
    assert top_n(spark.createDataFrame([], "g string, v bigint, t string"), ["g"], "v", ["t"], 3).count() == 0
    df = spark.createDataFrame([("a", float("nan"), "x"), ("a", 1.5, "y")], "g string, v double, t string")
    assert [(r.t, r.rank_no) for r in top_n(df, ["g"], "v", ["t"], 3).collect()] == [("y", 1)]
    ends = spark.createDataFrame([("a", v, "x") for v in (-(2**63), 2**63 - 1, 0, None)], "g string, v bigint, t string")
    assert [(r.v, r.rank_no) for r in top_n(ends, ["g"], "v", ["t"], 3).collect()] == [(2**63 - 1, 1), (0, 2), (-(2**63), 3)]
    with pytest.raises(TypeError):
        top_n(ends, ["g"], "t", [], 3)


def test_terms(spark):
    rows = [(1, 1, "a", "v"), (1, 1, "a", None), (1, 2, "a", "w"), (2, 1, "b", "w"), (2, None, "b", "w"), (None, 3, None, "w"), (3, 1, "a", "w")]
    df = spark.createDataFrame(rows, "log int, enc int, spell string, verb string").repartition(3)
    got = {(r.field, r.term): (r.n_occurrences, r.n_records, r["mark"]) for r in term_frequencies(df, {"spell": df.spell, "verb": df.verb}, ["log", "enc"], 2, 0.5).collect()}
    assert got == {("spell", "a"): (4, 3, "common"), ("spell", "b"): (2, 1, "rare"), ("verb", "v"): (1, 1, "rare"), ("verb", "w"): (5, 3, "common")}
    assert term_frequencies(df.limit(0), {"spell": df.spell}, ["log", "enc"], 2, 0.5).count() == 0


@pytest.mark.parametrize("bits", [2, 12])
def test_percentiles(spark, monkeypatch, bits):
    monkeypatch.setattr(percentiles, "BITS_PER_PASS", bits)
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([rng.randint(1, 9), rng.randint(-(2**33), 2**34), 5])) for _ in range(1500)]
    rows += [("one", 42), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(4)
    pcts = [1, 50, 90, 99, 100]
    got = {(r.grp, r.pct): r.value for r in exact_percentiles(value_counts(df, "g", "v"), pcts).collect()}
    want = {}
    for g in ("hot", "a", "b", None, "one"):
        mine = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, p): mine[math.ceil(p * len(mine) / 100) - 1] for p in pcts}
    assert got == want
    halves = [value_counts(df.where("v % 2 = 0"), "g", "v"), value_counts(df.where("v % 2 <> 0"), "g", "v")]
    assert {(r.grp, r.pct): r.value for r in exact_percentiles(merge_counts(*halves), pcts, least=2).collect()} == {k: v for k, v in want.items() if k[0] != "one"}


def test_percentiles_of_the_whole_range(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 7, 2**63 - 1]
    df = spark.createDataFrame([("a", v) for v in ends], "g string, v bigint")
    got = {r.pct: r.value for r in exact_percentiles(value_counts(df, "g", "v"), [1, 34, 50, 84, 100]).collect()}
    assert got == {p: ends[math.ceil(p * 6 / 100) - 1] for p in (1, 34, 50, 84, 100)}


def test_percentiles_empty(spark):
    assert exact_percentiles(value_counts(spark.createDataFrame([], "g string, v bigint"), "g", "v"), [50]).count() == 0
