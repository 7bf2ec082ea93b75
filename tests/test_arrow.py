import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skirmish.functions.arrow import grouped


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(1, 6)), max_size=8), st.lists(st.integers(0, 4), max_size=20))
def test_grouped_keeps_groups_whole(groups, sizes):
    """However rows fall into batches, every group of equal neighbours comes out once and whole."""
    keys = [k for k, n in groups for _ in range(n)]
    rows = list(zip(keys, range(len(keys)), strict=True))
    batches, at = [], 0
    for n in [*sizes, len(rows)]:
        part = rows[at : at + n]
        batches.append(pa.RecordBatch.from_pylist([dict(k=k, v=v) for k, v in part], schema=pa.schema([("k", pa.string()), ("v", pa.int64())])))
        at += n
    got = []
    for t, starts, ends in grouped(iter(batches), ["k"]):
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            got.append([(r["k"], r["v"]) for r in t.slice(s, e - s).to_pylist()])
    want = []
    for r in rows:
        if want and want[-1][-1][0] == r[0]:
            want[-1].append(r)
        else:
            want.append([r])
    assert got == want
