"""Sessions from a gap tree.

The stamps of one entity in order leave a sequence of gaps. The Cartesian tree
over these gaps (largest gap on top, equal gaps sharing one node) holds the
sessions of *every* inactivity setting: a node whose own gap is within the
setting while its parent's gap exceeds it spans exactly one session. The tree
is therefore built once, and a setting is a plain filter over its nodes.

Building is distributed. Stamps are counted per (entity, time chunk, stamp)
before the shuffle. Each chunk builds its own tree; nodes that touch neither
end of the chunk are final. What remains open is the chain of strictly growing
gaps seen from either end: these strictly increasing whole-microsecond gaps
must fit into the chunk, so with whole-second stamps an open chain of a day has
at most ~830 links, whatever the number of events. Open chains of an
entity's chunks meet in a second step that runs the same stack over them.
A hot entity is thus spread over its chunks, and the task that merges it
receives a size bounded by its time range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.functions.arrow import grouped


def tree_nodes(lo, hi, cnt, real, whole: bool) -> list[tuple]:
    """Nodes ``(gap, parent gap or None, lo, hi, n)`` over blocks in order.

    One pass with a stack of strictly falling gaps. ``real`` marks blocks that
    are nodes themselves. Unless ``whole``, nodes touching the first or last
    block are left out: their parent is not known yet.
    """
    out: list[tuple] = []
    first, last = lo[0], hi[-1]
    gaps: list[int] = []
    los: list[int] = []
    ns: list[int] = []
    c_gap, c_lo, c_hi, c_n, c_real = 0, lo[0], hi[0], cnt[0], real[0]

    def emit(parent) -> None:
        if c_real and (whole or (c_lo != first and c_hi != last)):
            out.append((c_gap, parent, c_lo, c_hi, c_n))

    for i in range(1, len(lo)):
        g = lo[i] - hi[i - 1]
        while gaps and gaps[-1] < g:
            emit(gaps[-1])
            c_gap, c_lo, c_n, c_real = gaps.pop(), los.pop(), c_n + ns.pop(), True
        emit(g)
        if gaps and gaps[-1] == g:
            ns[-1] += c_n
        else:
            gaps.append(g)
            los.append(c_lo)
            ns.append(c_n)
        c_gap, c_lo, c_hi, c_n, c_real = 0, lo[i], hi[i], cnt[i], real[i]
    while gaps:
        emit(gaps[-1])
        c_gap, c_lo, c_n, c_real = gaps.pop(), los.pop(), c_n + ns.pop(), True
    emit(None)
    return out


def open_chain(ts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks between the gaps that are strict records from either end of a chunk."""
    gaps = ts[1:] - ts[:-1]
    if not len(gaps):
        return ts, ts, n
    left = np.empty(len(gaps), bool)
    left[0] = True
    left[1:] = gaps[1:] > np.maximum.accumulate(gaps)[:-1]
    back = gaps[::-1]
    right = np.empty(len(gaps), bool)
    right[0] = True
    right[1:] = back[1:] > np.maximum.accumulate(back)[:-1]
    cuts = np.flatnonzero(left | right[::-1])
    starts = np.concatenate(([0], cuts + 1))
    ends = np.concatenate((cuts, [len(ts) - 1]))
    return ts[starts], ts[ends], np.add.reduceat(n, starts)


def _wanted(rows: list[tuple], limits: list[int] | None) -> list[tuple]:
    if limits is None:
        return rows
    return [r for r in rows if any(r[0] <= g and (r[1] is None or g < r[1]) for g in limits)]


def gap_tree(
    df: DataFrame,
    keys: list[str],
    ts: str,
    chunk_hours: int = 24,
    only_gaps: list[int] | None = None,
) -> DataFrame:
    """Gap tree of each entity.

    Rows: ``keys``, ``gap_us`` (0 for a single stamp), ``parent_gap_us`` (null at
    the root), ``start_ts``, ``end_ts``, ``span_us``, ``n_events``. Use
    :func:`sessions_at` to read the sessions of a setting. ``only_gaps`` (seconds)
    keeps just the nodes some of these settings need.

    Rows with a null stamp are ignored, null keys form an entity of their own,
    repeated rows count as events, equal stamps share a leaf, an empty table
    gives an empty tree; other columns of ``df`` are not looked at.
    """
    inner = [f"__k{i}" for i in range(len(keys))]
    ts_type = df.schema[ts].dataType
    c = F.col(ts)
    if isinstance(ts_type, T.TimestampNTZType):
        hours = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) * 24 + F.hour(c)
    else:
        hours = F.floor(F.unix_seconds(c) / 3600)
    counted = (
        df.where(c.isNotNull())
        .select(*[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)], c.alias("__t"), F.floor(hours / chunk_hours).cast("int").alias("__c"))
        .groupBy(*inner, "__c", "__t")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    limits = None if only_gaps is None else [int(g) * 1_000_000 for g in only_gaps]
    key_fields = [T.StructField(i, df.schema[k].dataType) for k, i in zip(keys, inner, strict=True)]
    node_type = T.StructType(
        [
            *key_fields,
            T.StructField("__c", T.IntegerType()),
            T.StructField("__lo", ts_type),
            T.StructField("__hi", ts_type),
            T.StructField("__n", T.LongType()),
            T.StructField("__real", T.BooleanType()),
            T.StructField("__gap", T.LongType()),
            T.StructField("__parent", T.LongType()),
            T.StructField("__node", T.BooleanType()),
            T.StructField("__span", T.LongType()),
        ]
    )

    def table_of(src: pa.Table, at: list[int], chunk, lo, hi, n, real, gap, parent, node) -> pa.RecordBatch:
        stamp = src.column(len(inner) + 1).type
        take = src.select(inner).take(pa.array(at, pa.int64())).combine_chunks()
        cols = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in take.columns]
        cols += [
            pa.array(chunk, pa.int32()),
            pa.array(lo, pa.int64()).cast(stamp),
            pa.array(hi, pa.int64()).cast(stamp),
            pa.array(n, pa.int64()),
            pa.array(real, pa.bool_()),
            pa.array(gap, pa.int64()),
            pa.array(parent, pa.int64()),
            pa.array(node, pa.bool_()),
            pa.array([h - x for x, h in zip(lo, hi, strict=True)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in node_type.fields])

    def chunk_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in grouped(batches, [*inner, "__c"]):
            ts_all = t.column("__t").cast(pa.int64()).to_numpy()
            n_all = t.column("__n").to_numpy()
            c_all = t.column("__c").to_numpy()
            at, rows = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                x, n, chunk = ts_all[s:e], n_all[s:e], int(c_all[s])
                if e - s > 2:
                    xs, ns = x.tolist(), n.tolist()
                    for g, p, lo, hi, k in _wanted(tree_nodes(xs, xs, ns, [True] * len(xs), False), limits):
                        at.append(s)
                        rows.append((chunk, lo, hi, k, True, g, p, True))
                    lo_a, hi_a, n_a = open_chain(x, n)
                else:
                    lo_a, hi_a, n_a = x, x, n
                m = len(lo_a)
                for i, (lo, hi, k) in enumerate(zip(lo_a.tolist(), hi_a.tolist(), n_a.tolist(), strict=True)):
                    at.append(s)
                    rows.append((-1, lo, hi, k, i in (0, m - 1), None, None, False))
                if len(rows) > 20_000:
                    yield table_of(t, at, *zip(*rows, strict=True))
                    at, rows = [], []
            if rows:
                yield table_of(t, at, *zip(*rows, strict=True))

    def merge_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chains() -> Iterator[pa.RecordBatch]:
            for b in batches:
                done = b.filter(b.column(b.schema.get_field_index("__node")))
                if done.num_rows:
                    ready.append(done)
                rest = b.filter(pc.invert(b.column(b.schema.get_field_index("__node"))))
                if rest.num_rows:
                    yield rest

        ready: list[pa.RecordBatch] = []
        for t, starts, ends in grouped(chains(), inner):
            yield from ready
            ready.clear()
            lo_all = t.column("__lo").cast(pa.int64()).to_numpy().tolist()
            hi_all = t.column("__hi").cast(pa.int64()).to_numpy().tolist()
            n_all = t.column("__n").to_numpy().tolist()
            real_all = t.column("__real").to_pylist()
            at, rows = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                for g, p, lo, hi, k in _wanted(tree_nodes(lo_all[s:e], hi_all[s:e], n_all[s:e], real_all[s:e], True), limits):
                    at.append(s)
                    rows.append((-1, lo, hi, k, True, g, p, True))
                if len(rows) > 20_000:
                    yield table_of(t, at, *zip(*rows, strict=True))
                    at, rows = [], []
            if rows:
                yield table_of(t, at, *zip(*rows, strict=True))
        yield from ready

    # finished nodes keep their chunk in the partitioning, so that they stay spread; open chains meet by entity
    parts = counted.repartition(*inner, "__c").sortWithinPartitions(*inner, "__c", "__t").mapInArrow(chunk_trees, node_type)
    nodes = parts.repartition(*inner, "__c").sortWithinPartitions("__node", *inner, "__lo").mapInArrow(merge_chains, node_type)
    return nodes.select(
        *[F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)],
        F.col("__gap").alias("gap_us"),
        F.col("__parent").alias("parent_gap_us"),
        F.col("__lo").alias("start_ts"),
        F.col("__hi").alias("end_ts"),
        F.col("__span").alias("span_us"),
        F.col("__n").alias("n_events"),
    )


def sessions_at(tree: DataFrame, gap_s: float) -> DataFrame:
    """Sessions of an inactivity setting: a new one starts after more than ``gap_s`` seconds.

    Keeps the tree's keys and gives ``start_ts``, ``end_ts``, ``duration_s``, ``n_events``.
    """
    g = int(gap_s * 1_000_000)
    keys = [c for c in tree.columns if c not in ("gap_us", "parent_gap_us", "start_ts", "end_ts", "span_us", "n_events")]
    return tree.where((F.col("gap_us") <= g) & (F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > g))).select(
        *keys, "start_ts", "end_ts", F.expr("span_us div 1000000").alias("duration_s"), "n_events"
    )


def sessionize(df: DataFrame, keys: list[str], ts: str, gap_s: float, chunk_hours: int = 24) -> DataFrame:
    """Sessions of one setting, building only the tree nodes it needs."""
    return sessions_at(gap_tree(df, keys, ts, chunk_hours, only_gaps=[gap_s]), gap_s)
