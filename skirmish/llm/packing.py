"""Filling fixed-capacity containers by bin completion over the size histogram.

Sizes are whole tokens of at most ``capacity``, so however many items there are,
the packing problem is a histogram of at most ``capacity`` counts. The search runs
on that histogram and yields *fillings* (multisets of sizes) with the number of
containers that use each. Best fit and repeated best completions give the incumbent; as long as
it needs more containers than the lower bound, its worst containers, then ever more of them, are
taken apart and searched for a packing with one container less: the undominated fillings around the
largest item are branched over, and a branch is pruned when its waste, spent and forced, exceeds
what one container less allows. Items then find their container
by their rank among the items of their size, with no further coordination.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.session import cut_lineage

TOKENIZER_DIR = "/opt/tokenizers"
# Nodes of the completion that builds the incumbent.
NODES_PER_FILLING = 2_000
# Work of the search that improves it: every filling looked at costs as many steps as sizes are left. None searches until proven.
SEARCH_STEPS = 10_000_000
# The driver holds one count per size.
MAX_CAPACITY = 1 << 20


@dataclass
class Filling:
    """``copies`` containers that each hold ``sizes`` (size, how often)."""

    sizes: list[tuple[int, int]]
    copies: int
    used: int = field(default=0)


def _best_fit(sizes: list[int], left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Incumbent: the largest size that fits, again and again."""
    out: list[tuple[int, int]] = []
    at = bisect_right(sizes, room) - 1
    while at >= 0 and room > 0:
        s = sizes[at]
        k = min(left[s], room // s)
        if k:
            out.append((s, k))
            room -= s * k
        at = min(at, bisect_right(sizes, room)) - 1
    return out


def complete(sizes: list[int], left: dict[int, int], room: int, budget: int = NODES_PER_FILLING) -> list[tuple[int, int]]:
    """Undominated completion of ``room`` of least waste, by branch and bound.

    Branches take sizes in falling order. A filling to which another remaining item
    could still be added is dominated and never closed; among fillings of equal
    waste the one with the larger items wins, since it dominates by leaving the
    smaller, easier ones. A branch is cut when even all remaining smaller
    items could not bring its waste below the incumbent's. Best fit gives the first
    incumbent; after ``budget`` nodes the incumbent stands. Builds the first packing only; see :func:`search`.
    """
    best = _best_fit(sizes, left, room)
    best_waste = room - sum(s * k for s, k in best)
    if not best_waste or not best:
        return best
    below = [0]
    for s in sizes:
        below.append(below[-1] + s * left[s])
    nodes = 0
    chosen: list[tuple[int, int]] = []

    def search(at: int, room: int) -> bool:
        """Try completions with sizes[:at]; True once nothing better is possible."""
        nonlocal best, best_waste, nodes
        if room < best_waste:
            best, best_waste = list(chosen), room
            if not room:
                return True
        i = min(at, bisect_right(sizes, room)) - 1
        while i >= 0:
            if below[i + 1] <= room - best_waste:
                return False  # not enough left to beat the incumbent
            nodes += 1
            if nodes > budget:
                return True
            s = sizes[i]
            most = min(left[s], room // s)
            for k in range(most, 0, -1):
                chosen.append((s, k))
                done = search(i, room - s * k)
                chosen.pop()
                if done:
                    return True
            i -= 1
        return False

    search(len(sizes), room)
    return best


def forced_waste(left: dict[int, int], capacity: int) -> int:
    """Room that stays empty in any packing: beside large items for which too few small ones are left."""
    sizes = sorted(left)
    waste, spare, low, high = 0, 0, 0, len(sizes) - 1
    held = dict(left)
    while high >= 0:
        s = sizes[high]
        room = capacity - s
        while low < len(sizes) and sizes[low] <= room:
            spare += sizes[low] * held[sizes[low]]
            held[sizes[low]] = 0
            low += 1
        n = held[s]
        if not n:
            break
        waste += max(0, room * n - spare)
        spare = max(0, spare - room * n)
        high -= 1
    return waste


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs."""
    left = {s: n for s, n in counts.items() if n > 0}
    return -(-(sum(s * n for s, n in left.items()) + forced_waste(left, capacity)) // capacity)


def _sums(bits: int, size: int, count: int, mask: int) -> int:
    """Sums reachable with up to ``count`` more items of ``size``; bit i stands for sum i."""
    step = 1
    while count > 0:
        step = min(step, count)
        bits |= (bits << (size * step)) & mask
        count -= step
        step *= 2
    return bits


def _dominated(filling: list[tuple[int, int]], left: dict[int, int], slack: int, mask: int) -> bool:
    """Whether some items of a filling (or none) could give way to one remaining item that is at least as large as they together."""
    held = dict(filling)
    spare = 0
    for s, n in left.items():
        if n > held.get(s, 0):
            spare |= 1 << s
    sums, single = 1, 0
    several = 0
    for s, k in filling:
        for _ in range(k):
            several |= ((several | single) << s) & mask
            single |= 1 << s
        sums = _sums(sums, s, k, mask)
    smear, width = sums << 1, 1
    while width < slack:
        step = min(width, slack - width)
        smear |= smear << step
        width += step
    return bool(((smear if slack else 0) | several) & spare & mask)


class OutOfSteps(Exception):
    """A search ended before it was decided."""


def completions(left: dict[int, int], room: int, waste: int, steps: list[int] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Undominated fillings of ``room`` from ``left`` that waste at most ``waste``, ``(waste, filling)``, least waste first.

    The sums that the sizes up to each one can reach guide the enumeration, so it meets no dead ends. ``steps`` holds what
    may still be spent (OutOfSteps beyond it): each filling looked at costs as many steps as there are sizes.
    """
    sizes = [s for s in sorted(left) if s <= room and left[s]]
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for s in sizes:
        reach.append(_sums(reach[-1], s, min(left[s], room // s), mask))

    def fill(at: int, total: int, chosen: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        if not total:
            yield list(chosen)
            return
        while at and sizes[at - 1] > total:
            at -= 1
        while at:
            s = sizes[at - 1]
            for k in range(min(left[s], total // s), 0, -1):
                if reach[at - 1] >> (total - s * k) & 1:
                    chosen.append((s, k))
                    yield from fill(at - 1, total - s * k, chosen)
                    chosen.pop()
            at -= 1
            if not reach[at] >> total & 1:
                return

    for total in range(room, max(-1, room - waste - 1), -1):
        if reach[-1] >> total & 1:
            for filling in fill(len(sizes), total, []):
                if steps is not None:
                    steps[0] -= 1 + len(left)
                    if steps[0] < 0:
                        raise OutOfSteps
                if not _dominated(filling, left, room - total, mask):
                    yield room - total, filling


def search(counts: dict[int, int], capacity: int, bins: int, steps: list[int] | None = None) -> list[list[tuple[int, int]]] | None:
    """A packing into at most ``bins`` containers, None if there is none.

    Bin completion, one container after the other: the fillings around the largest item left are
    tried from the least waste up; those tried before are not tried again for items of the same size. ``steps``
    bounds them as in :func:`completions`; None is without limit.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    allowed = bins * capacity - sum(s * n for s, n in left.items())
    if allowed < forced_waste(left, capacity):
        return None
    done: list[list[tuple[int, int]]] = []
    # one frame per container: largest item, its fillings to come, those tried before, waste left, filling in place
    frames: list[list] = []
    # items left for which, with the containers left, no packing was found
    failed: set[tuple] = set()

    def enter(waste: int, tried: frozenset) -> bool:
        if not left:
            return True
        big = max(left)
        rest = {s: n - (s == big) for s, n in left.items()}
        same = tried if frames and frames[-1][0] == big else frozenset()
        frames.append([big, completions(rest, capacity - big, waste, steps), same, waste, None, None if same else (len(done), *sorted(left.items()))])
        return False

    def take(filling: list[tuple[int, int]], sign: int) -> None:
        for s, k in filling:
            n = left.get(s, 0) - sign * k
            if n:
                left[s] = n
            else:
                left.pop(s, None)

    if enter(allowed, frozenset()):
        return done
    while frames:
        frame = frames[-1]
        if frame[4] is not None:
            take(frame[4], -1)
            done.pop()
            frame[4] = None
        for waste, rest in frame[1]:
            key = tuple(rest)
            if key in frame[2]:
                continue
            merged = Counter({frame[0]: 1})
            for s, k in rest:
                merged[s] += k
            filling = sorted(merged.items(), reverse=True)
            earlier, frame[2] = frame[2], frame[2] | {key}
            take(filling, 1)
            if forced_waste(left, capacity) > frame[3] - waste or (len(done) + 1, *sorted(left.items())) in failed:
                take(filling, -1)
                continue
            frame[4] = filling
            done.append(filling)
            if enter(frame[3] - waste, earlier):
                return done
            break
        else:
            if frame[5]:
                failed.add(frame[5])
            frames.pop()
    return None


def _incumbent(counts: dict[int, int], capacity: int, nodes: int) -> list[Filling]:
    """Containers built around the largest item left; the completion found is repeated while its sizes last."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    out: list[Filling] = []
    while sizes:
        big = sizes[-1]
        left[big] -= 1
        room = capacity - big
        rest = complete(sizes, left, room, nodes) if nodes else _best_fit(sizes, left, room)
        left[big] += 1
        need: dict[int, int] = {big: 1}
        for s, k in rest:
            need[s] = need.get(s, 0) + k
        copies = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= k * copies
            if not left[s]:
                del left[s]
                sizes.remove(s)
        out.append(Filling(sorted(need.items(), reverse=True), copies, sum(s * k for s, k in need.items())))
    return out


def _gathered(fillings: list[list[tuple[int, int]]]) -> list[Filling]:
    copies = Counter(tuple(f) for f in fillings)
    return [Filling(list(f), n, sum(s * k for s, k in f)) for f, n in copies.items()]


def pack_histogram(counts: dict[int, int], capacity: int, budget: int | None = SEARCH_STEPS) -> list[Filling]:
    """Fillings that hold every item of a histogram ``size -> count`` (sizes 1..capacity).

    The better of best-fit decreasing and repeated completions is the incumbent. While it needs more
    containers than :func:`lower_bound`, its emptiest containers (4, 8, ... all of them) are searched for a
    packing with one less. ``budget`` bounds the steps in all (see SEARCH_STEPS); with None the result is
    proven to need the fewest containers.
    """
    best = min((_incumbent(counts, capacity, n) for n in (NODES_PER_FILLING, 0)), key=lambda fs: sum(f.copies for f in fs))
    bound = lower_bound(counts, capacity)
    steps = None if budget is None else [budget]
    try:
        while (total := sum(f.copies for f in best)) > bound:
            better = None
            many = 4
            while better is None:
                many = min(many, total)
                worst, kept, more = [], [], many
                for f in sorted(best, key=lambda f: f.used):
                    n = min(f.copies, more)
                    more -= n
                    if n:
                        worst.append(Filling(f.sizes, n, f.used))
                    if f.copies > n:
                        kept.append(Filling(f.sizes, f.copies - n, f.used))
                items: Counter = Counter()
                for f in worst:
                    for s, k in f.sizes:
                        items[s] += k * f.copies
                share = None if steps is None or many == total else [min(steps[0], budget // 8)]
                try:
                    found = search(items, capacity, many - 1, share or steps)
                except OutOfSteps:
                    if share is None:
                        raise
                    found = None
                if share is not None:
                    steps[0] -= min(steps[0], budget // 8) - max(0, share[0])
                if found is not None:
                    better = kept + _gathered(found)
                elif many == total:
                    return best
                many *= 2
            best = better
    except OutOfSteps:
        pass
    return best


def tokenizer(name: str, folder: str = TOKENIZER_DIR):
    """``text -> number of tokens`` of one of the public vocabularies, by file name."""
    path = os.path.join(folder, name)
    if name.endswith(".tiktoken"):
        import base64
        import importlib.util

        import tiktoken

        # the pattern of the vocabularies stands in the module beside them
        spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(sp.encode(text, num_threads=1))


def token_counts(docs: DataFrame, item: str, text: str, name: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``item, n_tokens`` of whole texts; a null text has 0 tokens."""
    src = docs.select(F.col(item).alias("item"), F.col(text).alias("text"))
    out_type = T.StructType([src.schema["item"], T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = None
        for b in batches:
            size = size or tokenizer(name, folder)
            n = [size(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["item", "n_tokens"])

    return src.mapInArrow(count, out_type)


def pack(sized: DataFrame, item: str, size: str, capacity: int, budget: int | None = SEARCH_STEPS) -> DataFrame:
    """``container, item, piece, n_tokens``: a container for every piece of every item.

    An item of at most ``capacity`` is one piece (number 0); a longer one is cut into full
    containers and a last piece with the rest. Null and negative sizes count as 0;
    items of size 0 need no room and lie in container 0. Repeated rows are separate
    items of which each gets room. The result depends only on the multiset of
    (size, item), not on partitioning or order. An empty table gives no rows.

    Rows are ranged by (size, item), so a size that a third of all items share is
    spread over tasks; rank within a size is the place in the partition plus the
    counts of the partitions before it. The driver sees one count per size, at most
    ``capacity`` numbers, and sends back the fillings.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be in 1..{MAX_CAPACITY}")
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    whole = F.expr(f"n div {capacity}")
    # written once: the range partitioning below samples its input, which would count tokens twice
    base = cut_lineage(sized.select(F.col(item).alias("item"), n.alias("n")))
    last = F.when((F.col("n") % capacity > 0) | (F.col("n") == 0), F.array(F.struct(whole.cast("int").alias("piece"), (F.col("n") % capacity).alias("size"))))
    full = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole.cast("int") - 1), lambda i: F.struct(i.alias("piece"), F.lit(capacity).cast("bigint").alias("size"))))
    none = F.array().cast("array<struct<piece:int,size:bigint>>")
    pieces = base.select("item", F.explode(F.concat(F.coalesce(full, none), F.coalesce(last, none))).alias("p")).select("item", "p.piece", "p.size")
    ranged = cut_lineage(pieces.repartitionByRange("size", "item", "piece").sortWithinPartitions("size", "item", "piece").withColumn("part", F.spark_partition_id()))
    per_part = ranged.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n"))
    # one row per size; a size is found in few partitions, all others hold one size only
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    histogram = {r["size"]: r["n"] for r in per_part.groupBy("size").agg(F.sum("n").alias("n")).where("size > 0").toLocalIterator()}
    fillings = pack_histogram(histogram, capacity, budget)
    shared = sized.sparkSession.sparkContext.broadcast(_places(fillings))
    placed_type = T.StructType([T.StructField("container", T.LongType()), ranged.schema["item"], T.StructField("piece", T.IntegerType()), T.StructField("n_tokens", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for b in batches:
            sizes = b.column(2).to_numpy(zero_copy_only=False)
            ranks = b.column(3).to_numpy(zero_copy_only=False)
            out = np.zeros(b.num_rows, np.int64)
            for s in np.unique(sizes).tolist():
                if s > 0:
                    mine = np.flatnonzero(sizes == s)
                    rank = ranks[mine]
                    low, per, first = places[s]
                    k = np.searchsorted(low, rank, side="right") - 1
                    out[mine] = first[k] + (rank - low[k]) // per[k]
            yield pa.RecordBatch.from_arrays([pa.array(out), b.column(0), b.column(1), b.column(2)], names=[f.name for f in placed_type])

    local = F.row_number().over(Window.partitionBy("part", "size").orderBy("item", "piece")) - 1
    ranked = ranged.withColumn("local", local).join(starts, ["part", "size"]).select("item", "piece", "size", (F.col("start") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, placed_type)


def _places(fillings: list[Filling]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """size -> (first rank, items per container, first container) of each filling that uses it."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for f in fillings:
        for s, k in f.sizes:
            rows.setdefault(s, []).append((taken.get(s, 0), k, base))
            taken[s] = taken.get(s, 0) + k * f.copies
        base += f.copies
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in rows.items()}
