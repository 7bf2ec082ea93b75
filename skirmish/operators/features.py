"""Per-entity feature tables on bit-sliced counters.

Every (event type, measure) pair is one number per entity. Instead of a hash
table of numbers, the numbers of a type are stored *bit-sliced* over entity
ordinals: slice ``i`` is a bitmap holding bit ``i`` of every entity's number.
Adding a batch is a ripple-carry addition of bitmaps, 64 entities per machine
word and operation. Bitmaps are compressed to the words that are not zero,
so a type that few entities use costs only those words. The latest stamp is an
array aligned to the same ordinals.

The same accumulator runs twice: over raw events before the shuffle (its
decoded rows are the partial aggregates) and over these partials afterwards, so
a hot entity reaches the shuffle already folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITIES_PER_BLOCK = 65_536
ROWS_PER_ADD = 131_072
NO_STAMP = np.iinfo(np.int64).min


class BitSliced:
    """One unsigned 64-bit number (mod 2**64) per ordinal, as compressed bit slices."""

    __slots__ = ("slices", "words")

    def __init__(self) -> None:
        self.words = np.empty(0, np.int64)
        self.slices: list[np.ndarray] = []

    @staticmethod
    def _sliced(ordinals: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        words, starts = np.unique(ordinals >> 6, return_index=True)
        place = (ordinals & 63).astype(np.uint64)
        top = int(values.max()).bit_length() if len(values) else 0
        one = np.uint64(1)
        return words, [
            np.bitwise_or.reduceat(((values >> np.uint64(i)) & one) << place, starts) for i in range(top)
        ]

    def add(self, ordinals: np.ndarray, values: np.ndarray) -> None:
        """Add one value per ordinal; ordinals ascending and distinct, values uint64."""
        if not len(ordinals):
            return
        words, other = self._sliced(ordinals, values)
        if not len(self.words):
            self.words, self.slices = words, other
            return
        if len(words) != len(self.words) or not np.array_equal(words, self.words):
            both = np.union1d(self.words, words)
            self.slices = [self._spread(s, self.words, both) for s in self.slices]
            other = [self._spread(s, words, both) for s in other]
            self.words = both
        carry = np.zeros(len(self.words), np.uint64)
        for i in range(64):
            if i >= len(other) and not carry.any():
                break
            if i >= len(self.slices):
                self.slices.append(np.zeros(len(self.words), np.uint64))
            a = self.slices[i]
            b = other[i] if i < len(other) else np.zeros_like(a)
            half = a ^ b
            self.slices[i] = half ^ carry
            carry = (a & b) | (carry & half)

    @staticmethod
    def _spread(s: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.zeros(len(new), np.uint64)
        out[np.searchsorted(new, old)] = s
        return out

    def ordinals(self) -> np.ndarray:
        """Ordinals whose number is not zero, ascending."""
        if not self.slices:
            return np.empty(0, np.int64)
        any_bit = np.bitwise_or.reduce(np.array(self.slices))
        bits = np.unpackbits(any_bit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, b = np.nonzero(bits)
        return self.words[w] * 64 + b

    def decode(self, ordinals: np.ndarray) -> np.ndarray:
        """Numbers at ``ordinals`` (0 where absent), as uint64."""
        out = np.zeros(len(ordinals), np.uint64)
        if not len(self.words):
            return out
        at = np.minimum(np.searchsorted(self.words, ordinals >> 6), len(self.words) - 1)
        there = self.words[at] == ordinals >> 6
        place = (ordinals & 63).astype(np.uint64)
        for i, s in enumerate(self.slices):
            out |= ((s[at] >> place) & np.uint64(1)) << np.uint64(i)
        return np.where(there, out, np.uint64(0))


class LatestTimes:
    """Latest stamp per ordinal, in rows of 64 aligned to the bitmap words."""

    __slots__ = ("rows", "words")

    def __init__(self) -> None:
        self.words = np.empty(0, np.int64)
        self.rows = np.empty((0, 64), np.int64)

    def add(self, ordinals: np.ndarray, stamps: np.ndarray) -> None:
        words = np.unique(ordinals >> 6)
        if len(words) != len(self.words) or not np.array_equal(words, self.words):
            both = np.union1d(self.words, words)
            rows = np.full((len(both), 64), NO_STAMP)
            rows[np.searchsorted(both, self.words)] = self.rows
            self.words, self.rows = both, rows
        at = (np.searchsorted(self.words, ordinals >> 6), ordinals & 63)
        self.rows[at] = np.maximum(self.rows[at], stamps)

    def decode(self, ordinals: np.ndarray) -> np.ndarray:
        return self.rows[np.searchsorted(self.words, ordinals >> 6), ordinals & 63]


class FeatureBlock:
    """Counters, totals and latest stamps of up to ENTITIES_PER_BLOCK entities."""

    def __init__(self) -> None:
        self.ordinal: dict[tuple, int] = {}
        self.types: dict[str, tuple[BitSliced, BitSliced, LatestTimes]] = {}

    def add(self, entities: list[tuple], codes: np.ndarray, types: list[str], type_codes: np.ndarray, n, total, last) -> None:
        """Add rows; ``codes`` index ``entities``, ``type_codes`` index ``types``."""
        known = self.ordinal
        ords = np.fromiter((known.setdefault(e, len(known)) for e in entities), np.int64, len(entities))[codes]
        order = np.lexsort((ords, type_codes))
        o, t = ords[order], type_codes[order]
        starts = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (t[1:] != t[:-1]))))
        o, t = o[starts], t[starts]
        n = np.add.reduceat(n[order], starts)
        total = np.add.reduceat(total[order], starts)
        last = np.maximum.reduceat(last[order], starts)
        cuts = [*np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))).tolist(), len(t)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            counts, totals, latest = self.types.setdefault(types[t[s]], (BitSliced(), BitSliced(), LatestTimes()))
            counts.add(o[s:e], n[s:e].astype(np.uint64))
            totals.add(o[s:e], total[s:e].view(np.uint64))
            latest.add(o[s:e], last[s:e])

    def features(self) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray, np.ndarray]]:
        """Decoded ``(ordinals, type, counts, totals, latest)`` per type."""
        for name, (counts, totals, latest) in self.types.items():
            o = counts.ordinals()
            yield o, name, counts.decode(o).view(np.int64), totals.decode(o).view(np.int64), latest.decode(o)


def entity_features(df: DataFrame, entity: list[str], event_type: str, n: str, total: str, last: str, whole_entities: bool) -> DataFrame:
    """Fold rows into ``entity, event_type, n, total, last`` with the accumulator above.

    Without ``whole_entities`` every task folds what it reads (a map-side
    combine, no shuffle); with it the rows are first brought together by entity.
    ``n`` and ``total`` are bigint, totals add modulo 2**64 like a bigint sum
    without overflow checks; ``last`` is a timestamp, null where no row had one.
    Null entities and types are ordinary values, an empty table gives an empty
    result, other columns are dropped.
    """
    src = df.select(*entity, event_type, n, total, last)
    fields = src.schema.fields
    out_type = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    names = [f.name for f in fields]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, buffer, held = FeatureBlock(), [], 0

        def codes_of(col: pa.Array) -> tuple[np.ndarray, list]:
            d = col.dictionary_encode(null_encoding="encode")
            return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()

        def take_in(tables: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(tables).combine_chunks()
            mixed, sets = np.zeros(t.num_rows, np.int64), []
            for e in entity:
                c, values = codes_of(t.column(e).combine_chunks())
                mixed = mixed * max(1, len(values)) + c
                sets.append((c, values))
            _, first, codes = np.unique(mixed, return_index=True, return_inverse=True)
            entities = list(zip(*[[values[k] for k in c[first].tolist()] for c, values in sets], strict=True))
            type_codes, types = codes_of(t.column(event_type).combine_chunks())
            stamps = t.column(last).cast(pa.int64()).fill_null(int(NO_STAMP)).to_numpy()
            block.add(entities, codes, types, type_codes, t.column(n).fill_null(0).to_numpy(), t.column(total).fill_null(0).to_numpy(), stamps)

        def decoded() -> Iterator[pa.RecordBatch]:
            stamp = None
            keys = list(block.ordinal)
            for o, name, c, s, x in block.features():
                mine = [keys[k] for k in o.tolist()]
                cols = [pa.array(v, src_types[i]) for i, v in enumerate(zip(*mine, strict=True))]
                stamp = pa.array(x, pa.int64(), mask=x == NO_STAMP).cast(src_types[-1])
                cols += [pa.array([name] * len(o), src_types[-4]), pa.array(c, pa.int64()), pa.array(s, pa.int64()), stamp]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        src_types: list[pa.DataType] = []
        tail: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            src_types = src_types or [f.type for f in b.schema]
            if held >= ROWS_PER_ADD:
                take_in(buffer)
                buffer, held = [], 0
                if len(block.ordinal) >= ENTITIES_PER_BLOCK:
                    if whole_entities:
                        # rows are sorted by entity: finish the last one before the block is given out
                        ahead = [[x.as_py() for x in b.column(i)] for i in range(len(entity))]
                        previous = list(block.ordinal)[-1] if tail is None else tuple(c[-1].as_py() for c in tail.columns[: len(entity)])
                        same = 0
                        while same < b.num_rows and tuple(c[same] for c in ahead) == previous:
                            same += 1
                        if same:
                            take_in([b.slice(0, same)])
                            b = b.slice(same)
                        if not b.num_rows:
                            continue
                    yield from decoded()
                    block = FeatureBlock()
            buffer.append(b)
            held += b.num_rows
            tail = b.slice(b.num_rows - 1)
        if buffer:
            take_in(buffer)
        yield from decoded()

    if whole_entities:
        src = src.repartition(*entity).sortWithinPartitions(*entity)
    return src.mapInArrow(fold, out_type)
