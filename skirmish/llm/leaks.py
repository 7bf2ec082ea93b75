"""Evaluation items leaking into messages: rare n-gram seeds, then local alignment.

Words are 64-bit hashes, so neither a vocabulary nor the items are sent around: a Bloom filter of the
items' n-grams, of bounded size whatever their number, finds the passages in one pass over the corpus. Passages
and items then meet by joins on n-grams, and Smith-Waterman scores the pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.mime import html_text, text_parts
from skirmish.session import cut_lineage

GRAM = 5
REGION_GAP = 40
MATCH, MISMATCH, SKIP = 2, -1, -1
# Bits of the filter per n-gram and at most in all (64 MB), probes per n-gram.
FILTER_BITS, FILTER_MOST, PROBES = 32, 1 << 29, 6
# Tasks per core of the alignment.
ALIGN_TASKS = 4
# Words whose hash a task remembers.
REMEMBERED = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits, lower case, composed characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


def part_words(message: str | None) -> list[list[str]]:
    """Words of each text part of a message; a run of words never crosses parts."""
    return [words_of(html_text(p.text) if p.kind == "text/html" else p.text) for p in text_parts(message)]


class Codes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Rolling hash of every GRAM-long window of word codes."""
    n = len(codes) - GRAM + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(GRAM if n > 0 else 0):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[i : i + n] + np.uint64(0x632BE59BD9B4E019))
        h ^= h >> np.uint64(29)
    return h


class GramFilter:
    """Which n-gram hashes may be an item's; the bits are those of :func:`_filter_words`."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that pass every probe."""
        at = np.arange(len(h))
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            if not len(at):
                break
            bit = (low[at] + np.uint64(i) * high[at]) & self.mask
            at = at[(self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at


def _filter(grams: DataFrame) -> GramFilter:
    """The filter of a table of ``gram``; the driver gets its words, at most FILTER_MOST / 64 of them."""
    n = grams.count()
    bits = min(FILTER_MOST, max(1 << 13, 1 << (FILTER_BITS * max(1, n) - 1).bit_length()))
    low, high = F.col("gram").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("bigint"))
    bit = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: (low + i.cast("bigint") * high).bitwiseAND(bits - 1)))
    words = grams.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("word"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["at"]] = r["word"]
    return GramFilter(out.view(np.uint64))


def reach(matched: np.ndarray) -> int:
    """The most an alignment can score over a text of which ``matched`` tells the words that the other text has.

    Within an alignment a word matches or costs a mismatch or skip, whatever the order of the words.
    """
    total = np.concatenate(([0], np.cumsum(np.where(matched, MATCH, max(MISMATCH, SKIP)))))
    return int((total - np.minimum.accumulate(total)).max())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of two coded texts and their longest common run of words."""
    best = longest = 0
    n = len(b)
    up = np.zeros(n + 1, np.int64)
    run = np.zeros(n + 1, np.int64)
    slope = np.arange(n + 1) * -SKIP
    for x in a.tolist():
        same = b == x
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(up[:-1] + np.where(same, MATCH, MISMATCH), up[1:] + SKIP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.where(same, run[:-1] + 1, 0)
        up, run = row, new
        best, longest = max(best, int(row.max())), max(longest, int(new.max()))
    return best, longest


def _coded_items(items: DataFrame) -> DataFrame:
    """``item_id, codes, grams`` of items ``item_id, text``; null ids are left out."""
    out_type = T.StructType([items.schema["item_id"], T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.LongType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            coded = [codes.of(words_of(t.as_py() or "")) for t in b.column(1)]
            grams = [gram_hashes(c).view(np.int64) for c in coded]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.view(np.int64) for c in coded], pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "codes", "grams"])

    return items.where("item_id is not null").mapInArrow(code, out_type)


def _passages(src: DataFrame, gram_filter: GramFilter) -> DataFrame:
    """``doc_id, passage, codes, grams``: the passages of messages around n-grams that pass the filter."""
    shared = src.sparkSession.sparkContext.broadcast(gram_filter)
    out_type = T.StructType([src.schema["doc_id"], T.StructField("passage", T.IntegerType()), T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, word_codes = shared.value, Codes()
        for b in batches:
            at, numbers, codes_out, grams_out = [], [], [], []
            for i, message in enumerate(b.column(1)):
                seen: set[bytes] = set()
                for words in part_words(message.as_py()):
                    if len(words) < GRAM:
                        continue
                    codes = word_codes.of(words)
                    hashes = gram_hashes(codes)
                    pos = known.hits(hashes)
                    if not len(pos):
                        continue
                    for p in np.split(pos, np.flatnonzero(np.diff(pos) > REGION_GAP) + 1):
                        passage = codes[max(0, int(p[0]) - REGION_GAP) : int(p[-1]) + GRAM + REGION_GAP]
                        key = passage.tobytes()
                        if key not in seen:  # the HTML twin of a plain part
                            at.append(i)
                            numbers.append(len(seen))
                            codes_out.append(passage.view(np.int64))
                            grams_out.append(np.unique(hashes[p]).view(np.int64))
                            seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(codes_out, pa.list_(pa.int64())), pa.array(grams_out, pa.list_(pa.int64()))],
                names=["doc_id", "passage", "codes", "grams"],
            )

    return src.mapInArrow(cut, out_type)


def _seeds(grams: DataFrame, in_docs: DataFrame, run: int) -> DataFrame:
    """``gram, item_id``: in every window of ``run`` words of an item its rarest n-gram that the corpus has.

    Rare is what few items hold, then what few messages hold. A message that shares ``run``
    consecutive words with an item holds all n-grams of that window, so also its seed: no such pair is lost.
    """
    held = grams.groupBy("gram").agg(F.countDistinct("item_id").alias("n_items")).join(in_docs, "gram")
    there = grams.join(held, "gram", "left").withColumn("key", F.when(F.col("n_docs").isNotNull(), F.struct("n_items", "n_docs", "gram")))
    own = Window.partitionBy("item_id").orderBy("at")
    last = F.count(F.lit(1)).over(Window.partitionBy("item_id")) - 1
    width = max(0, run - GRAM)
    # the windows that begin at each place; items shorter than a window have one
    rarest = there.select("item_id", "at", last.alias("last"), F.min("key").over(own.rowsBetween(0, width)).alias("key"))
    return rarest.where((F.col("at") == 0) | (F.col("at") + width <= F.col("last"))).where("key is not null").select("key.gram", "item_id").distinct()


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12, least_share: float | None = None) -> DataFrame:
    """``doc_id, item_id, score, share, longest_run``: messages and items that share a rare passage.

    ``score`` is the best Smith-Waterman score (words; match 2, mismatch -1, skip -1) of
    a passage of the message against the item, ``share`` that score over the item's own
    (1.0: the whole item), ``longest_run`` the most consecutive words in common. All
    pairs that share ``run`` words or more are among them. With ``least_share`` also all edited
    copies of at least that share that keep any GRAM words of the item in a row: every n-gram of an
    item is a seed then, however many copies or items have it, and a passage is spared the
    alignment only if its words cannot reach the share.

    The corpus is read once: only the passages around n-grams that pass the items' filter are
    kept, written to the shared folder. They meet the items by n-gram; everything
    shuffled is in proportion to what passed the filter, not to the corpus. Null or empty texts
    match nothing, items shorter than GRAM words match nothing, rows with the same id
    count as one message or item.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    coded = cut_lineage(_coded_items(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))))
    grams = coded.select("item_id", F.posexplode("grams").alias("at", "gram"))
    kept = cut_lineage(_passages(src, _filter(grams.select("gram").distinct())))
    held = kept.select("doc_id", "passage", F.explode("grams").alias("gram"))
    in_docs = held.groupBy("gram").agg(F.countDistinct("doc_id").alias("n_docs"))
    seeds = _seeds(grams, in_docs, run).withColumn("sure", F.lit(True))
    if least_share is not None:
        every = grams.select("gram", "item_id").withColumn("sure", F.lit(False))
        seeds = seeds.unionByName(every).groupBy("gram", "item_id").agg(F.max("sure").alias("sure"))
    met = held.join(seeds, "gram").groupBy("doc_id", "passage", "item_id").agg(F.max("sure").alias("sure"))
    # alignment is heavy per row, so few bytes must not end up in few tasks; only ids are moved
    met = met.repartition(ALIGN_TASKS * docs.sparkSession.sparkContext.defaultParallelism, "doc_id", "passage")
    pairs = met.join(kept.select("doc_id", "passage", "codes"), ["doc_id", "passage"]).join(coded.select("item_id", F.col("codes").alias("own")), "item_id").select("doc_id", "passage", "item_id", "sure", "codes", "own")
    out_type = T.StructType([src.schema["doc_id"], coded.schema["item_id"], T.StructField("score", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("longest_run", T.IntegerType())])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, scores, shares, runs = [], [], [], []
            last, words, known = None, None, frozenset()
            ids = zip(b.column("doc_id"), b.column("passage").to_pylist(), strict=True)
            for i, (key, sure, passage, own) in enumerate(zip(ids, *[b.column(c) for c in ("sure", "codes", "own")], strict=True)):
                if key != last:  # pairs of a passage mostly come together
                    last, words = key, passage.values.to_numpy()
                    known = frozenset(words.tolist())
                item = own.values.to_numpy()
                full = MATCH * max(1, len(item))
                if not sure.as_py():
                    # the words in common bound the score, their places bound it closer
                    if MATCH * sum(c in known for c in item.tolist()) < least_share * full:
                        continue
                    if min(reach(np.isin(item, words)), reach(np.isin(words, item))) < least_share * full:
                        continue
                score, longest = align(item, words)
                at.append(i)
                scores.append(score)
                shares.append(score / full)
                runs.append(longest)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("item_id").take(take), pa.array(scores, pa.int64()), pa.array(shares, pa.float64()), pa.array(runs, pa.int32())],
                names=["doc_id", "item_id", "score", "share", "longest_run"],
            )

    found = pairs.mapInArrow(aligned, out_type)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("longest_run").alias("longest_run"))
