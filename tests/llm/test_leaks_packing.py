import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skirmish.llm import leaks, packing
from skirmish.llm.leaks import Codes, GramFilter, align, gram_hashes, leaked_items, reach, words_of
from skirmish.llm.packing import completions, complete, lower_bound, pack, pack_histogram, search, token_counts, tokenizer

WORDS = [f"w{i}" for i in range(300)]


def body(words):
    return "From: a@b.c\nContent-Type: text/plain\n\n" + " ".join(words)


@pytest.mark.parametrize("bits", [1 << 13, 1 << 29])
def test_every_run_of_twelve_is_found(spark, monkeypatch, bits):
    monkeypatch.setattr(leaks, "FILTER_MOST", bits)
    rng = random.Random(1)
    stock = rng.choices(WORDS, k=14)
    items = [(i, rng.choices(WORDS, k=40) + (stock if i % 2 else [])) for i in range(8)] + [(100, ["only", "three", "words"]), (101, [])]
    docs = []
    for d in range(120):
        w = rng.choices(WORDS, k=60)
        i, item = rng.choice(items[:8])
        n = rng.choice([0, 5, 11, 12, 13, 40])
        s = rng.randint(0, len(item) - n) if n <= len(item) else 0
        docs.append((d, w[:30] + item[s : s + n] + w[30:]))
    df = spark.createDataFrame([(d, body(w), "x") for d, w in docs] + [(900, None, "x"), (901, "", "x")], "doc_id bigint, text string, item_id string").repartition(4)
    it = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items] + [(None, "a b c d e f")], "item_id bigint, text string")
    out = leaked_items(df, "doc_id", "text", it, "item_id", "text", 12).collect()
    got = {(r.doc_id, r.item_id) for r in out if r.longest_run >= 12}
    grams = {}
    for i, w in items:
        for s in range(len(w) - 11):
            grams.setdefault(tuple(w[s : s + 12]), set()).add(i)
    want = {(d, i) for d, w in docs for s in range(len(w) - 11) for i in grams.get(tuple(w[s : s + 12]), ())}
    assert got == want and want
    assert all(0 <= r.share <= 1 for r in out)


def test_alignment_survives_edits():
    a = np.arange(20)
    assert align(a, a) == (40, 20)
    edited = np.concatenate((a[:8], [99], a[8:13], a[14:]))
    score, run = align(a, edited)
    assert run == 8 and score == 2 * 19 - 2
    assert align(a, np.full(5, 77)) == (0, 0) and align(np.array([], int), a) == (0, 0)


def test_edited_copy_is_aligned_beside_verbatim_ones(spark):
    item = WORDS[:40]
    edited = [f"x{k}" if k % 8 == 7 else w for k, w in enumerate(item)]
    docs = [(d, body(item)) for d in range(5)] + [(9, body(WORDS[200:230] + edited + WORDS[230:260])), (10, body(WORDS[100:130] + item[:6]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(WORDS[100:140]))], "item_id bigint, text string")
    out = {(r.doc_id, r.item_id): r for r in leaked_items(df, "doc_id", "text", it, "item_id", "text", 12, 0.5).collect()}
    assert {k for k, r in out.items() if r.share >= 0.5} == {(d, 1) for d in (0, 1, 2, 3, 4, 9)} | {(10, 2)}
    assert out[9, 1].longest_run == 7 and out[9, 1].score == 2 * 35 - 4


def test_reach_bounds_the_alignment():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = rng.integers(0, 12, rng.integers(1, 30)), rng.integers(-1, 12, rng.integers(1, 30))
        assert align(a, b)[0] <= min(reach(np.isin(a, b)), reach(np.isin(b, a)))


def test_words_codes_and_filter(monkeypatch):
    assert words_of("Él_dijo: 3,5 Straße—ok") == ["él", "dijo", "3", "5", "straße", "ok"]
    monkeypatch.setattr(leaks, "REMEMBERED", 3)
    words = [f"w{i % 7}" for i in range(50)]
    assert np.array_equal(Codes().of(words), np.concatenate([Codes().of([w]) for w in words]))
    assert len(gram_hashes(Codes().of(words))) == 46 and len(gram_hashes(Codes().of(words[:3]))) == 0
    assert len(GramFilter(np.zeros(128, np.uint64)).hits(gram_hashes(Codes().of(words)))) == 0


def test_filter_passes_every_item_gram(spark):
    rng = np.random.default_rng(1)
    grams = rng.integers(-(1 << 62), 1 << 62, 2000)
    f = leaks._filter(spark.createDataFrame([(int(g),) for g in grams], "gram bigint"))
    assert len(f.hits(grams.view(np.uint64))) == 2000
    assert len(f.hits(rng.integers(-(1 << 62), 1 << 62, 100_000).view(np.uint64))) < 50


@pytest.mark.parametrize("percent", [10, 15, 20])
def test_recall_of_edited_copies_beside_intact_ones(spark, percent):
    """Each item once intact and once with replaced words; pairs that truly align over half the item."""
    rng = random.Random(percent)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, rng.choices(vocabulary, k=rng.randint(30, 90))) for i in range(120)]
    docs, want = [], set()
    for i, w in items:
        edited = [rng.choice(vocabulary) if rng.random() < percent / 100 else x for x in w]
        noise = [rng.choices(vocabulary, k=30) for _ in range(4)]
        docs += [(2 * i, body(noise[0] + w + noise[1])), (2 * i + 1, body(noise[2] + edited + noise[3]))]
        codes = Codes()
        if align(codes.of(w), codes.of(edited))[0] >= 0.5 * 2 * len(w):
            want.add((2 * i + 1, i))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(df, "doc_id", "text", it, "item_id", "text", 12, 0.5).collect() if r.share >= 0.5}
    assert len(want) > 100 and len(got & want) >= 0.98 * len(want)
    assert {(2 * i, i) for i, _ in items} <= got


def test_item_ids_of_any_type(spark):
    import datetime as dt

    item = WORDS[:20]
    it = spark.createDataFrame([(dt.date(2020, 1, 1), " ".join(item))], "item_id date, text string")
    df = spark.createDataFrame([("d", body(item))], "doc_id string, text string")
    assert [(r.doc_id, r.item_id, r.longest_run) for r in leaked_items(df, "doc_id", "text", it, "item_id", "text").collect()] == [("d", dt.date(2020, 1, 1), 20)]


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leaked_items(docs, "doc_id", "text", items, "item_id", "text").count() == 0


def check(counts, fillings, capacity):
    used = Counter()
    for f in fillings:
        assert f.copies > 0 and sum(s * k for s, k in f.sizes) == f.used <= capacity
        for s, k in f.sizes:
            used[s] += k * f.copies
    assert used == Counter({s: n for s, n in counts.items() if n})


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_packing_holds_every_item(counts):
    fillings = pack_histogram(counts, 50)
    check(counts, fillings, 50)
    total = sum(s * n for s, n in counts.items())
    assert sum(f.copies for f in fillings) <= 2 * total / 50 + 1


def test_completion_finds_an_exact_fill_where_best_fit_does_not():
    left = {7: 1, 5: 1, 4: 1, 6: 1}
    assert sum(s * k for s, k in complete(sorted(left), left, 11)) == 11
    assert sum(s * k for s, k in complete([4, 5], {4: 3, 5: 1}, 12)) == 12
    assert complete([], {}, 5) == [] and complete([9], {9: 1}, 5) == []


def fewest(items, capacity):
    """Brute force: the fewest containers, items in falling order into every open container or a new one."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, loads):
        if len(loads) >= best[0]:
            return
        if i == len(items):
            best[0] = len(loads)
            return
        for j, load in enumerate(loads):
            if load + items[i] <= capacity and load not in loads[:j]:
                place(i + 1, [*loads[:j], load + items[i], *loads[j + 1 :]])
        place(i + 1, [*loads, items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=11))
def test_search_until_proven_needs_the_fewest_containers(items):
    counts = Counter(items)
    fillings = pack_histogram(counts, 30, None)
    check(counts, fillings, 30)
    n = fewest(items, 30)
    assert sum(f.copies for f in fillings) == n >= lower_bound(counts, 30)
    assert search(counts, 30, n) is not None and search(counts, 30, n - 1) is None


@pytest.mark.parametrize("seed", range(30))
def test_perfect_triples(seed):
    rng = random.Random(seed)
    items = []
    for _ in range(20):
        a = rng.randint(250, 450)
        b = rng.randint(251, 999 - a - 200) if 999 - a - 200 > 251 else 251
        items += [a, b, 1000 - a - b]
    counts = Counter(items)
    fillings = pack_histogram(counts, 1000)
    check(counts, fillings, 1000)
    assert sum(f.copies for f in fillings) == 20


def test_completions_are_undominated():
    got = list(completions({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10, 3))
    assert got[0] == (0, [(6, 1), (4, 1)]) and all(sum(s * k for s, k in f) == 10 - w for w, f in got)
    assert (0, [(5, 1), (3, 1), (2, 1)]) in [(w, sorted(f, reverse=True)) for w, f in got] or all(f != [(5, 1), (3, 1), (2, 1)] for _, f in got)
    assert list(completions({10: 1, 5: 2}, 10, 10)) == [(0, [(10, 1)])]
    assert list(completions({}, 3, 3)) == [(3, [])] and list(completions({}, 3, 2)) == []


def test_pack_spark(spark):
    rng = random.Random(7)
    sizes = [rng.choice([0, 1, 30, 30, 64, 100, 101, 250, None, -3]) for _ in range(600)]
    rows = [(i % 500, s, 1) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc bigint, n int, container int").repartition(5)
    out = pack(df, "doc", "n", 100).collect()
    room = Counter()
    for r in out:
        room[r.container] += r.n_tokens
    assert max(room.values()) <= 100
    want = Counter()
    for d, s, _ in rows:
        s = max(0, s or 0)
        for p in range(max(1, -(-s // 100))):
            want[d, p, min(100, s - 100 * p)] += 1
    assert Counter((r.item, r.piece, r.n_tokens) for r in out) == want
    assert set(room) == set(range(max(room) + 1)) and sum(room.values()) / (100 * len(room)) > 0.95
    again = pack(df.repartition(2), "doc", "n", 100).collect()
    assert sorted((r.container, r.n_tokens) for r in again) == sorted((r.container, r.n_tokens) for r in out)
    assert pack(df.limit(0), "doc", "n", 100).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc", "n", 0)


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers(spark, name):
    try:
        size = tokenizer(name)
    except (OSError, ImportError) as e:
        pytest.skip(str(e))
    assert size("") == 0 and 0 < size("hello <|endoftext|> world") < 40
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5)], "doc bigint, text string, n_tokens int")
    got = {r.item: r.n_tokens for r in token_counts(df, "doc", "text", name).collect()}
    assert got == {1: size("hello world"), 2: 0, 3: 0}
    assert packing.MAX_CAPACITY >= 8192
