"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.names import name_key, term_key
from skirmish.llm import oracles
from skirmish.llm.leaks import MATCH, leaked_items
from skirmish.llm.packing import pack, token_counts
from skirmish.llm.percentiles import exact_percentiles, merge_counts, value_counts
from skirmish.llm.sentences import message_sentences
from skirmish.llm.terms import term_frequencies
from skirmish.llm.topn import top_n
from skirmish.operators.delivery import once_per_key
from skirmish.session import load, spread

BUCKET = ["log_id", "enc_id", "metric", "fighter", "category", "source_name", "pet"]
TOP = 5


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest buckets of each metric of each encounter."""
    newest = load(spark, sf_dir, "sources").groupBy(*BUCKET).agg(F.max(F.struct("revision", "total")).getField("total").alias("total"))
    best = top_n(newest, BUCKET[:3], "total", BUCKET[3:], TOP)
    return best.select(*BUCKET[:6], F.coalesce("pet", F.lit("")).alias("pet"), "rank_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spell and verb with its events, encounters and mark."""
    raw = load(spark, sf_dir, "combat_events")
    terms = {c: term_key(F.col(c)) for c in ("spell", "verb")}
    ev = once_per_key(raw, ["log_id", "line_no"], "arrived_at", {"enc_id": F.col("enc_id"), **terms})
    out = term_frequencies(ev, {"spell": F.col("spell"), "verb": F.col("verb")}, ["log_id", "enc_id"], few=3, common_share=0.1, records=raw)
    return out.select("field", "term", F.col("n_occurrences").alias("n_events"), F.col("n_records").alias("n_encounters"), "mark")


def _damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"action": F.col("action"), "attacker": name_key(F.col("attacker")), "amount": F.col("amount"), "ts": F.col("ts")}
    ev = once_per_key(load(spark, sf_dir, "combat_events"), ["log_id", "line_no"], "arrived_at", cols)
    return ev.where("action = 'damage' and amount > 0 and attacker is not null")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th and 99th percentile of each attacker's damage hits."""
    out = exact_percentiles(value_counts(_damage(spark, sf_dir), "attacker", "amount"), [50, 90, 99], least=50)
    return out.select(F.col("grp").alias("attacker"), "pct", F.col("value").alias("amount"))


def p6_merged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures from states that were counted per log and put together afterwards."""
    dmg = _damage(spark, sf_dir)
    per_log = dmg.groupBy("log_id", "attacker", "amount").agg(F.count(F.lit(1)).alias("n"))
    state = merge_counts(per_log.select(F.col("attacker").alias("grp"), F.col("amount").alias("v"), "n"))
    out = exact_percentiles(state, [50, 90, 99], least=50)
    return out.select(F.col("grp").alias("attacker"), "pct", F.col("value").alias("amount"))


CONTAINER_TOKENS = 8192
QUANTITY_ROOM = 120
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAK_WORDS = 12
LEAK_SHARE = 0.5


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container of CONTAINER_TOKENS for every message, longer messages in pieces."""
    sized = token_counts(spread(load(spark, sf_dir, "documents")), "doc_id", "text", VOCABULARY)
    return pack(sized, "item", "n_tokens", CONTAINER_TOKENS).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, used and unused tokens of every container."""
    out = p7_packing(spark, sf_dir).groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("used"))
    return out.withColumn("unused", F.lit(CONTAINER_TOKENS).cast("bigint") - F.col("used"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must hold to: every message in it, none cut that fits, no container over its capacity, none empty."""
    out = p7_packing(spark, sf_dir)
    per_doc = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    docs = per_doc.agg(F.count(F.lit(1)).alias("n_messages"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= CONTAINER_TOKENS)).alias("cut_but_fit"))
    rooms = out.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    rooms = rooms.agg(F.count_if(F.col("used") > CONTAINER_TOKENS).alias("overfull"), F.count_if((F.col("used") == 0) & (F.col("container") > 0)).alias("empty"))
    both = docs.unionByName(rooms, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def p7_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by quantity in containers of QUANTITY_ROOM: items, their sum, the fullest container, containers used."""
    li = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.floor("l_quantity").cast("bigint").alias("n"))
    rooms = pack(li, "line", "n", QUANTITY_ROOM).groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("used"))
    return rooms.agg(F.sum("items").alias("n_items"), F.sum("used").alias("total"), F.max("used").alias("fullest"), F.count(F.lit(1)).alias("n_containers"))


def _leaks(spark: SparkSession, sf_dir: str, least_share: float | None = None) -> DataFrame:
    return leaked_items(spread(load(spark, sf_dir, "documents")), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text", LEAK_WORDS, least_share)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and the items of which they hold at least twelve consecutive words."""
    # the alignment of a run of n words scores at least n matches; the exact run decides among what scores that
    return _leaks(spark, sf_dir).where(F.col("score") >= MATCH * LEAK_WORDS).where(F.col("longest_run") >= LEAK_WORDS).select("doc_id", "item_id")


def p8_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that align over at least half an item, edited copies included, or share twelve consecutive words."""
    return _leaks(spark, sf_dir, LEAK_SHARE).where((F.col("share") >= LEAK_SHARE) | (F.col("longest_run") >= LEAK_WORDS)).withColumn("share", F.round("share", 4))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sentences each message's sender wrote."""
    return message_sentences(spread(load(spark, sf_dir, "documents")), "doc_id", "text")


def p8_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made of runs of 0 to 29 words of the items, and the items that share twelve words with them."""
    items = load(spark, sf_dir, "eval_items")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    runs = items.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("n"), words.alias("w"))
    run = F.array_join(F.slice("w", F.pmod(F.col("item_id") + F.col("n"), F.greatest(F.size("w") - 12, F.lit(1))).cast("int") + 1, F.col("n")), " ")
    text = F.concat(F.lit("From: a@kiln.example\nContent-Type: text/plain\n\nplanted words "), run, F.lit("\nplanted end"))
    docs = runs.select((F.col("item_id") * 100 + F.col("n")).alias("doc_id"), text.alias("text"))
    out = leaked_items(docs, "doc_id", "text", items, "item_id", "text", LEAK_WORDS)
    return out.where(F.col("score") >= MATCH * LEAK_WORDS).where(F.col("longest_run") >= LEAK_WORDS).select("doc_id", "item_id")


def p9_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of four sentences around each part's name, and the sentences found in them."""
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    lines = [F.lit("From: a@kiln.example\nContent-Type: text/plain\n\nPart no. "), key, F.lit(" is the "), name, F.lit(". Dr. Vexa paid 3.5 coins for it! \"Where is\nit?\" asked Bron. 昨夜届いた。\n\n> Old words.\n-- \nMira. Sender.")]
    docs = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(*lines).alias("text"))
    return message_sentences(docs, "doc_id", "text")


QUERIES = {
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_merged_logs": p6_merged_logs,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p7_check": p7_check,
    "p7_quantities": p7_quantities,
    "p8_found": p8_found,
    "p8_alignments": p8_alignments,
    "p8_planted": p8_planted,
    "p9_found": p9_found,
    "p9_planted": p9_planted,
}
ORACLES = oracles.ORACLES
