"""Benchmark passages in documents: spaced seeds find them, an alignment confirms them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import column, keyed_text, without_ids

# Seeds over consecutive words, by the least number of words of the items they
# are for; 1 must agree, 0 may differ. Chosen by enumeration: every alignment that meets
# the threshold is hit (``missed``). All but that of a single word begin with two words
# that must agree, which are looked up before the rest of a seed is made.
MASKS = {
    1: ["1"], 2: ["11"], 3: ["111"], 4: ["1111"], 5: ["11111"], 6: ["11011", "1111"], 8: ["111011", "11000111"],
    11: ["1101011", "1100111"], 15: ["11010111", "111000001101"],
}
# An aligned stretch of WINDOW words with at least AGREE equal ones is an overlap.
WINDOW, AGREE = 16, 13
# Words of benchmark text up to which its hashes are sent to every task.
SENT_WORDS = 200_000
# Positions of a document that one row of the search covers.
STRETCH = 256


def words_of(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lead(words: Column, at: Column) -> Column:
    """The two words from a position on, as one number."""
    return F.shiftleft(F.get(words, at), 1).bitwiseXOR(F.get(words, at + 1))


def seed(words: Column, at: Column, mask: str) -> Column:
    """Hash of the words that a mask picks, from a position counted from 0; null where the
    mask reaches beyond the last word."""
    picked = F.xxhash64(F.lit(mask), *[F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"])
    return F.when(at + len(mask) <= F.size(words), picked)


def masks_for(size: int, masks: dict[int, list[str]]) -> list[str]:
    """The masks of items of ``size`` words."""
    return masks[max((least for least in masks if least <= size), default=min(masks))]


def missed(masks: list[str], size: int, changes: int) -> list[tuple[int, ...]]:
    """The ways to change ``changes`` of ``size`` words that leave no mask a place."""
    placed = [[at + i for i, bit in enumerate(m) if bit == "1"] for m in masks for at in range(size - len(m) + 1)]
    return [c for c in combinations(range(size), changes) if all(set(c) & set(p) for p in placed)]


def seeds(df: DataFrame, at: str, masks: list[str], wanted: dict[str, Column] | None = None) -> DataFrame:
    """Rows (..., seed) for every mask that fits at the position of a row, and is ``wanted``
    there."""
    made = [seed(F.col("words"), F.col(at), m) for m in masks]
    if wanted:
        made = [F.when(wanted[m], s) for m, s in zip(masks, made)]
    return df.select("*", F.explode(F.array(*made)).alias("seed")).where("seed is not null")


def best_window(pairs: Column, size: Column) -> Column:
    """Most equal words in any ``size`` consecutive places of an array of 0 and 1."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(pairs) - size + 1, F.lit(1)))
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(pairs, s, size), F.lit(0), lambda a, x: a + x)))


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    masks: dict[int, list[str]] = MASKS, window: int = WINDOW, agree: int = AGREE, sent_words: int = SENT_WORDS,
) -> DataFrame:
    """Pairs of a document and a benchmark item that share a passage: ``id, item_id,
    start`` (first aligned word of the best alignment) and ``agreeing`` (equal words in
    its best window).

    A window of ``window`` aligned words must have ``agree`` equal ones, at any place of
    the document; an item of fewer words must agree in the same share of its words, down to
    one of a single word. A text without spaces is one word. Every such alignment holds a
    seed; masks that do not reach ``window`` and ``agree`` are an error.
    Null or empty texts and items have no words and no overlaps; rows with a null key are
    left out; repeated rows give one pair. Only DataFrame expressions are used. The
    hashes of the benchmark are broadcast while it has at most ``sent_words`` words, and
    joined as they are beyond. A document is searched in stretches, each with as many
    words around it as the longest item has, so that rows stay short.
    """
    if any(m != "1" and (not m.startswith("11") or not m.endswith("1") or set(m) - {"0", "1"}) for ms in masks.values() for m in ms):
        raise ValueError("masks hold 0 and 1, begin with 11 and end with 1")
    for n in range(1, window + 1):
        if missed(masks_for(n, masks), n, n + -(n * agree) // window):
            raise ValueError(f"the masks for items of {n} words do not hit every alignment")
    items = benchmark.select(column(item).cast("long").alias("item_id"), column(item_text).cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null").select("item_id", words_of(F.col("text")).alias("words"))
    n_words = F.size("words")
    # Items that share an id but not their words are told apart; equal ones are one.
    items = items.where(n_words > 0).withColumn("item_row", F.xxhash64("item_id", "words")).dropDuplicates(["item_row"])
    total, longest, lengths = items.agg(F.sum(n_words), F.max(n_words), F.collect_set(F.least(n_words, F.lit(window)))).first()
    # Of each mask that an item needs, the lengths of the items it is for.
    uses: dict[str, list[int]] = {}
    for n in lengths:
        for m in masks_for(n, masks):
            uses.setdefault(m, []).append(n)
    used = sorted(uses) or ["11"]
    total, reach = total or 0, max(longest or 0, max(map(len, used)))
    places = items.select("*", F.explode(F.sequence(F.lit(0), n_words - 1)).alias("item_at"))
    leads = places.select(lead(F.col("words"), F.col("item_at")).alias("lead")).where("lead is not null").distinct()
    singles = items.where(n_words == 1).select(F.get("words", F.lit(0)).alias("lead")).distinct()
    asked = {m: F.least(n_words, F.lit(window)).isin(*uses.get(m, [])) for m in used}
    # Seeds name their item; its words are looked up for the hits alone.
    wanted = seeds(places, "item_at", used, asked).select("seed", "item_row", "item_at")
    bodies = items.select("item_row", "item_id", F.col("words").alias("item_words"))
    if total <= sent_words:
        leads, singles, wanted, bodies = map(F.broadcast, (leads, singles, wanted, bodies))
    texts = keyed_text(docs, key, text).where("id is not null and text is not null").select("id", words_of(F.col("text")).alias("all"))
    # From ``base`` on, the words of a stretch and ``reach`` more on either side.
    texts = texts.select("id", "all", F.explode(F.sequence(F.lit(0), F.size("all"), F.lit(STRETCH))).alias("from"))
    base = F.greatest(F.col("from") - reach, F.lit(0))
    texts = texts.select("id", base.alias("base"), (F.col("from") - base).alias("skip"), F.slice("all", base + 1, STRETCH + 2 * reach).alias("words"))
    last = F.least(F.col("skip") + STRETCH, F.size("words")) - 1
    texts = texts.select("id", "base", "words", F.explode(F.when(last >= F.col("skip"), F.sequence("skip", last))).alias("at"))
    led = texts.withColumn("lead", lead(F.col("words"), F.col("at"))).join(leads, "lead", "left_semi").drop("lead")
    found = seeds(led, "at", [m for m in used if m != "1"] or ["11"])
    if "1" in used:
        alone = texts.withColumn("lead", F.get("words", F.col("at"))).join(singles, "lead", "left_semi").drop("lead")
        found = found.union(seeds(alone, "at", ["1"]))
    hits = found.join(wanted, "seed").join(bodies, "item_row")
    # Lay the item along the document so that the hit falls on itself. An alignment that
    # several seeds find is kept once, with the words of the document that it covers.
    start = F.col("at") - F.col("item_at")
    covered = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("item_words") + F.least(start, F.lit(0)))
    aligned = hits.select("id", "item_id", (F.col("base") + start).alias("start"), covered.alias("doc_words"), "item_words")
    aligned = aligned.groupBy("id", "item_id", "start", F.xxhash64("doc_words").alias("version"))
    # An aggregate rather than a distinct: a filter is not moved from above it into the join.
    aligned = aligned.agg(F.max("doc_words").alias("doc_words"), F.max("item_words").alias("item_words"))
    # Places outside of the document do not agree.
    skipped = F.least(F.col("start"), F.lit(0))
    equal = F.transform(
        "item_words",
        lambda w, i: F.when(i + skipped < 0, 0).otherwise(F.coalesce((F.get(F.col("doc_words"), F.greatest(i + skipped, F.lit(0))) == w).cast("int"), F.lit(0))),
    )
    compared = aligned.select("id", "item_id", "start", equal.alias("equal"), F.least(F.lit(window), F.size("item_words")).alias("size"))
    confirmed = compared.withColumn("agreeing", best_window(F.col("equal"), F.col("size")))
    confirmed = confirmed.where(F.col("agreeing") * window >= F.col("size") * agree)
    top = F.max(F.struct("agreeing", (-F.col("start")).alias("back")))
    return confirmed.groupBy("id", "item_id").agg(top.alias("top")).select(
        "id", "item_id", (-F.col("top.back")).cast("long").alias("start"), F.col("top.agreeing").cast("long").alias("agreeing")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that overlap with the benchmark; rows with a null
    key are kept."""
    return without_ids(docs, key, find_overlaps(docs, benchmark, key, text, **options))
