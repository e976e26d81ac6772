"""Benchmark decontamination with spaced seeds.

A seed is a mask over neighbouring tokens of which some places are ignored.  Hashes of all masked places of benchmark
items and of documents meet by equality; around each meeting the tokens are compared one by one on the same diagonal.
A document is contaminated by an item when `window` aligned tokens (all tokens of a shorter item) agree in at least
`similarity` of the places, so single replaced words do not hide a passage.

Items shorter than the window have masks of their own, made for their length and the words that may be replaced
(`short_masks`), which meet every such case; where no word may be replaced, the mask is the whole item.  Only the lengths
that the benchmark holds are looked for.

Tokens are runs of `[^\\x20\\x09-\\x0D]` with A-Z in lower case.  Defined results: null or empty texts meet nothing; rows without a key are left out; repeated keys give one row per key and item; an
empty table gives no rows.  Other columns of either table are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import is_small
from ..storage import materialise
from .url_rules import lower_ascii

#: Offsets that count.  Together they meet every window of 13 tokens with at most two replaced ones.
MASKS = ((0, 4, 5, 6, 7), (0, 2, 4, 7, 8))
WINDOW = 13
SIMILARITY = 0.8
MAX_SEED_ROWS = 500_000


def short_masks(size: int, similarity: float = SIMILARITY) -> list[tuple[int, ...]]:
    """Offsets from the start of an item of `size` tokens that meet it however many of its tokens may be replaced.

    With t replaced tokens, two of t + 2 blocks stay whole, so each pair of blocks is a mask.
    """
    t = size - ceil(size * similarity - 1e-9)
    if t == 0:
        return [tuple(range(size))]
    n = min(t + 2, size)
    cuts = [size * i // n for i in range(n + 1)]
    parts = [tuple(range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [tuple(x for part in chosen for x in part) for chosen in combinations(parts, n - t)]


def token_hashes(text: Column) -> Column:
    words = F.filter(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(tokens: Column, mask: tuple[int, ...]) -> Column:
    """The hash of the masked tokens at each place, in order."""
    last = F.size(tokens) - (max(mask) + 1)
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(tokens, i + o) for o in mask]))).otherwise(F.array().cast("array<bigint>"))


def _places(df: DataFrame, keep: list[str], masks, of_mask=lambda n, m: seeds(F.col("tokens"), m)) -> DataFrame:
    """One row (mask, at, seed) for each place of each mask."""
    per_mask = F.array(*[F.struct(F.lit(n).alias("mask"), of_mask(n, m).alias("seeds")) for n, m in enumerate(masks)])
    return (df.select(*keep, F.explode(per_mask).alias("m"))
            .select(*keep, "m.mask", F.posexplode("m.seeds").alias("at", "seed")))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text",
    masks=MASKS, window: int = WINDOW, similarity: float = SIMILARITY,
) -> DataFrame:
    """(key, item, matched, window, doc_start, item_start) of the best overlap of each contaminated pair.

    Starts count tokens from 0.  The seeds of the benchmark are broadcast while they have at most MAX_SEED_ROWS rows;
    beyond that both sides are shuffled on the seed.
    """
    items = benchmark.where(F.col(item).isNotNull()).select(
        F.col(item).alias("_item"), token_hashes(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    items = materialise(items.distinct(), "benchmark-tokens")
    short = sorted(r[0] for r in items.select(F.size("tokens")).where(F.size("tokens") < window).distinct().collect())
    own = [(size, m) for size in short for m in short_masks(size, similarity)]
    every = [*masks, *[m for _, m in own]]

    def item_seeds(n, mask):
        # long items are met at all places, a short one at its start by the masks of its length
        size = F.size("tokens")
        if n < len(masks):
            return F.when(size >= window, seeds(F.col("tokens"), mask)).otherwise(F.array().cast("array<bigint>"))
        return F.when(size == own[n - len(masks)][0], F.slice(seeds(F.col("tokens"), mask), 1, 1)).otherwise(
            F.array().cast("array<bigint>"))

    planted = materialise(_places(items, ["_item"], every, item_seeds).select(
        "mask", "seed", "_item", F.col("at").alias("item_at")).distinct(), "benchmark-seeds")
    if is_small(planted, MAX_SEED_ROWS):
        planted = F.broadcast(planted)
    tokens = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), token_hashes(F.col(text)).alias("tokens"))
    span = max(max(m) for m in masks) + 1
    reach = window - 1
    met = (_places(tokens, ["_key", "tokens"], every).join(planted, ["mask", "seed"])
           .select("_key", "_item", "at", "item_at",
                   # the tokens that any window around the seed can touch
                   F.slice("tokens", F.greatest(F.col("at") - reach, F.lit(0)) + 1, F.lit(2 * reach + span)).alias("near"))
           .dropDuplicates(["_key", "_item", "at", "item_at"]))
    aligned = met.join(items.withColumnRenamed("tokens", "item_tokens"), "_item")
    # `first` is the place in the document of near[0]; the item's place beside it is first + shift
    first, shift = F.greatest(F.col("at") - reach, F.lit(0)), F.col("item_at") - F.col("at")
    size = F.least(F.lit(window), F.size("item_tokens"))
    agree = F.transform("near", lambda t, i: F.when(
        (first + i + shift >= 0) & (first + i + shift < F.size("item_tokens")),
        (t == F.get("item_tokens", (first + i + shift).cast("int"))).cast("int")))
    scored = aligned.withColumns({"first": first, "shift": shift, "size": size, "agree": agree})
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("agree") - F.col("size"), F.lit(0))),
        lambda s: F.struct(F.aggregate(F.slice("agree", s + 1, F.col("size")), F.lit(0), lambda a, x: a + x).alias("matched"),
                           (-(F.col("first") + s)).alias("back"))))
    enough = F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9))
    found = (scored.withColumn("best", best)
             .where((F.size("agree") >= F.col("size")) & (F.col("best.matched") >= enough))
             .groupBy("_key", "_item")
             .agg(F.max(F.struct("best.matched", "best.back", "size", "shift")).alias("b")))
    start = -F.col("b.back")
    return found.select(
        F.col("_key").alias(key), F.col("_item").alias(item), F.col("b.matched").cast("long").alias("matched"),
        F.col("b.size").cast("long").alias("window"), start.cast("long").alias("doc_start"),
        (start + F.col("b.shift")).cast("long").alias("item_start"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The documents that no item contaminates, with all their columns; rows without a key stay."""
    bad = overlaps(docs, benchmark, key, **settings).select(key).distinct()
    return docs.join(bad, key, "left_anti")
