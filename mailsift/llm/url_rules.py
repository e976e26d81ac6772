"""URL filtering with given host rules and mined token rules.

Spark's FP-growth mines combinations of URL tokens that come with the label `block`.  Rules are pruned by support,
confidence and by shorter rules that are as sure; the rest match URLs through an inverted index from token to rule.

Defined results: a URL that is null or has no `://` has an empty host and path, no tokens and the verdict of its rule
(none fits) or else `allow`.  Repeated rows each get their row.  An empty table, no labelled URL or no mined rule gives
`allow` wherever no given rule fits.  Columns of the input other than the key and the URL are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import is_small
from ..storage import materialise

BLOCK = "label=block"
MAX_INDEX_ROWS = 100_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of the rules (host, path, verdict) that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains of it, if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host suffixes, path segments with their place, query names, fragment.

    Runs of digits count as one sign, so that numbered pages share their tokens.
    """
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(labels, lambda x, i: F.concat(
        F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    shape = F.transform(segments, lambda x, i: F.concat(
        F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "9")))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)),
                        lambda x: F.concat(F.lit("query="), F.regexp_replace(x, "[0-9]+", "9")))
    scheme = F.array(F.concat(F.lit("scheme="), lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    mark = F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(scheme, suffixes, shape, names, mark))
    return F.when(url.contains("://"), found).otherwise(F.array().cast("array<string>"))


def lower_bound(confidence: Column, rows: Column, z: float) -> Column:
    """The least share that a sample of `rows` with the share `confidence` is likely to come from (Wilson's interval)."""
    middle = confidence + z * z / (2 * rows)
    spread = z * F.sqrt(confidence * (1 - confidence) / rows + z * z / (4 * rows * rows))
    return (middle - spread) / (1 + z * z / rows)


def _parts(items: Column) -> Column:
    """All non-empty proper parts of a short array, in its order."""
    masks = F.sequence(F.lit(1), F.greatest(F.lit(1), F.pow(F.lit(2), F.size(items)).cast("int") - 2))
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1))


def mine(
    labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6, risk: float = 0.05, max_tokens: int = 4
) -> DataFrame:
    """Rules (rule_id, items, confidence, support) for blocking, from labelled URLs (url, blocked boolean).

    Supports are shares of all labelled URLs, so the number of rules does not grow with the input.  A rule must be surer than
    the share of blocked URLs is: the lower end of its confidence, at the given risk of one false rule among all that are
    tried, lies above that share.  So the rows that a rule needs follow from the data, whatever the size of the table.  A rule
    is dropped if a rule over some of its items is at least as sure.
    """
    spark = labelled.sparkSession
    baskets = labelled.where("blocked is not null").select(
        F.concat(tokens(F.coalesce("url", F.lit(""))),
                 F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = materialise(baskets, "url-baskets")
    n, blocked = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", BLOCK))).first()
    none = spark.createDataFrame([], "items array<string>, confidence double, support double, rule_id long")
    if not 0 < blocked < n:  # nothing to tell apart
        return none
    base = blocked / n
    # A rule that is always right needs at least so many rows to be told from the base, at the risk for a single rule.
    z = NormalDist().inv_cdf(1 - risk)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, z * z * base / (1 - base) / n),
                     minConfidence=min_confidence).fit(baskets)
    tried = materialise(
        model.associationRules
        .where((F.col("consequent") == F.array(F.lit(BLOCK))) & (F.size("antecedent") <= max_tokens))
        .select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "url-tried")
    # Every combination that could have been a rule was tried, however sure it turned out to be.
    m = model.freqItemsets.where((F.size("items") <= max_tokens) & ~F.array_contains("items", BLOCK)).count()
    if not m:
        return none
    rows = F.round(F.col("support") * n / F.col("confidence"))
    rules = tried.where(lower_bound(F.col("confidence"), rows, NormalDist().inv_cdf(1 - risk / m)) > base)
    # Each rule names its parts, so no item that many rules share is a key.
    named = rules.select("items", "confidence", F.explode(_parts(F.col("items"))).alias("part"))
    weaker = named.where(F.size("part") < F.size("items")).alias("a").join(
        rules.select(F.col("items").alias("part"), F.col("confidence").alias("other")), "part").where(
        "other >= confidence").select("items").distinct()
    kept = rules.join(weaker, "items", "left_anti")
    return kept.withColumn("rule_id", F.xxhash64(F.array_join("items", "\n")))


def match(urls: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, mined_rule, confidence) of the URLs that a mined rule blocks; the surest rule, ties by its items."""
    index = materialise(rules.select(
        F.explode("items").alias("token"), F.col("rule_id"), F.size("items").alias("size"),
        F.array_join("items", " & ").alias("mined_rule"), "confidence"), "url-index")
    if is_small(index, MAX_INDEX_ROWS):
        index = F.broadcast(index)
    exploded = urls.select(key, "url").distinct().select(key, "url", F.explode(tokens(F.col("url"))).alias("token"))
    hits = exploded.join(index, "token").groupBy(key, "url", "rule_id").agg(
        F.count("*").alias("n"), F.first("size").alias("size"), F.first("mined_rule").alias("mined_rule"),
        F.first("confidence").alias("confidence")).where("n = size")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "mined_rule"))
    return hits.groupBy(key, "url").agg(best.alias("b")).select(
        key, "url", "b.mined_rule", (-F.col("b.c")).alias("confidence"))


def judge(
    pages: DataFrame, given: Sequence[tuple[str, str, str]], mined: DataFrame, key: str = "page_id"
) -> DataFrame:
    """Every row's (key, url, host, path, rule, verdict, mined_rule, confidence)."""
    urls = pages.select(key, "url")
    ruled = urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    ruled = ruled.withColumn("given", given_rule(F.col("host"), F.col("path"), given))
    hits = match(urls.where(F.col("url").contains("://")), mined, key).withColumnsRenamed({key: "_key", "url": "_url"})
    return (ruled.join(hits, F.col(key).eqNullSafe(F.col("_key")) & (F.col("url") == F.col("_url")), "left")
            .select(key, "url", "host", "path", F.col("given.rule").alias("rule"),
                    F.when(F.col("given").isNotNull(), F.col("given.verdict"))
                    .when(F.col("mined_rule").isNotNull(), "block").otherwise("allow").alias("verdict"),
                    "mined_rule", "confidence"))
