"""Volume, sender, site, stage and network reports.  Each is one partial and one final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.clean import first_site, strip
from ..functions.entities import issue_label


def _filled(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def distinct_values(mail: DataFrame, column: str) -> DataFrame:
    """The sorted choices of a facet."""
    return mail.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def facets(mail: DataFrame, columns=("month", "stage")) -> DataFrame:
    """(facet, value) of all facet columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    return (mail.select(F.explode(pairs).alias("pair")).select("pair.facet", "pair.value")
            .where(F.col("value").isNotNull()).distinct())


def monthly_volume(mail: DataFrame) -> DataFrame:
    return (mail.where(_filled(F.col("month")).isNotNull())
            .groupBy("month").agg(F.count("*").alias("email_count")).orderBy("month"))


def sender_group() -> Column:
    """The company, else the mail domain, else `Unclassified`."""
    domain = _filled(F.split_part("senderemail", F.lit("@"), F.lit(2)))
    return F.coalesce(_filled(F.col("company_name")), domain, F.lit(C.UNCLASSIFIED))


def top_senders(mail: DataFrame, n: int = C.TOP_SENDERS) -> DataFrame:
    known = F.col("senderemail").isNotNull() | F.col("company_name").isNotNull()
    return (mail.where(known).groupBy(sender_group().alias("sender_group"))
            .agg(F.count("*").alias("email_count"))
            .orderBy(F.desc("email_count"), "sender_group").limit(n))


def site_of(mail: DataFrame, sites=C.SITES) -> Column:
    return first_site([F.col(c) for c in C.SITE_COLUMNS if c in mail.columns], sites)


def site_distribution(mail: DataFrame, sites=C.SITES, top: int | None = None) -> DataFrame:
    counts = (mail.select(site_of(mail, sites).alias("site")).where(F.col("site").isNotNull())
              .groupBy("site").agg(F.count("*").alias("email_count"))
              .orderBy(F.desc("email_count"), "site"))
    return counts.limit(top) if top else counts


def stage_distribution(mail: DataFrame, top: int | None = None) -> DataFrame:
    stage = F.coalesce(_filled(F.col("stage")), F.lit(C.UNCLASSIFIED))
    counts = (mail.groupBy(stage.alias("stage")).agg(F.count("*").alias("email_count"))
              .orderBy(F.desc("email_count"), "stage"))
    return counts.limit(top) if top else counts


def month_site_counts(mail: DataFrame, sites=C.SITES) -> DataFrame:
    return (mail.where(_filled(F.col("month")).isNotNull())
            .select("month", site_of(mail, sites).alias("site")).where(F.col("site").isNotNull())
            .groupBy("month", "site").agg(F.count("*").alias("email_count")))


def month_site_pivot(mail: DataFrame, months: list[str], sites=C.SITES) -> DataFrame:
    """One row per site and one column per given month, 0 where there is no mail."""
    counts = month_site_counts(mail, sites)
    return counts.groupBy("site").pivot("month", months).agg(F.sum("email_count")).na.fill(0)


def volume_kpis(mail: DataFrame) -> DataFrame:
    """All mails with a month, the month with most of them (the first one of equals), and its count."""
    months = mail.where(_filled(F.col("month")).isNotNull()).groupBy("month").agg(F.count("*").alias("n"))
    first_peak = F.min_by(F.struct("month", "n"), F.struct((-F.col("n")).alias("n"), F.col("month")))
    return months.agg(F.sum("n").alias("total_volume"), first_peak.alias("peak")).select(
        "total_volume", F.col("peak.month").alias("peak_month"), F.col("peak.n").alias("peak_count"))


def network_edges(mail: DataFrame, min_weight: int = C.MIN_EDGE_WEIGHT, top: int = C.MAX_EDGES) -> DataFrame:
    """Heaviest (sender company, recipient domain) pairs."""
    label = F.split_part(F.split_part("recipientto", F.lit("@"), F.lit(2)), F.lit("."), F.lit(1))
    known = F.col("company_name").isNotNull() & F.col("recipientto").isNotNull()
    return (mail.where(known)
            .groupBy(F.col("company_name").alias("source"),
                     F.coalesce(F.nullif(label, F.lit("")), F.lit(C.UNKNOWN_TARGET)).alias("target"))
            .agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)
            .orderBy(F.desc("weight"), "source", "target").limit(top))


def listed_edges(edges: DataFrame, top: int = C.LISTED_EDGES) -> DataFrame:
    return (edges.orderBy(F.desc("weight"), "source", "target").limit(top)
            .withColumn("link", F.concat("source", F.lit(" to "), "target")))


def node_degrees(edges: DataFrame) -> DataFrame:
    """Edges per node, in and out; an edge from a node to itself counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def analytics_export(mail: DataFrame, sites=C.SITES) -> DataFrame:
    """The four reports in one table (metric, dimension, count)."""
    reports = {
        "monthly_volume": monthly_volume(mail), "top_sender": top_senders(mail),
        "site_distribution": site_distribution(mail, sites), "stage_distribution": stage_distribution(mail),
    }
    parts = [df.select(F.lit(metric).alias("metric"), F.col(df.columns[0]).alias("dimension"),
                       F.col("email_count").alias("count")) for metric, df in reports.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def issue_counts(mail: DataFrame, keywords=C.ISSUE_KEYWORDS, other: str = C.ISSUE_OTHER) -> DataFrame:
    cases = F.col(C.CASES) if C.CASES in mail.columns else F.lit(None)
    return (mail.groupBy(issue_label(F.col("subject"), cases, keywords, other).alias("issue_type"))
            .agg(F.count("*").alias("email_count")))
