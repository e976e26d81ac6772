"""Volume, sender, site, stage, network and percentile reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.operators import analytics, evaluate
from .common import ISSUES, MAIL_RAW, MAIL_SQL, SITES, mail, quoted, sql_view, table, tidy, view
from .mail_tables import site_sql

MONTHS = [f"{y}{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]

# The same reports over the order tables: companies are customers' nations, recipients are suppliers' nations.
ORDER_MAIL = """
SELECT CAST(o.o_orderkey AS STRING) AS no, trim(n.n_name) AS company_name,
       concat('buyer@', lower(n.n_name), '.example.com') AS senderemail,
       concat('desk@', lower(sn.n_name), '.example.org') AS recipientto,
       CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS STRING) AS month,
       o.o_orderpriority AS stage, r.r_name AS site
FROM {lineitem} l
JOIN {orders} o ON o.o_orderkey = l.l_orderkey
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey
JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
JOIN {nation} sn ON sn.n_nationkey = s.s_nationkey
"""


def _order_mail(spark, sf_dir):
    return view(spark, sf_dir, ORDER_MAIL)


def facet_options(spark, sf_dir):
    return analytics.facets(mail(spark, sf_dir), ("month", "stage", "site"))


def facet_months(spark, sf_dir):
    return analytics.distinct_values(mail(spark, sf_dir), "month")


def monthly_volume(spark, sf_dir):
    return analytics.monthly_volume(mail(spark, sf_dir))


def top_senders(spark, sf_dir):
    return analytics.top_senders(mail(spark, sf_dir))


def site_distribution(spark, sf_dir):
    return analytics.site_distribution(mail(spark, sf_dir), SITES, C.TOP_SHARES)


def stage_distribution(spark, sf_dir):
    return analytics.stage_distribution(mail(spark, sf_dir), C.TOP_SHARES)


def month_site_counts(spark, sf_dir):
    return analytics.month_site_counts(mail(spark, sf_dir), SITES)


def month_site_pivot(spark, sf_dir):
    return analytics.month_site_pivot(mail(spark, sf_dir), MONTHS, SITES)


def volume_kpis(spark, sf_dir):
    return analytics.volume_kpis(mail(spark, sf_dir))


def network_edges(spark, sf_dir):
    return analytics.network_edges(mail(spark, sf_dir))


def network_listed(spark, sf_dir):
    return analytics.listed_edges(analytics.network_edges(mail(spark, sf_dir)))


def network_degree(spark, sf_dir):
    return analytics.node_degrees(analytics.network_edges(mail(spark, sf_dir)))


def analytics_export(spark, sf_dir):
    return analytics.analytics_export(mail(spark, sf_dir), SITES)


def issue_counts(spark, sf_dir):
    return analytics.issue_counts(mail(spark, sf_dir), ISSUES)


def order_network(spark, sf_dir):
    return analytics.network_edges(_order_mail(spark, sf_dir))


def order_volume(spark, sf_dir):
    return analytics.monthly_volume(_order_mail(spark, sf_dir))


def order_month_site(spark, sf_dir):
    return analytics.month_site_counts(_order_mail(spark, sf_dir), {})


def p95_by_type(spark, sf_dir):
    return tidy(evaluate.percentiles(table(spark, sf_dir, "events"), "event_type", "value"))


def issue_sql():
    text = "lower(concat(coalesce(subject, ''), ' ', coalesce(hvdc_cases, '')))"
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in ISSUES.items())
    return f"CASE {whens} ELSE '{C.ISSUE_OTHER}' END"


MONTH_SQL = f"SELECT month, count(*) AS email_count FROM mail WHERE trim(month) <> '' GROUP BY month"
SENDER_SQL = """SELECT coalesce(nullif(trim(company_name), ''), nullif(trim(split_part(senderemail, '@', 2)), ''),
    'Unclassified') AS sender_group, count(*) AS email_count FROM mail
    WHERE senderemail IS NOT NULL OR company_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
SITES_SQL = f"(SELECT month, coalesce({site_sql('primary_site')}, {site_sql('sites')}, {site_sql('site')}) AS site FROM mail)"
SITE_SQL = f"SELECT site, count(*) AS email_count FROM {SITES_SQL} WHERE site IS NOT NULL GROUP BY site"
STAGE_SQL = ("SELECT coalesce(nullif(trim(stage), ''), 'Unclassified') AS stage, count(*) AS email_count FROM mail "
             "GROUP BY 1")
EDGES_SQL = """SELECT company_name AS source,
    coalesce(nullif(split_part(split_part(recipientto, '@', 2), '.', 1), ''), 'Unknown') AS target, count(*) AS weight
    FROM mail WHERE company_name IS NOT NULL AND recipientto IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5
    ORDER BY weight DESC, source, target LIMIT 150"""
WITH = f"WITH {MAIL_SQL}"
WITH_ORDERS = f"WITH mail AS ({sql_view(ORDER_MAIL)})"

ENTRIES = {
    "facet_options": (facet_options, f"{WITH} " + " UNION ".join(
        f"SELECT '{c}' AS facet, {c} AS value FROM mail WHERE {c} IS NOT NULL" for c in ("month", "stage", "site"))),
    "facet_months": (facet_months, f"{WITH} SELECT DISTINCT month FROM mail ORDER BY month"),
    "monthly_volume": (monthly_volume, f"{WITH} {MONTH_SQL}"),
    "top_senders": (top_senders, f"{WITH} {SENDER_SQL}"),
    "site_distribution": (site_distribution, f"{WITH} {SITE_SQL} ORDER BY 2 DESC, 1 LIMIT 12"),
    "stage_distribution": (stage_distribution, f"{WITH} {STAGE_SQL} ORDER BY 2 DESC, 1 LIMIT 12"),
    "month_site_counts": (month_site_counts, f"""{WITH} SELECT month, site, count(*) AS email_count FROM {SITES_SQL}
        WHERE trim(month) <> '' AND site IS NOT NULL GROUP BY month, site"""),
    "month_site_pivot": (month_site_pivot, f"{WITH} SELECT site, " + ", ".join(
        f"count(*) FILTER (month = '{m}') AS \"{m}\"" for m in MONTHS)
        + f" FROM {SITES_SQL} WHERE site IS NOT NULL AND trim(month) <> '' GROUP BY site"),
    "volume_kpis": (volume_kpis, f"""{WITH}, v AS ({MONTH_SQL}) SELECT CAST(sum(email_count) AS BIGINT) AS total_volume,
        (SELECT month FROM v ORDER BY email_count DESC, month LIMIT 1) AS peak_month, max(email_count) AS peak_count
        FROM v"""),
    "network_edges": (network_edges, f"{WITH} {EDGES_SQL}"),
    "network_listed": (network_listed, f"""{WITH}, edges AS ({EDGES_SQL}) SELECT *, source || ' to ' || target AS link
        FROM edges ORDER BY weight DESC, source, target LIMIT 30"""),
    "network_degree": (network_degree, f"""{WITH}, edges AS ({EDGES_SQL}) SELECT node, count(*) AS degree FROM
        (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node"""),
    "analytics_export": (analytics_export, f"""{WITH}, top AS ({SENDER_SQL})
        SELECT 'monthly_volume' AS metric, month AS dimension, email_count AS count FROM ({MONTH_SQL})
        UNION ALL SELECT 'top_sender', sender_group, email_count FROM top
        UNION ALL SELECT 'site_distribution', site, email_count FROM ({SITE_SQL})
        UNION ALL SELECT 'stage_distribution', stage, email_count FROM ({STAGE_SQL})"""),
    "issue_counts": (issue_counts, f"{WITH} SELECT {issue_sql()} AS issue_type, count(*) AS email_count FROM mail "
                                   "GROUP BY 1"),
    "order_network": (order_network, f"{WITH_ORDERS} {EDGES_SQL}"),
    "order_volume": (order_volume, f"{WITH_ORDERS} {MONTH_SQL}"),
    "order_month_site": (order_month_site, f"""{WITH_ORDERS} SELECT month, site, count(*) AS email_count FROM mail
        GROUP BY month, site"""),
    "p95_by_type": (p95_by_type, """SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n
        FROM events GROUP BY event_type"""),
}
