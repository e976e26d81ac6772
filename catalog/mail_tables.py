"""Ingest, normalisation, filters, joins and incremental loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions import clean
from mailsift.operators import attachments, filters, incremental, ranking, saved_specs, threads
from mailsift.sources import manifest, tables
from mailsift.streaming import ingest
from mailsift.storage import materialise, new_path
from .common import (MAIL_COLUMNS, MAIL_RAW, MAIL_SQL, NEWEST_SQL, SITES, TIME_SQL,
                     fresh_mail, mail, mail_raw, quoted, sql_view, strip_sql, table, tidy, top_sql, view)

ALL = ", ".join(MAIL_COLUMNS)


def ingest_mail(spark, sf_dir):
    return fresh_mail(spark, sf_dir)


# Events without a user and a type stand for blank rows of an export.
BLANK_ROWS = """
SELECT CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id AS STRING) END AS a,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS b,
       CASE WHEN event_type = 'error' AND value < 50 THEN NULL ELSE CAST(user_id AS STRING) END AS c
FROM {events}
"""


def ingest_drop_blank(spark, sf_dir):
    return tables.drop_blank_rows(view(spark, sf_dir, BLANK_ROWS))


# Deliveries overlap: labels name documents that the table already holds, events bring others, some of them twice.
INCOMING = """
SELECT CASE WHEN event_id % 50 = 7 THEN NULL ELSE CAST(event_id % 7000 AS STRING) END AS no,
       CAST(event_id AS STRING) AS delivery, event_type AS stage
FROM {events}
"""


def incremental_new_rows(spark, sf_dir):
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("no"))
    return incremental.new_rows(view(spark, sf_dir, INCOMING), held, "no", F.col("delivery").cast("bigint"))


def update_from_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("quality"))
    staged = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    return incremental.update_column(docs, staged, "doc_id", "quality")


def load_profile(spark, sf_dir):
    return tidy(tables.load_profile(fresh_mail(spark, sf_dir), ["no", "site", "stage", "company_name", "deliverytime"]))


def bulk_append(spark, sf_dir):
    """Append the mail table by month, then count what a reader finds."""
    path = new_path(spark, "mail")
    tables.append_mail(fresh_mail(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"))


def csv_export(spark, sf_dir):
    """Write results as CSV and read them back."""
    path = new_path(spark, "export")
    tables.write_csv(fresh_mail(spark, sf_dir).select("no", "deliverytime", "company_name", "month"), path)
    return spark.read.csv(path, header=True, schema="no string, deliverytime string, company_name string, month string",
                          escape='"')


def export_round_trip(spark, sf_dir):
    """An export file with title rows and a header, read as text columns."""
    path = new_path(spark, "sheet")
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(
        ",", F.col("c_custkey").cast("string"), "c_name", F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")))
        .alias("value"))
    spark.createDataFrame([("Customers,,",), ("all regions,,",), ('"",,',), ("Cust No.,Cust Name,Nation/Key",)],
                          "value string").coalesce(1).write.text(f"{path}/head")
    rows.write.text(f"{path}/rows")
    return tables.read_export(spark, [f"{path}/head", f"{path}/rows"], header_path=f"{path}/head")


def export_text_cells(spark, sf_dir):
    """Whole texts with line breaks as cells, and a row of data that equals the header."""
    path = new_path(spark, "sheet")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "lang", "text")
    names = spark.createDataFrame([("Doc ID", "Lang", "Text")], "doc_id string, lang string, text string")
    spark.createDataFrame([("Documents,,",), ("all sources,,",), (",,",), ("Doc ID,Lang,Text",)],
                          "value string").coalesce(1).write.text(f"{path}/head")
    tables.write_csv(docs.unionByName(names), f"{path}/rows", header=False)
    read = tables.read_export(spark, [f"{path}/head", f"{path}/rows"], header_path=f"{path}/head")
    return read.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def manifest_check(spark, sf_dir):
    """The table files against a manifest with a wrong checksum and a missing file."""
    files = manifest.delivered_files(spark, sf_dir)
    wanted = files.select("name", F.when(F.col("name") == "labels.parquet", "0").otherwise(F.col("sha256"))
                          .alias("sha256"), F.lit(0).cast("long").alias("max_bytes"))
    extra = spark.createDataFrame([("gone.parquet", "0", 0)], "name string, sha256 string, max_bytes long")
    return manifest.violations(files, wanted.unionByName(extra))


def _loaded_stream(spark, sf_dir, append):
    """All events as a stream: newest files first, many batches, repeats across batches, unreadable times."""
    landing = new_path(spark, "landing")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("no"),
        F.when(F.col("event_id") % 17 == 0, "unknown").otherwise(F.col("ts").cast("string")).alias("ts"), "event_type")
    (events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
     .repartitionByRange(6, F.xxhash64("event_type", "no", F.rand(1))).write.parquet(landing))
    stream = ingest.read_landing(spark, landing, spark.read.parquet(landing).schema, files_per_batch=2)
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    append(stream, out, checkpoint, "no", "ts").awaitTermination()
    return spark.read.parquet(out).select("no", "event_type", F.col("ts").isNotNull().alias("timed"))


def stream_ingest_dedupe(spark, sf_dir):
    return _loaded_stream(spark, sf_dir, ingest.append_new)


def stream_ingest_state(spark, sf_dir):
    return _loaded_stream(spark, sf_dir, ingest.append_by_state)


# --- filters -------------------------------------------------------------------------------------------------

def project_optional(spark, sf_dir):
    return tables.select_present(mail(spark, sf_dir))


def norm_ids(spark, sf_dir):
    raw = mail_raw(spark, sf_dir)
    return raw.select(clean.id_value(F.col("no")).alias("no"), clean.id_value(F.col("month")).alias("month"),
                      clean.id_key(F.col("no")).alias("no_key"))


def id_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".0")).alias("no"))
    return threads.lookup_ids(mail(spark, sf_dir), wanted).select("no", "subject", "sendername")


def format_month(spark, sf_dir):
    raw = mail_raw(spark, sf_dir)
    return raw.select(clean.id_key(F.col("no")).alias("no"), clean.month_label(F.col("month")).alias("month"))


def site_canonical(spark, sf_dir):
    raw = mail_raw(spark, sf_dir)
    return raw.select(
        clean.id_key(F.col("no")).alias("no"), clean.site_code(F.col("site"), SITES).alias("code"),
        clean.site_value(F.col("sites"), SITES).alias("shown"))


def site_first(spark, sf_dir):
    raw = mail_raw(spark, sf_dir)
    return raw.select(clean.id_key(F.col("no")).alias("no"),
                      clean.first_site([F.col(c) for c in C.SITE_COLUMNS], SITES).alias("site"))


def filter_site(spark, sf_dir):
    m = mail(spark, sf_dir)
    return m.where(filters.at_sites(m, ["DE (GERMAN)", "fr"], SITES)).select("no", "site", "sites", "primary_site")


def filter_facets(spark, sf_dir):
    m = mail(spark, sf_dir)
    return filters.search_filter(m, months=["199501", "199602", "200107"], stages=["click", "view"]).select(
        "no", "month", "stage")


def filter_substring(spark, sf_dir):
    return filters.search_filter(mail(spark, sf_dir), sender="@SRC1", case="case-00").select("no", "senderemail", C.CASES)


def format_result(spark, sf_dir):
    raw = mail_raw(spark, sf_dir).select("no", "month", "deliverytime", "site", "sites", "primary_site")
    shown = {name: c for name, c in clean.mail_display_columns(raw.columns).items() if name == "deliverytime"}
    return raw.withColumns(shown).select(
        clean.id_value(F.col("no")).alias("no"), clean.id_value(F.col("month")).alias("month"), "deliverytime",
        F.coalesce(clean.site_value(F.col("site"), SITES), F.lit("")).alias("site"))


def refine_results(spark, sf_dir):
    return filters.refine(mail(spark, sf_dir), r"user1\d|CASE-00[0-2]").select("no", "sendername", C.CASES)


SPECS = {
    "compare": {"filters": [{"field": "month", "op": "gte", "value": "199806"},
                            {"field": "stage", "op": "neq", "value": "error"},
                            {"field": "deliverytime", "op": "lt", "value": "2000-01-01"},
                            {"field": "company_name", "op": "gt", "value": "src11"},
                            {"field": "site", "op": "lte", "value": "fr"}]},
    "ilike": {"filters": [{"field": "sendername", "op": "ilike", "value": "USER1"},
                          {"field": "subject", "op": "not_ilike", "value": "the"}]},
    "in_between": {"filters": [{"field": "stage", "op": "in", "value": ["click", "purchase", "view"]},
                               {"field": "month", "op": "between", "value": ["199601", "199712"]}]},
    "or": {"logic": "or", "filters": [{"field": "hvdc_cases", "op": "eq", "value": "CASE-0007"},
                                      {"field": "senderemail", "op": "ilike", "value": "src3.example"},
                                      {"field": "site", "op": "in", "value": ["EN", "de"]}]},
    "like_signs": {"filters": [{"field": "subject", "op": "ilike", "value": "100%_"}]},
}
SPEC_SQL = {
    "compare": "month >= '199806' AND stage <> 'error' AND deliverytime < '2000-01-01' AND company_name > 'src11' "
               "AND site <= 'fr'",
    "ilike": "sendername ILIKE '%user1%' AND subject NOT ILIKE '%the%'",
    "in_between": "stage IN ('click', 'purchase', 'view') AND month BETWEEN '199601' AND '199712'",
    "or": "hvdc_cases = 'CASE-0007' OR senderemail ILIKE '%src3.example%' OR site IN ('EN', 'de')",
    "like_signs": "contains(lower(subject), '100%_')",
}


def _by_spec(name):
    def run(spark, sf_dir):
        return filters.apply_filter(mail(spark, sf_dir), SPECS[name]).select("no", "month", "stage", "sendername")
    return run


def dsl_search(spark, sf_dir):
    return filters.filtered_search(mail(spark, sf_dir), SPECS["or"])


def saved_search_match(spark, sf_dir):
    return filters.match_saved(mail(spark, sf_dir), SPECS)


def saved_search_index(spark, sf_dir):
    """Three saved specifications for each mail that is labelled as toxic, as a table, and those of `saved_search_match`."""
    mails = mail(spark, sf_dir)
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(
        F.col("doc_id").cast("string").alias("no")).distinct()
    seeds = mails.join(labelled, "no", "left_semi")

    def condition(field, op, *values):
        held = F.array(*values) if op == "between" else values[0]
        return F.to_json(F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), held.alias("value")))

    def saved(name, logic, *conditions):
        asked = F.format_string('{"logic": "%s", "filters": [%s]}', F.lit(logic), F.concat_ws(", ", *conditions))
        return F.struct(F.concat(F.lit(f"{name}-"), "no").alias("spec"), asked.alias("definition"))

    sender, time, month = F.col("senderemail"), F.col("deliverytime"), F.col("month")
    made = seeds.where(sender.isNotNull() & time.isNotNull() & month.isNotNull()).select(F.explode(F.array(
        saved("later", "and", condition("deliverytime", "gt", time), condition("senderemail", "eq", sender)),
        saved("month", "and", condition("month", "between", month, month), condition("stage", "neq", F.lit("error"))),
        saved("either", "or", condition("deliverytime", "eq", time), condition("senderemail", "ilike", F.upper(sender))),
    )).alias("s")).select("s.*")
    return saved_specs.match_table(mails, made.unionByName(saved_specs.spec_rows(spark, SPECS)))


# --- joins and orders ----------------------------------------------------------------------------------------

def fetch_bodies(spark, sf_dir):
    hits = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("no"))
    return threads.fetch_columns(hits, mail(spark, sf_dir), ["subject", "plaintextbody"])


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("no"))


def case_thread(spark, sf_dir):
    return threads.case_thread(mail(spark, sf_dir), _seeds(spark, sf_dir))


def case_places(spark, sf_dir):
    return tidy(threads.case_threads(mail(spark, sf_dir)).select("primary_case", "no", "place"))


def turn_order(spark, sf_dir):
    """Turns of every conversation, oldest first, as one thread each."""
    turns = table(spark, sf_dir, "conversations")
    placed = ranking.position_in_group(turns, ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / 16), "place")
    return tidy(placed.select("conv_id", "turn", "role", "place"))


def sender_history(spark, sf_dir):
    return tidy(threads.sender_history(mail(spark, sf_dir), _seeds(spark, sf_dir)).select("seed", "no", "position"))


def newest_first(spark, sf_dir):
    rows = ranking.top_k(mail(spark, sf_dir), ["stage"], [*ranking.newest_first(), F.col("no")], 100, rank="position")
    return tidy(rows.select("stage", "no", "deliverytime", "position"))


def oldest_first(spark, sf_dir):
    rows = ranking.top_k(mail(spark, sf_dir), ["stage"], [*ranking.oldest_first(), F.col("no")], 100, rank="position")
    return tidy(rows.select("stage", "no", "deliverytime", "position"))


def dedupe_keep_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))
    return ranking.keep_first(events, ["user_id", "event_type"], F.col("event_id"))


# --- attachments ---------------------------------------------------------------------------------------------

def _listing(spark, sf_dir):
    """Every page as a listing: its links are files whose titles start with the link key of one mail."""
    pages = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    key = F.substring(F.md5(F.col("page_id").cast("string")), 1, 12)
    return pages.select(key.alias("key"), F.posexplode_outer(hrefs).alias("pos", "href")).select(
        F.md5(F.concat_ws("|", "key", "href")).alias("id"),
        F.when(F.col("pos") == 0, F.concat("key", F.lit(".pdf")))
        .when(F.col("pos") == 5, F.concat(F.lit("x"), "key", F.lit("_lost.pdf")))
        .otherwise(F.concat("key", F.lit("_"), "href", F.lit(".pdf"))).alias("title"))


def _overrides(spark, sf_dir):
    """Hand-made entries: new titles for known files, and files of their own."""
    files = attachments.keyed_files(_listing(spark, sf_dir))
    renamed = files.where(F.col("title").endswith(".pdf") & F.col("id").startswith("a")).select(
        "linkkey", "id", F.concat("linkkey", F.lit("_00_renamed.pdf")).alias("title"))
    own = table(spark, sf_dir, "labels").where("toxic = 1").select(
        F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12).alias("linkkey"),
        F.concat(F.lit("own"), F.col("doc_id").cast("string")).alias("id"), F.lit("own file").alias("title"))
    return renamed.unionByName(own)


def _links(spark, sf_dir):
    files = attachments.apply_overrides(attachments.keyed_files(_listing(spark, sf_dir)), _overrides(spark, sf_dir))
    return materialise(attachments.with_links(attachments.link_map(files)), "links")


def link_map_build(spark, sf_dir):
    return tidy(attachments.link_map(attachments.keyed_files(_listing(spark, sf_dir))))


def link_map_override(spark, sf_dir):
    return attachments.apply_overrides(attachments.keyed_files(_listing(spark, sf_dir)), _overrides(spark, sf_dir))


def link_attach(spark, sf_dir):
    attached = attachments.attach(mail(spark, sf_dir), _links(spark, sf_dir))
    return tidy(attached.select("no", "linkkey", "id", "position", "label"))


def link_parts(spark, sf_dir):
    return tidy(_links(spark, sf_dir).select("linkkey", "position", "label", "view_url", "download_url"))


def link_first(spark, sf_dir):
    return attachments.first_link(mail(spark, sf_dir), _links(spark, sf_dir))


# Texts that mention keys and file links, next to keys that do not resolve.
MENTIONS = """
SELECT page_id AS doc,
       CASE page_id % 4 WHEN 0 THEN substring(md5(CAST(page_id AS STRING)), 1, 12)
                        WHEN 1 THEN concat('see 00112233aabb and ', substring(md5(CAST(page_id AS STRING)), 1, 12), '.')
                        WHEN 2 THEN 'None' ELSE url END AS first_text,
       concat(url, ' https://drive.google.com/file/d/', md5(url), '/view and ?id=', md5(html), ' again &id=', md5(url))
           AS second_text
FROM {pages}
"""


def link_extract(spark, sf_dir):
    files = materialise(attachments.link_map(attachments.keyed_files(_listing(spark, sf_dir))), "links")
    texts = view(spark, sf_dir, MENTIONS)
    return tidy(attachments.resolve_links(texts, "doc", ["first_text", "second_text"], files))


# --- SQL -----------------------------------------------------------------------------------------------------

def code_sql(c):
    pairs = " ".join(f"WHEN lower({strip_sql(c)}) = '{a.lower()}' THEN '{code}'"
                     for code, (_, aliases) in SITES.items() for a in aliases)
    return f"CASE {pairs} END"


def site_sql(c):
    s = strip_sql(c)
    return (f"coalesce({code_sql(c)}, CASE WHEN lower({s}) IN ({quoted(['', *C.SITE_BLANKS])}) THEN NULL ELSE {s} END)")


ID_SQL = rf"regexp_replace({strip_sql('no')}, '\.0+$', '')"
RAW_SQL = f"mail_raw AS ({sql_view(MAIL_RAW)})"
FILES_SQL = r"""
hrefs AS (SELECT substring(md5(CAST(page_id AS VARCHAR)), 1, 12) AS key,
                 regexp_extract_all(html, 'href="/([^"]*)"', 1) AS found FROM pages),
listed AS (SELECT key, unnest(found) AS href, unnest(range(len(found))) AS pos FROM hrefs),
listing AS (SELECT md5(key || '|' || href) AS id,
                   CASE WHEN pos = 0 THEN key || '.pdf' WHEN pos = 5 THEN 'x' || key || '_lost.pdf'
                        ELSE key || '_' || href || '.pdf' END AS title FROM listed),
files AS (SELECT left(title, 12) AS linkkey, id, min(title) AS title FROM listing
          WHERE regexp_matches(title, '^[0-9a-f]{12}(_|\.pdf$)') GROUP BY 1, 2)"""
OVERRIDES_SQL = """
overrides AS (SELECT linkkey, id, linkkey || '_00_renamed.pdf' AS title FROM files WHERE id LIKE 'a%' AND title LIKE '%.pdf'
              UNION ALL SELECT substring(md5(CAST(doc_id AS VARCHAR)), 1, 12), 'own' || doc_id, 'own file'
              FROM labels WHERE toxic = 1),
merged AS (SELECT linkkey, id, coalesce(o.title, f.title) AS title FROM files f FULL JOIN overrides o USING (linkkey, id))"""


def placed_sql(source):
    return (f"SELECT linkkey, id, title, row_number() OVER (PARTITION BY linkkey ORDER BY title, id) AS position, "
            f"count(*) OVER (PARTITION BY linkkey) AS files FROM {source}")


LINKS_SQL = f"""{FILES_SQL}, {OVERRIDES_SQL}, placed AS ({placed_sql('merged')}),
links AS (SELECT *, CASE WHEN files > 1 THEN 'PDF part ' || position ELSE 'PDF' END AS label,
    'https://drive.google.com/file/d/' || id || '/view?usp=sharing' AS view_url,
    'https://drive.google.com/uc?export=download&id=' || id AS download_url FROM placed)"""

ENTRIES = {
    "ingest_mail": (ingest_mail, f"WITH {MAIL_SQL} SELECT {ALL} FROM mail"),
    "ingest_drop_blank": (ingest_drop_blank, f"SELECT * FROM ({sql_view(BLANK_ROWS)}) WHERE a IS NOT NULL OR "
                                             "b IS NOT NULL OR c IS NOT NULL"),
    "export_round_trip": (export_round_trip, "SELECT CAST(c_custkey AS VARCHAR) AS cust_no, c_name AS cust_name, "
                                             "c_nationkey || '.0' AS nation_key FROM customer"),
    "export_text_cells": (export_text_cells, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(text) AS text_md5 "
                                             "FROM documents UNION ALL SELECT 'Doc ID', 'Lang', md5('Text')"),
    "incremental_new_rows": (incremental_new_rows, f"""SELECT no, CAST(min(CAST(delivery AS BIGINT)) AS VARCHAR) AS
        delivery, arg_min(stage, CAST(delivery AS BIGINT)) AS stage FROM ({sql_view(INCOMING)})
        WHERE no NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) GROUP BY no"""),
    "update_from_join": (update_from_join, """SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars) AS quality
        FROM documents d LEFT JOIN labels l USING (doc_id)"""),
    "load_profile": (load_profile, f"""WITH {MAIL_SQL} SELECT count(*) AS rows, count(no) AS filled_no, count(site) AS
        filled_site, count(stage) AS filled_stage, count(company_name) AS filled_company_name, count(deliverytime) AS
        filled_deliverytime FROM mail"""),
    "bulk_append": (bulk_append, f"WITH {MAIL_SQL} SELECT month, count(*) AS n FROM mail GROUP BY month"),
    "csv_export": (csv_export, f"WITH {MAIL_SQL} SELECT no, deliverytime, company_name, month FROM mail"),
    "manifest_check": (manifest_check, None),
    "stream_ingest_dedupe": (stream_ingest_dedupe,
                             "SELECT CAST(event_id AS VARCHAR) AS no, event_type, event_id % 17 <> 0 AS timed FROM events"),
    "stream_ingest_state": (stream_ingest_state,
                            "SELECT CAST(event_id AS VARCHAR) AS no, event_type, event_id % 17 <> 0 AS timed FROM events"),
    "project_optional": (project_optional, f"WITH {MAIL_SQL} SELECT {', '.join(C.RESULT_COLUMNS)}, lpo_numbers, rowkey "
                                           "FROM mail"),
    "norm_ids": (norm_ids, rf"""WITH {RAW_SQL} SELECT regexp_replace(no, '\.0$', '') AS no,
        regexp_replace(month, '\.0$', '') AS month, {ID_SQL} AS no_key FROM mail_raw"""),
    "id_lookup": (id_lookup, f"""WITH {MAIL_SQL} SELECT no, subject, sendername FROM mail
        WHERE no IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""),
    "format_month": (format_month, rf"""WITH {RAW_SQL} SELECT {ID_SQL} AS no,
        left(month, 4) || '-' || substring(month, 5, 2) AS month FROM mail_raw"""),
    "site_canonical": (site_canonical, f"""WITH {RAW_SQL} SELECT {ID_SQL} AS no, {code_sql('site')} AS code,
        {site_sql('sites')} AS shown FROM mail_raw"""),
    "site_first": (site_first, f"""WITH {RAW_SQL} SELECT {ID_SQL} AS no,
        coalesce({site_sql('primary_site')}, {site_sql('sites')}, {site_sql('site')}) AS site FROM mail_raw"""),
    "filter_site": (filter_site, f"""WITH {MAIL_SQL} SELECT no, site, sites, primary_site FROM mail
        WHERE lower(trim(site)) IN ('de', 'german', 'fr', 'french') OR lower(trim(sites)) IN
        ('de', 'german', 'fr', 'french') OR lower(trim(primary_site)) IN ('de', 'german', 'fr', 'french')"""),
    "filter_facets": (filter_facets, f"""WITH {MAIL_SQL} SELECT no, month, stage FROM mail
        WHERE month IN ('199501', '199602', '200107') AND stage IN ('click', 'view')"""),
    "filter_substring": (filter_substring, f"""WITH {MAIL_SQL} SELECT no, senderemail, hvdc_cases FROM mail
        WHERE senderemail ILIKE '%@src1%' AND hvdc_cases ILIKE '%case-00%'"""),
    "format_result": (format_result, rf"""WITH {RAW_SQL} SELECT regexp_replace(no, '\.0$', '') AS no,
        regexp_replace(month, '\.0$', '') AS month, coalesce(strftime({TIME_SQL}, '%Y-%m-%d %H:%M:%S'), deliverytime, '')
        AS deliverytime, coalesce({site_sql('site')}, '') AS site FROM mail_raw"""),
    "refine_results": (refine_results, rf"""WITH {MAIL_SQL} SELECT no, sendername, hvdc_cases FROM mail
        WHERE {" OR ".join(f"regexp_matches(coalesce({c}, ''), 'user1[0-9]|case-00[0-2]', 'i')"
                           for c in C.REFINE_FIELDS)}"""),
    **{f"dsl_{name}": (_by_spec(name), f"WITH {MAIL_SQL} SELECT no, month, stage, sendername FROM mail "
                                       f"WHERE {SPEC_SQL[name]}") for name in ("compare", "ilike", "in_between", "or")},
    "dsl_search": (dsl_search, f"""WITH {MAIL_SQL} SELECT no, deliverytime, subject, sendername, company_name, hvdc_cases
        FROM mail WHERE {SPEC_SQL["or"]} ORDER BY {NEWEST_SQL} LIMIT 50"""),
    "saved_search_match": (saved_search_match, f"WITH {MAIL_SQL} " + " UNION ALL ".join(
        f"SELECT '{name}' AS spec, no FROM mail WHERE {where}" for name, where in SPEC_SQL.items())),
    "saved_search_index": (saved_search_index, f"WITH {MAIL_SQL}, seeds AS (SELECT * FROM mail WHERE senderemail IS NOT NULL "
        "AND deliverytime IS NOT NULL AND month IS NOT NULL AND no IN "
        "(SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)) "
        "SELECT 'later-' || s.no AS spec, m.no FROM seeds s JOIN mail m ON m.senderemail = s.senderemail "
        "AND m.deliverytime > s.deliverytime UNION ALL "
        "SELECT 'month-' || s.no AS spec, m.no FROM seeds s JOIN mail m ON m.month = s.month AND m.stage <> 'error' UNION ALL "
        "SELECT 'either-' || s.no AS spec, m.no FROM seeds s JOIN mail m ON m.deliverytime = s.deliverytime "
        "OR contains(lower(m.senderemail), lower(s.senderemail)) UNION ALL " + " UNION ALL ".join(
        f"SELECT '{name}' AS spec, no FROM mail WHERE {where}" for name, where in SPEC_SQL.items())),
    "fetch_bodies": (fetch_bodies, f"""WITH {MAIL_SQL} SELECT h.no, m.subject, m.plaintextbody FROM
        (SELECT CAST(doc_id AS VARCHAR) AS no FROM labels WHERE quality = 1) h LEFT JOIN mail m USING (no)"""),
    "case_thread": (case_thread, f"""WITH {MAIL_SQL} SELECT primary_case, no, deliverytime, subject, sendername FROM mail
        WHERE primary_case IN (SELECT primary_case FROM mail WHERE no IN
            (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1))"""),
    "case_places": (case_places, f"""WITH {MAIL_SQL} SELECT primary_case, no, row_number() OVER (PARTITION BY primary_case
        ORDER BY {TIME_SQL} ASC NULLS LAST, CAST(no AS BIGINT)) AS place FROM mail"""),
    "turn_order": (turn_order, """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
        AS place FROM conversations"""),
    "sender_history": (sender_history, f"""WITH {MAIL_SQL}, pairs AS (SELECT s.no AS seed, m.no, m.deliverytime
        FROM mail s JOIN mail m ON m.senderemail = s.senderemail AND m.no <> s.no
        WHERE s.no IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1))
        {top_sql("pairs", NEWEST_SQL, 20, "seed, no, position", "seed")}"""),
    "newest_first": (newest_first, f"""WITH {MAIL_SQL} {top_sql("mail", NEWEST_SQL, 100,
        "stage, no, deliverytime, position", "stage")}"""),
    "oldest_first": (oldest_first, f"""WITH {MAIL_SQL} {top_sql("mail", NEWEST_SQL.replace("DESC", "ASC"), 100,
        "stage, no, deliverytime, position", "stage")}"""),
    "dedupe_keep_first": (dedupe_keep_first, """SELECT user_id, event_type, min(event_id) AS event_id,
        round(arg_min(value, event_id), 2) AS value FROM events GROUP BY user_id, event_type"""),
    "link_map_build": (link_map_build, f"WITH {FILES_SQL} {placed_sql('files')}"),
    "link_map_override": (link_map_override, f"WITH {FILES_SQL}, {OVERRIDES_SQL} SELECT linkkey, id, title FROM merged"),
    "link_attach": (link_attach, f"""WITH {MAIL_SQL}, {LINKS_SQL} SELECT m.no, m.linkkey, l.id, l.position, l.label
        FROM mail m LEFT JOIN links l USING (linkkey)"""),
    "link_parts": (link_parts, f"WITH {LINKS_SQL} SELECT linkkey, position, label, view_url, download_url FROM links"),
    "link_first": (link_first, f"""WITH {MAIL_SQL}, {LINKS_SQL} SELECT m.linkkey, m.no, l.view_url, l.download_url
        FROM mail m LEFT JOIN (SELECT * FROM links WHERE position = 1) l USING (linkkey)"""),
    "link_extract": (link_extract, rf"""WITH {FILES_SQL}, placed AS ({placed_sql('files')}),
        texts AS ({sql_view(MENTIONS)}),
        clean AS (SELECT doc, list_filter([CASE WHEN first_text = 'None' THEN NULL ELSE first_text END, second_text],
                                          lambda t: t IS NOT NULL) AS parts FROM texts),
        found AS (SELECT doc,
            flatten(list_transform(parts, lambda t: list_concat([t], regexp_extract_all(t, '\b[0-9a-fA-F]{{12}}\b'))))
                AS keys,
            flatten(list_transform(parts, lambda t: regexp_extract_all(t, '{C.FILE_ID}', 1))) AS ids FROM clean),
        keys AS (SELECT doc, unnest(keys) AS value, unnest(range(len(keys))) AS place FROM found),
        firsts AS (SELECT doc, arg_min(value, place) AS linkkey FROM keys
                   WHERE value IN (SELECT linkkey FROM placed) GROUP BY doc),
        ids AS (SELECT doc, value, row_number() OVER (PARTITION BY doc ORDER BY min(place)) AS position,
                       count(*) OVER (PARTITION BY doc) AS files
                FROM (SELECT doc, unnest(ids) AS value, unnest(range(len(ids))) AS place FROM found) GROUP BY doc, value)
        SELECT f.doc, p.id, p.title, p.position, p.files FROM firsts f JOIN placed p USING (linkkey)
        UNION ALL SELECT doc, value, '{C.LOOSE_FILE_TITLE}', position, files FROM ids
        WHERE doc NOT IN (SELECT doc FROM firsts)"""),
}
