"""Text rules against plain restatements, on awkward inputs."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions import clean, entities, expand, text
from mailsift.functions.stem import stem_word


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_ids(spark):
    values = ["51964", "51964.0", "51964.00", " 7 ", "None", None]
    assert column(spark, values, clean.id_value) == ["51964", "51964", "51964.00", "7", "None", ""]
    assert column(spark, values, clean.id_key) == ["51964", "51964", "51964", "7", "None", None]
    assert column(spark, values, clean.id_number) == [51964, 51964, 51964, 7, None, None]


def test_missing_values(spark):
    values = ["", "  ", "None", "nan", "NULL", " none ", "nano", "x", None]
    assert column(spark, values, clean.real_null) == [None] * 6 + ["nano", "x", None]


def test_months_sites_times(spark):
    assert column(spark, ["202509", "202509.0", "2025", None], clean.month_label) == ["2025-09", "2025-09", "2025", ""]
    assert column(spark, ["agi", " Das Island ", "GHALLAN", "Jetty 4", "unknown", None], clean.site_value) == [
        "AGI", "DAS", "AGI", "Jetty 4", None, None]
    assert column(spark, ["2025-03-01 10:20:30", "2025-03-01", " soon ", None], clean.timestamp_label) == [
        "2025-03-01 10:20:30", "2025-03-01 00:00:00", "soon", ""]


def plain_chunks(body):
    body = (body or "").strip()
    if len(body) <= 500:
        return [body] if body else []
    return [body[i:i + 500] for i in range(0, len(body), 450)]


def test_chunks(spark):
    letters = "abcdefghijklmnopqrstuvwxyzé한 "
    bodies = [("x" + (letters * (n // len(letters) + 1)))[:max(n - 1, 0)] + ("y" if n else "")
              for n in (0, 1, 449, 450, 451, 500, 501, 900, 901, 5000, 20000, 45000, 45050, 45051, 100001)]
    bodies += ["\n\n  lead", None, " " * 600]
    assert column(spark, bodies, text.chunks) == [plain_chunks(b) for b in bodies]
    assert [len(c) for c in column(spark, bodies, lambda c: text.chunks(c, limit=C.MAX_BODY_CHUNKS))] == [
        min(len(plain_chunks(b)), 10) for b in bodies]


def test_code_variants(spark):
    found = column(spark, ["LPO-1088", "lpo 1088", "no code", "é12 ab34."], text.code_variants)
    assert found[0] == ["LPO-1088", "LPO/1088", "LPO_1088", "LPO 1088", "LPO1088"]
    assert found[1] == ["lpo 1088", "lpo-1088", "lpo/1088", "lpo_1088", "lpo1088"]
    assert found[2] == [] and found[3][0] == "ab34"


@pytest.mark.parametrize("query, some, none", [
    ("LPO-1088", ["LPO-1088", "lpo1088"], []),
    ("5000684244", ["5000684244"], []),
    ("MRR-2025-001", ["MRR-2025-001", "mrr2025001", "MRR-2025"], []),
    ("CASE-ADOPT-SEI-0008", ["CASE-ADOPT-SEI-0008", "SEI-0008"], []),
    ("demurrage claim", [], ["demurrage"]),
])
def test_identifier_terms(spark, query, some, none):
    found = column(spark, [query], text.identifier_terms)[0]
    assert set(some) <= set(found) and not set(none) & set(found) and len(found) <= 16


def test_query_terms(spark):
    assert column(spark, ["The DSV or the B/L for AGI agi ab 통관지연 통관 x-ray", None], text.query_terms) == [
        ["DSV", "B/L", "AGI", "agi", "통관지연", "x-ray"], []]


def plain_mask_addresses(value):
    def one(token):
        found = re.fullmatch(r"(\s*)([^@\s])[^@\s]*@([^@\s]+)(\s*)", token)
        return f"{found[1]}{found[2]}****@{found[3]}{found[4]}" if found else token
    return "".join(p if p in ";," else one(p) for p in re.split("([;,])", (value or "").strip()))


def test_mask_addresses(spark):
    values = ["a.b@x.com", "Jo Doe; abc@y.org, z@w.io ;q", "Name <a@b.c>", "@x", "a@b@c", "", None,
              "a@b.c;d@e.f,g@h.i", " x y@z "]
    assert column(spark, values, text.mask_addresses) == [plain_mask_addresses(v) for v in values]


def plain_mask(value):
    for pattern, tag in C.MASKS:
        value = re.sub(pattern, tag, value or "", flags=re.IGNORECASE)
    return value


def test_mask_text(spark):
    values = ["write to a.b@x.com now", "call +971 50 123 4567.", "PO 5000684244", "id 12345678", "about 12345678",
              "ab-12345/x", "é12345678", None]
    masked = column(spark, values, text.mask_text)
    assert masked == [plain_mask(v) for v in values]
    assert masked[0] == "write to [email] now" and masked[1] == "call [phone/ref]." and masked[4] == "[ref]"


def test_entities(spark):
    found = column(spark, ["통관 지연 dsv AGI", "통관지연", "DSV é dsv HMM", "b/l DO 통관"], entities.entity_map)
    assert found[0] == {"Site": ["AGI"], "Vendor": ["dsv"], "Issue": ["통관", "지연"]}
    assert found[1] == {}
    assert found[2]["Vendor"] == ["DSV", "dsv", "HMM"]
    assert found[3] == {"Doc": ["b/l", "DO"], "Issue": ["통관"]}
    many = " ".join(f"PO-ABCDE{chr(65 + i)}" for i in range(7))
    assert len(column(spark, [many], entities.entity_map)[0]["Ref"]) == C.MAX_ENTITY_VALUES


def test_chips_and_labels(spark):
    chips = column(spark, ["DSV ALS HMM SCT hold at DAS"], lambda c: entities.chip_text(entities.entity_map(c)))
    assert chips == ["[Vendor: DSV, ALS, HMM] [Issue: hold] [Site: DAS]"]
    labels = column(spark, ["Demurrage at port", "BOE delay", "late: delayed", "MOSB", "hello"],
                    lambda c: entities.issue_label(c, F.lit(None)))
    assert labels == ["DEM/DET", "통관", "선적지연", "MOSB", "기타"]
    assert column(spark, ["Approved!", "hello"], lambda c: entities.decision_signal(c, F.lit(None))) == [1.0, 0.0]


def snippet_of(spark, body, terms):
    rows = spark.createDataFrame([(body, terms)], "b string, t array<string>")
    return rows.select(text.snippet(F.col("b"), F.col("t"))).first()[0]


def test_snippets(spark):
    assert snippet_of(spark, "One. Two has alpha.\nThree. Four ALPHA beta! Five.", ["alpha", "beta"]) == (
        "Four **ALPHA** **beta**! Two has **alpha**.")
    assert snippet_of(spark, "nothing here", ["alpha"]) == ""
    assert snippet_of(spark, "no punctuation but alpha", ["alpha"]) == "no punctuation but **alpha**"
    assert snippet_of(spark, None, ["alpha"]) == ""
    long = "x" * 400 + " end. next " + "y" * 400
    assert snippet_of(spark, long, ["end. next"]) == (
        "..." + "x" * 149 + " **end. next** " + "y" * 140 + "...")


def test_expansion(spark):
    assert column(spark, ["통관지연"], expand.variants)[0] == [
        "통관지연", "통관", "수입통관", "세관", "지연", "딜레이", "지체"]
    assert column(spark, ["통관지연"], expand.english_terms)[0] == [
        "customs clearance", "customs", "delay", "delayed", "demurrage", "detention"]
    assert column(spark, ["DSV mrr", "", "hello world"], expand.rewrite) == [
        "DSV OR mrr OR inspection OR material receiving report", "", "hello OR world"]


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("gaps", "gap"), ("gas", "gas"), ("agreed", "agre"),
    ("plastered", "plaster"), ("hopping", "hop"), ("hoping", "hope"), ("falling", "fall"), ("cry", "cri"), ("by", "by"),
    ("say", "say"), ("relational", "relat"), ("conditional", "condit"), ("generically", "generic"), ("generate", "generat"),
    ("communism", "communism"), ("approvals", "approv"), ("confirmed", "confirm"), ("shipment", "shipment"),
    ("skies", "sky"), ("inning", "inning"), ("knightly", "knight"), ("consolingly", "consol"), ("controll", "control"),
    ("adoption", "adopt"), ("youth", "youth"), ("boyish", "boyish"), ("early", "earli")])
def test_stem(word, stem):
    assert stem_word(word) == stem


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1-@.;, \nABé통", max_size=40), min_size=1, max_size=5))
def test_masks_hold_on_any_text(spark, values):
    masked = column(spark, values, text.mask_text)
    assert masked == [plain_mask(v) for v in values]
    assert not any(re.search(C.MASKS[0][0], m, re.IGNORECASE) for m in masked)
    assert column(spark, values, text.mask_addresses) == [plain_mask_addresses(v) for v in values]
    assert column(spark, values, text.chunks) == [plain_chunks(v) for v in values]
