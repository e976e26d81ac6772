"""The index of saved specifications against the specifications compiled one by one."""

import random

import pytest
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.operators.filters import match_saved
from mailsift.operators.saved_specs import match_table, spec_rows, tree_nodes

WORDS = ["alpha", "Beta", "gamma delta", "100%_sure", "", "Ärger", "199801", "199912", "zz"]
FIELDS = ["month", "stage", "subject", "site"]


def mail_of(spark, rows):
    return spark.createDataFrame(rows, "no string, month string, stage string, subject string, site string")


def random_mail(rng, n):
    rows = [(str(i), *[rng.choice([*WORDS, None]) for _ in FIELDS]) for i in range(n)]
    # one value holds a third of the rows; keys repeat and one is missing
    rows += [("hot", "199801", "alpha", rng.choice(WORDS), None) for _ in range(n // 2)]
    return rows + [(None, "199801", "Beta", "Beta", "zz"), (None, "199912", None, None, None)]


def random_spec(rng):
    filters = []
    for _ in range(rng.randint(0, 4)):
        op = rng.choice(list(C.FILTER_OPS))
        many = rng.randint(1, 3) if op == "in" else 2
        value = [rng.choice(WORDS) for _ in range(many)] if op in ("in", "between") else rng.choice([*WORDS, "A", "%", "a d"])
        filters.append({"field": rng.choice(FIELDS), "op": op, "value": value})
    return {"logic": rng.choice(["and", "or"]), "filters": filters}


def found(df):
    return sorted((r["spec"], r["no"] or "") for r in df.collect())


def test_same_rows_as_compiled_specifications(spark):
    rng = random.Random(5)
    mail = mail_of(spark, random_mail(rng, 60))
    specs = {f"s{i}": random_spec(rng) for i in range(60)}
    specs |= {"none": {}, "none_or": {"logic": "or", "filters": []},
              "upside_down": {"filters": [{"field": "month", "op": "between", "value": ["zz", "a"]}]},
              "number": {"filters": [{"field": "month", "op": "gte", "value": 199801}]}}
    want = found(match_saved(mail, specs))
    assert found(match_table(mail, spec_rows(spark, specs))) == want and want


def test_empty_tables_and_missing_columns(spark):
    some = {"a": {"filters": [{"field": "month", "op": "eq", "value": "199801"}]},
            "b": {"filters": [{"field": "sendername", "op": "neq", "value": "x"}]}}
    assert found(match_table(mail_of(spark, []), spec_rows(spark, some))) == []
    mail = mail_of(spark, [("1", "199801", None, None, None)])
    assert found(match_table(mail, spec_rows(spark, some))) == [("a", "1")]
    assert found(match_table(mail, spec_rows(spark, some).limit(0))) == []


def test_a_bad_specification_is_named(spark):
    specs = spec_rows(spark, {"odd": {"filters": [{"field": "no_such", "op": "eq", "value": "1"}]}})
    with pytest.raises(Exception, match="specification odd: filter 0: no such field"):
        match_table(mail_of(spark, []), specs).collect()


def test_ten_thousand_specifications_have_the_plan_of_one(spark):
    def specs(n):
        return spark.range(n).select(
            F.concat(F.lit("s"), "id").alias("spec"),
            F.format_string('{"filters": [{"field": "subject", "op": "eq", "value": "word%s"},'
                            ' {"field": "month", "op": "gte", "value": "%s"}]}', "id", F.col("id") % 100).alias("definition"))

    mail = mail_of(spark, [(str(i), str(i % 100), None, f"word{i % 5000}", None) for i in range(6000)])
    plans, counts = [], []
    for n in (1, 10_000):
        got = match_table(mail, specs(n))
        plans.append(got._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        counts.append(got.count())
    assert abs(plans[0] - plans[1]) <= 2
    assert counts == [2, sum(1 for i in range(6000) if str(i % 100) >= str(i % 5000 % 100))]


def test_nodes_cover_each_range_once():
    for low in range(0, 20):
        for high in range(low - 1, 20):
            leaves = [leaf for level, node in tree_nodes(low, high) for leaf in range(node << level, (node + 1) << level)]
            assert sorted(leaves) == list(range(low, high + 1))
