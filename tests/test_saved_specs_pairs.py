"""Saved specifications by index: pairs of a row and a specification are judged where they meet, and none comes twice."""

import contextlib
import io
from collections import Counter

from mailsift.operators import filters, saved_specs


def test_pairs_are_not_shuffled_and_come_once(spark):
    rows = [(f"m{i}", f"src{i % 3}", f"1996{i % 12 + 1:02d}", None if i % 7 == 0 else ("view", "click", "error")[i % 3])
            for i in range(60)] + [("m1", "src0", "199601", "error"), (None, "src0", "199601", "view")]
    df = spark.createDataFrame(rows, "no string, sendername string, month string, stage string").selectExpr(
        "*", "cast(null as string) AS site")

    def condition(field, op, value):
        return {"field": field, "op": op, "value": value}

    specs = {
        "two": {"logic": "or", "filters": [condition("sendername", "eq", "src1"), condition("stage", "ilike", "IE")]},
        "same": {"logic": "or", "filters": [condition("month", "gte", "199611"), condition("month", "lt", "199603")]},
        "three": {"logic": "or", "filters": [condition("month", "eq", "199604"), condition("stage", "eq", "view"),
                                             condition("sendername", "in", ["src0", "src2"])]},
        "rest": {"filters": [condition("stage", "neq", "error"), condition("month", "between", ["199602", "199609"]),
                             condition("sendername", "not_ilike", "c2")]},
        "alone": {"filters": [condition("sendername", "eq", "src2")]},
        "any": {"logic": "or", "filters": [condition("stage", "neq", "view"), condition("month", "eq", "199601")]},
        "all": {"filters": []},
        "absent": {"filters": [condition("site", "eq", "de")]},
    }
    found = saved_specs.match_table(df, saved_specs.spec_rows(spark, specs))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        found.explain("simple")
    assert "Exchange hashpartitioning" not in text.getvalue() and "SortMergeJoin" not in text.getvalue()
    got = Counter(tuple(r) for r in found.select("spec", "no").collect())
    want = Counter(tuple(r) for r in filters.match_saved(df, specs).select("spec", "no").collect())
    assert got == want and want[("alone", None)] == 0 and want[("two", None)] == 1
