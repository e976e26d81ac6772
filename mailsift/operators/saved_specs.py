"""Saved filter specifications as an index: rows meet the specifications that their values point to.

`filters.match_saved` puts every specification into the plan.  Here specifications are a table, and the plan has one size
for any number of them:

1. Each specification is reached by one condition (`and`: the one that selects least; `or`: every one).
2. Conditions are resolved against the distinct values of the fields.  Equalities are keys.  Substrings are looked for all
   at the same time.  Ranges become nodes of a binary tree over the order of all bounds, and a value meets the nodes above
   its place; so both are joins by equality.  The result is (field, value, specification).
3. Rows meet it by (field, value), and what is left of the specification is checked on the row where it is met: its other
   conditions (`and`), or that no earlier condition of it holds in another field (`or`), so that a pair comes once.

A specification that only negations or no condition at all can reach is checked on every row, as nearly every row passes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.clean import any_of
from ..storage import materialise
from .containment import find_terms
from .filters import _parts, _problems
from .joins import join_small
from .ranking import running_count

#: Kinds of conditions, the most selective first; negations reach no rows.
EQUAL, BETWEEN, SUBSTRING, HALF_OPEN, NEGATED = range(5)
KINDS = {"eq": EQUAL, "in": EQUAL, "between": BETWEEN, "ilike": SUBSTRING, "gt": HALF_OPEN, "gte": HALF_OPEN,
         "lt": HALF_OPEN, "lte": HALF_OPEN, "neq": NEGATED, "not_ilike": NEGATED}
#: Rows are dealt to so many lanes where they meet specifications that any row can pass.
LANES = 16


def spec_rows(spark: SparkSession, specs: dict[str, Any]) -> DataFrame:
    """(spec, definition) of specifications at hand, the form in which a table of them is stored."""
    return spark.createDataFrame([(name, json.dumps(spec)) for name, spec in specs.items()], "spec string, definition string")


def parsed(specs: DataFrame) -> DataFrame:
    """(spec, logic, conditions) of a table (spec, definition), which is checked as `filters.compile_filter` does.

    A definition that is no valid specification, or null, raises an error that names it.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, text in zip(frame["spec"], frame["definition"]):
                spec = json.loads(text) if text else None
                for problem in _problems(spec):
                    raise ValueError(f"specification {name}: {problem}")
                out.append((name, str(spec.get("logic", "and")).lower(), [
                    {"field": field, "op": op, "values": [str(v) for v in values]}
                    for field, op, values in map(_parts, spec.get("filters", []))]))
            yield pd.DataFrame(out, columns=["spec", "logic", "conditions"])

    return specs.select("spec", "definition").mapInPandas(
        parse, "spec string, logic string, conditions array<struct<field string, op string, values array<string>>>")


def _holds(texts: Column, condition: Column) -> Column:
    """Whether the map of a row's values fulfils a condition; a missing value fulfils none."""
    value, op, values = texts[condition["field"]], condition["op"], condition["values"]
    first, last = values[0], F.element_at(values, -1)
    held = F.contains(F.lower(value), F.lower(first))
    test = (F.when(op.isin("eq", "in"), F.array_contains(values, value)).when(op == "neq", value != first)
            .when(op == "gt", value > first).when(op == "gte", value >= first)
            .when(op == "lt", value < first).when(op == "lte", value <= first)
            .when(op == "between", value.between(first, last))
            .when(op == "ilike", held).otherwise(~held))
    return F.coalesce(test, F.lit(False))


def _chosen(table: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The conditions (spec, field, op, values, kind) by which specifications are reached, what is left to check of those
    (spec, logic, left), and the specifications (spec, logic, conditions) without such a condition."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("op")]
    one = table.select("spec", "logic", F.posexplode("conditions").alias("place", "c")).select(
        "spec", "logic", "place", "c.field", "c.op", "c.values")
    one = one.withColumn("kind", F.when((F.col("op") == "ilike") & (F.col("values")[0] == ""), NEGATED).otherwise(kind))
    hits = (_equalities(one, "place").join(values, ["field", "value"]).groupBy("spec", "place").agg(F.sum("n").alias("rows")))
    one = materialise(one.join(hits, ["spec", "place"], "left"), "conditions")
    order = F.struct("kind", F.coalesce("rows", F.lit(0)).alias("rows"), "place")
    best = one.groupBy("spec").agg(F.min(order).alias("best"), F.max("kind").alias("worst"), F.first("logic").alias("logic"))
    least = F.when(F.col("logic") == "and", F.col("best.kind")).otherwise(F.col("worst"))
    reached = best.where(least != NEGATED).select("spec", F.col("best.place").alias("best_place"))
    met = one.join(reached, "spec").where((F.col("logic") == "or") | (F.col("place") == F.col("best_place")))
    others = F.filter("conditions", lambda c, i: (F.col("logic") == "or") | (i != F.col("best_place")))
    return (met.select("spec", "field", "op", "values", "kind"),
            table.join(reached, "spec").select("spec", "logic", others.alias("left")),
            table.join(reached.select("spec"), "spec", "left_anti"))


def _passes(field: Column) -> Column:
    """Whether a row that meets a specification by its value of `field` passes what is `left` of it.

    All conditions of an `or` are left: the row counts where the first of them that holds is one of the field.
    """
    def held(c: Column) -> Column:
        return _holds(F.col("texts"), c)

    left, count = F.col("left"), F.size("left")
    rest = F.when(count == 0, True).when(count == 1, held(left[0])).otherwise(F.forall(left, held))
    later = F.when(count == 2, left[1]["field"] == field).otherwise(F.filter(left, held)[0]["field"] == field)
    return F.when(F.col("logic") == "or", F.when(held(left[0]), left[0]["field"] == field).otherwise(later)).otherwise(rest)


def _equalities(conditions: DataFrame, *more: str) -> DataFrame:
    return conditions.where(F.col("kind") == EQUAL).select(
        "spec", *more, "field", F.explode(F.array_distinct("values")).alias("value"))


def _substrings(conditions: DataFrame, values: DataFrame) -> DataFrame:
    """(field, value, spec) of the values that hold the text of a specification."""
    asked = conditions.where(F.col("kind") == SUBSTRING).select("spec", "field", F.lower(F.col("values")[0]).alias("term"))
    texts = values.join(F.broadcast(asked.select("field").distinct()), "field", "left_semi").select(
        F.col("value").alias("key"), "field", F.col("value").alias("text"))
    found = find_terms(texts, asked.select("term"))
    return found.join(asked, ["field", "term"]).select("field", F.col("key").alias("value"), "spec")


def tree_nodes(low: int, high: int) -> list[tuple[int, int]]:
    """The fewest nodes (level, number) of a binary tree whose leaves are `low` to `high`, both included."""
    nodes, level = [], 0
    while low <= high:
        if low % 2:
            nodes.append((level, low))
            low += 1
        if high % 2 == 0:
            nodes.append((level, high))
            high -= 1
        low, high, level = low // 2, high // 2, level + 1
    return nodes


def _ranges(conditions: DataFrame, values: DataFrame) -> DataFrame:
    """(field, value, spec) of the values inside a specification's range.

    Of `n` bounds of a field, bound i has place 2i + 1 and the values between bounds i - 1 and i have place 2i.
    """
    asked = conditions.where(F.col("kind").isin(BETWEEN, HALF_OPEN)).select(
        "spec", "field", "op", F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"))
    asked = materialise(asked, "ranges-asked")
    bounds = asked.select("field", F.explode(F.array("first", "last")).alias("value")).distinct().withColumn("bound", F.lit(1))
    wanted = values.join(F.broadcast(bounds.select("field").distinct()), "field", "left_semi")
    points = wanted.select("field", "value", F.lit(0).alias("bound"), F.lit(1).alias("held")).unionByName(
        bounds.withColumn("held", F.lit(0))).groupBy("field", "value").agg(
        F.max("bound").alias("bound"), F.max("held").alias("held"))
    placed = running_count(points, ["field"], [F.col("value")], "bound", "before").select(
        "field", "value", "held", (2 * F.col("before") + F.col("bound")).alias("spot"), "bound")
    placed = materialise(placed, "places")
    of_bound = placed.where("bound = 1").select("field", "value", "spot")
    top = 2 * bounds.count()
    ends = (asked.join(of_bound.withColumnsRenamed({"value": "first", "spot": "a"}), ["field", "first"])
            .join(of_bound.withColumnsRenamed({"value": "last", "spot": "b"}), ["field", "last"]))
    op = F.col("op")
    low = F.when(op == "gt", F.col("a") + 1).when(op.isin("gte", "between"), F.col("a")).otherwise(0)
    high = F.when(op == "lt", F.col("b") - 1).when(op.isin("lte", "between"), F.col("b")).otherwise(top)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(spec, field, level, node) for spec, field, a, b in frame.itertuples(index=False)
                   for level, node in tree_nodes(int(a), int(b))]
            yield pd.DataFrame(out, columns=["spec", "field", "level", "node"])

    nodes = ends.select("spec", "field", low.cast("long").alias("low"), high.cast("long").alias("high")).mapInPandas(
        split, "spec string, field string, level int, node long")
    above = placed.where("held = 1").select(
        "field", "value", "spot", F.explode(F.sequence(F.lit(0), F.lit(top.bit_length()))).alias("level")).select(
        "field", "value", "level", F.expr("shiftright(cast(spot AS bigint), level)").alias("node"))
    return join_small(above, nodes, ["field", "level", "node"], "value").select("field", "value", "spec")


def match_table(df: DataFrame, specs: DataFrame, key: str = "no") -> DataFrame:
    """(spec, key) of every specification of the table (spec, definition) that a row passes.

    The same rows as `filters.match_saved`, in no order.  Fields are compared as text; a column that `df` lacks holds nothing.
    Names of specifications are unique.  Rows with equal or null keys are judged one by one.
    """
    table = materialise(parsed(specs), "specifications")
    used = table.select(F.explode("conditions.field").alias("field")).distinct()
    # At most as many as there are fields to filter by.
    asked = {r["field"] for r in used.collect()}
    present = [f for f in C.FILTER_FIELDS if f in df.columns and f in asked]
    pairs = [x for f in present for x in (F.lit(f), F.col(f).cast("string"))]
    texts = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    rows = df.select(F.col(key).alias("key"), texts.alias("texts"))
    cells = rows.select("key", "texts", F.explode("texts").alias("field", "value")).where(F.col("value").isNotNull())
    values = materialise(cells.groupBy("field", "value").agg(F.count("*").alias("n")), "values")
    conditions, left, always = _chosen(table, values)
    conditions = materialise(conditions, "reached-by")
    access = _equalities(conditions).select("field", "value", "spec").unionByName(
        _substrings(conditions, values)).unionByName(_ranges(conditions, values)).distinct().join(left, "spec")
    met = join_small(cells, materialise(access, "access"), ["field", "value"], "key").where(_passes(F.col("field")))
    lanes = materialise(always, "any-row").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    any_row = rows.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(LANES)).cast("int"))
    tests = F.transform("conditions", lambda c: _holds(F.col("texts"), c))
    passed = F.when(F.col("logic") == "or", any_of([F.size("conditions") == 0, F.exists(tests, lambda t: t)])).otherwise(
        F.forall(tests, lambda t: t))
    judged = join_small(any_row, lanes, ["lane"], "key").where(passed)
    return met.select("spec", F.col("key").alias(key)).unionByName(judged.select("spec", F.col("key").alias(key)))
