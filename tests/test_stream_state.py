"""Loading by keyed state: the first row of each key, over batches and restarts, without a look into the table."""

import datetime as dt

import pyarrow as pa
import pytest

from mailsift.streaming import ingest

SCHEMA = "no string, arrived string, size long, share double, sent timestamp, note string"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def load(spark, tmp_path):
    stream = ingest.read_landing(spark, f"{tmp_path}/landing", SCHEMA, files_per_batch=1)
    query = ingest.append_by_state(stream, f"{tmp_path}/mail", f"{tmp_path}/checkpoint", "no", "arrived")
    query.awaitTermination()
    return query


def loaded(spark, tmp_path):
    return {r["no"]: r for r in spark.read.parquet(f"{tmp_path}/mail").collect()}


def test_first_row_of_each_key_over_batches_and_restarts(spark, tmp_path):
    big, sent = (1 << 62) + 1, dt.datetime(2500, 1, 2, 3, 4, 5, 678901)
    land(spark, f"{tmp_path}/landing", [
        ("a", "2024-01-02", big, 0.1, sent, "late"), ("a", "2024-01-01", None, None, None, "early"),
        ("b", "no time", 1, 2.5, sent, "untimed"), ("b", "2030-01-01", big, 0.1, sent, "timed"),
        ("c", "never", big, 0.1, sent, None), (None, "2024-01-01", 1, 1.0, sent, "no key")])
    load(spark, tmp_path)
    first = loaded(spark, tmp_path)
    assert {k: r["note"] for k, r in first.items()} == {"a": "early", "b": "timed", "c": None}
    assert (first["a"]["size"], first["a"]["share"], first["a"]["sent"]) == (None, None, None)
    assert (first["b"]["size"], first["b"]["share"], first["b"]["sent"]) == (big, 0.1, sent)
    assert first["c"]["arrived"] is None
    # a late repeat with an earlier time, and new keys, after a restart
    land(spark, f"{tmp_path}/landing", [("a", "1990-01-01", 1, 1.0, sent, "repeat"), ("d", "1990-01-01", 1, 1.0, sent, "new")])
    query = load(spark, tmp_path)
    assert {k: r["note"] for k, r in loaded(spark, tmp_path).items()} == {**{k: r["note"] for k, r in first.items()}, "d": "new"}
    assert spark.read.parquet(f"{tmp_path}/mail").count() == 4
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert sum(p["numInputRows"] for p in progress) == 2  # the batch reads its own rows and nothing of the table
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 4


def test_nested_columns_are_refused(spark):
    with pytest.raises(ValueError, match="nested or binary type: tags"):
        ingest.first_rows(spark.createDataFrame([], "no string, arrived timestamp, tags array<string>"), "no", "arrived")


def test_first_of_keys_in_one_task():
    rows = [{"_key": k, "_order": o, "_tie": t, "c0": f"{k}{o}{t}"} for k in "bac" for o in (3, 1, 2) for t in (9, -1)]
    batches = [pa.RecordBatch.from_pylist(rows[i:i + 4]) for i in range(0, len(rows), 4)]
    out = [r["c0"] for b in ingest._first_of_keys(iter(batches)) for r in b.to_pylist()]
    assert out == ["a1-1", "b1-1", "c1-1"]
    assert list(ingest._first_of_keys(iter([]))) == [] and not sum(
        b.num_rows for b in ingest._first_of_keys(iter([batches[0].slice(0, 0)])))


def test_no_python_call_per_key(spark, tmp_path):
    land(spark, f"{tmp_path}/landing", [(str(i % 3000), "2024-01-02", i, 0.1, None, "x") for i in range(6000)])
    query = load(spark, tmp_path)
    assert [s["operatorName"] for p in query.recentProgress for s in p["stateOperators"][:1]][0] == "dedupe"
    assert len(loaded(spark, tmp_path)) == 3000
