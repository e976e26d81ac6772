"""Line dedup: buckets whose leader is unlike a member."""

import contextlib
import io

from mailsift.llm import fuzzy_lines


def test_few_buckets_travel_to_their_members(spark):
    members = spark.createDataFrame(
        [(7, 1, 10), (7, 2, 10), (7, 3, 10), (8, 1, 10), (8, 2, 10), (8, 4, 10)], "bucket long, node long, n long")
    # of bucket 7, 3 is in another cluster than the leader 1; in bucket 8 all are of the cluster of its leader 2
    apart = spark.createDataFrame([(7, 1), (8, 2)], "bucket long, leader long")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (3, 3)], "node long, cluster long")
    roots = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 1)], "node long, root long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fuzzy_lines._strays(apart, members, clusters, roots)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            found.explain("simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.bucket, r.node, r.n_shingles, r.root, r.stray, r.strays, r.n) for r in found.collect()) == [
        (7, 2, 10, 2, False, 1, 2), (7, 3, 10, 3, True, 1, 2)]
    assert "SortMergeJoin [bucket" not in text.getvalue()
