"""A task of the top-k search holds the scores of a slice of queries, not of a whole block."""

import tracemalloc

import numpy as np
import pandas as pd

from mailsift.llm import topk


def frame(queries, rows, width=8):
    rng = np.random.default_rng(1)
    v = list(rng.integers(-200, 200, (queries + rows, width)))
    side = np.arange(queries + rows) < queries
    return pd.DataFrame({"side": side, "id": np.arange(queries + rows), "v": v, "cutoff": np.where(side, 60_000.0, np.nan)})


def most(find, given):
    tracemalloc.start()
    out = find(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_memory_of_a_block_is_that_of_a_slice():
    given = frame(4_096, 4_096)
    scores = 4_096 * 4_096 * 8
    for find in (topk._local_best(6, 2), topk._above(2)):
        _, peak = most(find, given)
        assert peak < scores / 2


def test_rows_below_the_cutoff_stay_behind():
    given = frame(300, 500)
    out = topk._above(2)(given)
    v = np.stack(given.v)
    exact = v[:300] @ v[300:].T
    assert set(zip(out["query"], out["row"])) == {(q, 300 + r) for q, r in zip(*np.nonzero(exact >= 60_000))}
