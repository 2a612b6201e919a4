"""Elements with some hundred postings each: the same links as row by row, without the cost of a call for each row."""

import time

import numpy as np
import pyarrow as pa

from broadsheet.llm import set_join as J


def postings_of(elements: int, each: int) -> pa.Table:
    r = np.random.default_rng(5)
    n = elements * each
    rows = {
        "element": np.sort(r.integers(1 << 63, (1 << 63) + (1 << 40), elements, dtype=np.uint64)).repeat(each), "record": r.permutation(n).astype("<i8"), "size": r.integers(4, 40, n).astype("<i4"),
        "place": r.integers(0, 2, n).astype("<i4"), "bitmap": r.integers(0, 1 << 12, (n, 2), dtype=np.uint64),
    }
    return pa.Table.from_pylist([{"bucket": 0} | {k: v.tobytes() for k, v in rows.items()}], J.POSTED)


def test_elements_of_some_hundred_postings_are_paired_together(monkeypatch):
    table = postings_of(150, 180)

    def run():
        began = time.process_time()
        out = J.link(table, J.Threshold(4, 5), None, 7)
        return out.select(["a", "b"]), time.process_time() - began

    run()
    links, took = run()
    monkeypatch.setattr(J, "MANY", 128)
    by_row, took_by_row = run()
    assert links.equals(by_row) and len(links) > 100
    assert 2.5 * took < took_by_row
