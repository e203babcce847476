"""Columns of records whose names the library uses itself are kept."""

import json

from recordflow.sources import load


def test_index_of_lines(spark, tmp_path):
    for n, name in enumerate(("a", "b")):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"_order": i, "_block": n, "_own": "x", "_row": 1}) + "\n" for i in range(5)))
    got = load(spark, f"{tmp_path}/*.jsonl", index=True)
    assert sorted((r._file_index, r._line_index, r._block, r._order, r._own, r._row) for r in got.collect()) == [(n, i, n, i, "x", 1) for n in (0, 1) for i in range(5)]
