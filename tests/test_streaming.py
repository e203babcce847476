"""Streams that are run, given more, and run again: state, late records, growing and rotated files."""

import datetime as dt
import os
import random

import pytest

from recordflow.streaming import (
    follow,
    join_streams,
    keyed_head,
    keyed_numbers,
    keyed_profile,
    keyed_tail,
    register_lines,
    run_available,
    session_counts,
    tumbling_counts,
    use_state_store,
)

BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Gives a stream over a folder, and a function that adds records to it."""
    use_state_store(spark)
    made = []

    def make(schema):
        folder = f"{tmp_path}/in{len(made)}"
        made.append(folder)
        add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        add([])
        return follow(spark, folder, spark.createDataFrame([], schema).schema), add

    return make


def at(minutes):
    return BEGIN + dt.timedelta(minutes=minutes)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_keyed_state_goes_on_after_a_restart(spark, feed, tmp_path):
    rng = random.Random(1)
    stream, add = feed("k string, i long, v double, seq long, place long")
    records = [(rng.choice(["hot"] * 5 + ["a", "b"]), i, None if i % 11 == 0 else float(rng.randint(-5, 50)), 7, 7) for i in range(120)]
    runs = {
        "numbers": lambda: run_available(keyed_numbers(stream, ["k"], ["i"]), f"{tmp_path}/numbers"),
        "head": lambda: run_available(keyed_head(stream, ["k"], 3, ["i"]), f"{tmp_path}/head"),
        "tail": lambda: run_available(keyed_tail(stream, ["k"], 4, ["i"]), f"{tmp_path}/tail", "update", ["k"]),
        "profile": lambda: run_available(keyed_profile(stream, ["k"], ["v"]), f"{tmp_path}/profile", "update", ["k"]),
    }
    for upto in (50, 51, 120):  # each run is a new query on the same checkpoint
        seen = records[:upto]
        add(random.Random(upto).sample(records[{50: 0, 51: 50, 120: 51}[upto] : upto], {50: 50, 51: 1, 120: 69}[upto]))
        got = {name: run() for name, run in runs.items()}
        by = {}
        for r in seen:
            by.setdefault(r[0], []).append(r)
        assert rows(got["numbers"], "k", "i", "seq") == sorted((k, r[1], n + 1) for k, rs in by.items() for n, r in enumerate(rs))
        assert rows(got["head"], "k", "i") == sorted((k, r[1]) for k, rs in by.items() for r in rs[:3])
        assert rows(got["tail"], "k", "place", "i") == sorted((k, n + 1, r[1]) for k, rs in by.items() for n, r in enumerate(rs[-4:]))
        values = {k: [r[2] for r in rs if r[2] is not None] for k, rs in by.items()}
        assert rows(got["profile"], "k", "records", "count", "min", "max", "sum") == sorted((k, len(by[k]), len(v), min(v, default=None), max(v, default=None), sum(v)) for k, v in values.items())


def test_late_records_and_sessions(spark, feed, tmp_path):
    stream, add = feed("user string, t timestamp, _time int, window int")
    counts = lambda: rows(run_available(tumbling_counts(stream, "t", "10 minutes", ["user"], "5 minutes"), f"{tmp_path}/tumbling"), "start", "user", "count")
    sessions = lambda: rows(run_available(session_counts(stream, "t", "10 minutes", ["user"], "5 minutes"), f"{tmp_path}/sessions"), "start", "end", "user", "count")
    add([("a", at(1), 0, 0), ("a", at(2), 0, 0), ("b", at(8), 0, 0), ("a", at(16), 0, 0)])
    assert counts() == [(at(0), "a", 2), (at(0), "b", 1)]  # the watermark is at minute 11
    assert sessions() == []
    add([("a", at(3), 0, 0), ("a", at(12), 0, 0), ("b", at(40), 0, 0)])  # the first one is late: its window is final
    assert counts() == [(at(0), "a", 2), (at(0), "b", 1), (at(10), "a", 2)]
    # a session of a was still open at the watermark, and minutes 3 and 12 close its gaps
    assert sessions() == [(at(1), at(26), "a", 5), (at(8), at(18), "b", 1)]
    add([("a", at(20), 0, 0), ("b", at(60), 0, 0)])  # late: it would end at minute 30, and the watermark is at 35
    assert sessions() == [(at(1), at(26), "a", 5), (at(8), at(18), "b", 1), (at(40), at(50), "b", 1)]


def test_join_of_streams(spark, feed, tmp_path):
    (left, put), (right, other) = feed("id int, t timestamp"), feed("id int, t timestamp, w int")
    run = lambda: rows(run_available(join_streams(left, right, [("id", "id")], "t", "t", "0 minutes", "10 minutes", "5 minutes", how="left"), f"{tmp_path}/j"), "id", "w")
    put([(1, at(0)), (2, at(1)), (3, at(2))])
    other([(1, at(5), 10), (2, at(30), 20)])
    assert run() == [(1, 10)]
    put([(9, at(60))])
    other([(9, at(60), 90)])
    assert sorted(map(str, run())) == sorted(map(str, [(1, 10), (2, None), (3, None), (9, 90)]))  # what can find no partner any more comes alone


def test_growing_and_rotated_files(spark, tmp_path):
    register_lines(spark)
    log = tmp_path / "logs" / "app.log"
    log.parent.mkdir()
    (tmp_path / "logs" / "app.log.1").write_text("before\n")
    wrote = []

    def write(lines, end="\n"):
        with open(log, "a", newline="") as f:
            f.write("\n".join(lines) + end)
        wrote.extend(lines)

    stream = lambda: spark.readStream.format("lines").option("chunk", "64").load(str(log))
    run = lambda: run_available(stream(), f"{tmp_path}/out").collect()
    write([f"line {i} é" for i in range(40)])
    with open(log, "a") as f:
        f.write("unfinished")
    got = run()
    assert sorted(r.line for r in got) == sorted(wrote) and [r.line for r in sorted(got, key=lambda r: r["at"])] == wrote
    write([" now", "x" * 300, "", "after"])
    wrote[40:42] = ["unfinished now", "x" * 300]
    assert sorted(r.line for r in run()) == sorted(wrote)
    write(["last before rotation"])
    os.rename(log, f"{log}.2")  # while nothing runs: the rest is read under the new name
    write(["first after"])
    assert sorted(r.line for r in run()) == sorted(wrote)
    assert sorted(r.line for r in run()) == sorted(wrote)  # nothing new, nothing twice
    log.write_text("short\n")  # written anew
    wrote.append("short")
    assert sorted(r.line for r in run()) == sorted(wrote)


def test_numbers_of_followed_lines(spark, tmp_path):
    """Line numbers like those of a followed file: keyed state over the lines."""
    register_lines(spark)
    use_state_store(spark)
    path = tmp_path / "a.txt"
    stream = lambda: keyed_numbers(spark.readStream.format("lines").load(str(path)), ["file"], ["at"])
    for n in (3, 10):
        path.write_text("".join(f"row {i}\n" for i in range(n)))
        assert rows(run_available(stream(), f"{tmp_path}/out"), "seq", "line") == [(i + 1, f"row {i}") for i in range(n)]
