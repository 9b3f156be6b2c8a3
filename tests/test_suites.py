"""Suites of cases, word times and edits at a time, by hand or brute force on small tables."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import cues as C
from cuelake.operators import metrics as M
from cuelake.operators import suites as S

CUES = "media_id string, ord long, start_time double, end_time double, text string"


def test_word_timing(spark):
    words = "case_id string, ord long, start_time double, end_time double, text string"
    ref = spark.createDataFrame([("a", 0, 0.0, 1.0, "One"), ("a", 1, 1.0, 2.0, "two, three"), ("a", 2, 5.0, 4.0, "gone"), ("a", 3, 6.0, 7.0, "four"), ("b", 0, 0.0, 1.0, "x")], words)
    got = spark.createDataFrame([("a", 0, 0.5, 1.0, "one"), ("a", 1, 1.0, 2.5, "three"), ("a", 2, 6.0, 7.0, None), ("c", 0, 0.0, 1.0, "x")], words)
    rows = {r["case_id"]: r for r in S.word_timing(ref, got, "case_id").collect()}
    assert set(rows) == {"a", "b"}
    assert tuple(rows["a"]) == ("a", 4, 2, 2, 0.5, 0.25, 0.5, 0.25, 0.5)
    assert tuple(rows["b"]) == ("b", 1, 0, 0, 0.0, None, None, None, None)


def test_word_timing_query_matches_equal_words(spark, tmp_path):
    from cuelake.plans import catalog

    turns = ["the cat sat on the mat", "the cat lay on the mat", "nothing", None, ""]
    spark.createDataFrame([("c", i, t) for i, t in enumerate(turns)], "conv_id string, turn long, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    rows = {r["case_id"]: r for r in catalog.QUERIES["word_timing"](spark, f"file://{tmp_path}").collect()}
    assert rows["c-1"]["matched"] == sum(b.size for b in difflib.SequenceMatcher(None, turns[0].split(), turns[1].split(), False).get_matching_blocks())
    assert rows["c-1"]["start_mean"] == pytest.approx(0.1) and rows["c-2"]["matched"] == 0


def test_overlaps_by_sweep(spark):
    rng = random.Random(5)
    rows = [(str(k % 3), k, float(rng.randint(0, 40)), 0.0, "x") for k in range(120)]
    rows = [(m, k, s, s + rng.randint(-2, 12), t) for m, k, s, _, t in rows]
    want = {}
    for m in "012":
        ok = [(s, e) for n, _, s, e, _ in rows if n == m and e > s]
        shared = [min(a[1], b[1]) - max(a[0], b[0]) for i, a in enumerate(ok) for b in ok[i + 1 :]]
        want[m] = (sum(x > 0 for x in shared), float(sum(x for x in shared if x > 0)))
    df = spark.createDataFrame(rows + [("none", 1, 3.0, 3.0, "x")], CUES)
    assert {r["media_id"]: (r["pairs"], r["seconds"]) for r in M.overlaps(df).collect()} == want | {"none": (0, 0.0)}


def test_new_cue_at(spark):
    cases = [(1.0, None), (9.5, 10.0), (10.0, 10.0), (-3.0, 10.0), (float("nan"), 0.05), (None, None), (7.0, 0.0)]
    df = spark.createDataFrame(cases, "t double, d double")
    got = [(r.x.start_time, r.x.end_time) for r in df.select(C.new_at(F.col("t"), F.col("d")).alias("x")).collect()]
    assert got == [(1.0, 3.0), (9.5, 10.0), (9.9, 10.0), (0.0, 2.0), (0.0, 0.05), (0.0, 2.0), (7.0, 9.0)]


def test_neighbours_leave_out_what_is_too_near(spark):
    cues = spark.createDataFrame([("a", 1, 0.0, 1.0, "x"), ("a", 2, 0.5, 5.0, "x"), ("a", 3, 6.0, 7.0, "x"), ("b", 4, 0.0, 1.0, "x")], CUES)
    probes = spark.createDataFrame([("a", 5.97), ("a", 5.0), ("a", 9.0), ("c", 1.0)], "media_id string, t double")
    got = {(r["media_id"], r["t"]): (r["next_start"], r["previous_start"]) for r in C.neighbours(cues, probes).collect()}
    assert got == {("a", 5.97): (None, 0.5), ("a", 5.0): (6.0, 0.0), ("a", 9.0): (None, 6.0), ("c", 1.0): (None, None)}


def test_insert_and_move(spark):
    cues = spark.createDataFrame([("a", 1, 3.0, 4.0, "x"), ("b", 1, 0.5, 1.0, "y"), ("b", 2, 2.0, 3.0, "z")], CUES)
    before = {(r["media_id"], r["ord"]): (r["start_time"], r["end_time"]) for r in C.insert_beside(cues, "b", 1, after=False).collect()}
    assert len(before) == 4 and before["b", 3] == (0.0, 1.0)
    down = {(r["media_id"], r["ord"]): r["index"] for r in C.moved(C.renumber(cues), "b", 1, down=True).collect()}
    assert down == {("a", 1): 1, ("b", 1): 2, ("b", 2): 1}
    last = {(r["media_id"], r["ord"]): r["index"] for r in C.moved(C.renumber(cues), "b", 2, down=True).collect()}
    assert last == {("a", 1): 1, ("b", 1): 1, ("b", 2): 2}


def test_joined_cases(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    got = {r["id"]: r["status"] for r in S.joined_cases(ids("a", "b", "b", None), ids("b", "c", "d", "a"), "id").collect()}
    assert got == {"a": "ok", "b": "duplicate", "c": "unknown", "d": "unknown", None: "unnamed"}


def test_performance_and_debounce(spark):
    t = spark.createDataFrame([(5000.0, 10.0), (None, 10.0), (5.0, 0.0)], "processing_ms double, audio_seconds double")
    assert [r["real_time_factor"] for r in S.performance(t).collect()] == [0.5, None, None]
    e = spark.createDataFrame([("a", 0.0), ("a", 0.3), ("a", 1.1), ("a", 1.8), ("b", 0.0)], "k string, t double")
    assert sorted(map(tuple, S.debounced(e, "k", "t", 0.7).collect())) == [("a", 0.3), ("a", 1.1), ("a", 1.8), ("b", 0.0)]
