"""Golden cases and invariants of the cue operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions import time as C
from cuelake.operators import cues, folds, intervals, metrics, windows
from cuelake.sources import audio, captions

CUE = "media_id string, ord long, start_time double, end_time double, text string"


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def table(spark, rows):
    return spark.createDataFrame([("m", i, *r) for i, r in enumerate(rows)], CUE)


def times(df, *more):
    return [tuple(r) for r in df.orderBy("start_time", "end_time").select("start_time", "end_time", *more).collect()]


def test_timestamps(spark):
    texts = ["00:01:02.345", "01:02.345", "62.345", "00:01:02,345", "-1", "00:61:00", "1:2:3", None, "x"]
    assert column(spark, texts, "string", C.parse_timestamp) == [62.345, 62.345, 62.345, 62.345, None, None, 3723.0, None, None]
    assert column(spark, [1.2, 3661.0005, -1.0, float("nan"), 360000.0], "double", C.srt_timestamp) == [
        "00:00:01,200", "01:01:01,001", "00:00:00,000", "00:00:00,000", "100:00:00,000",
    ]
    assert column(spark, [-0.5, 0.5, 1.0005], "double", lambda x: C.rounded(x, 0)) == [0.0, 1.0, 1.0]


def test_text(spark):
    assert column(spark, ["a  b \r\n\r\n c  "], "string", T.normalise_lines) == ["a b\nc"]
    wrapped = column(spark, ["The ferry to the northern islands leaves at a quarter past nine", "brief"], "string", lambda x: T.wrap(x, 42))
    assert " ".join(wrapped[0].split("\n")) == "The ferry to the northern islands leaves at a quarter past nine" and wrapped[1] == "brief"
    assert max(map(len, wrapped[0].split("\n"))) <= 42
    assert column(spark, [["Rain", ",", "Ana", "'s", "(", "roof", ")"]], "array<string>", T.glue) == ["Rain, Ana's (roof)"]
    assert column(spark, ["a🙂"], "string", T.utf16_length) == [3]
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "b", "c", "d"]), ([], [])], "a array<string>, b array<string>")
    got = df.select(T.token_similarity(F.col("a"), F.col("b")), T.dice(F.col("a"), F.col("b")), T.token_distance(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 4 / 7, 3), (1.0, 1.0, 0)]


def test_writers(spark):
    one = table(spark, [(1.2, 3.85, "A lamp burned in the harbour.")])
    assert cues.to_srt(one).first()["content"] == "1\n00:00:01,200 --> 00:00:03,850\nA lamp burned in the harbour.\n"
    assert cues.to_vtt(one).first()["content"].startswith("WEBVTT\n\n00:00:01.200 --> 00:00:03.850")
    two = table(spark, [(1.2, 2.4, "Open\nwater"), (3.0, 4.0, "Low tide")])
    assert cues.to_transcript(two).first()["content"] == "Open water\nLow tide"
    assert cues.to_transcript(two, True).first()["content"] == "[00:00:01.200] Open water\n[00:00:03.000] Low tide"


def test_readers(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\nworld\r\n\r\n2\nbad\n\n3\n00:00:03,000 --> nope\nx\n"
    vtt = "WEBVTT\n\nNOTE hidden\n\n00:00:03.000 --> 00:00:04.500 align:start\nA cue\n"
    df = spark.createDataFrame([("m", srt)], "media_id string, content string")
    rows = captions.parse_captions(df, "srt").orderBy("block").collect()
    assert [(r["start_time"], r["text"], r["warning"]) for r in rows] == [
        (1.0, "Hello\nworld", None), (None, None, "no timing line"), (None, None, "malformed timing"),
    ]
    assert [r["index"] for r in captions.cues(captions.parse_captions(df, "srt")).collect()] == [1]
    df = spark.createDataFrame([("m", vtt)], "media_id string, content string")
    assert [(r["start_time"], r["end_time"], r["text"]) for r in captions.cues(captions.parse_captions(df, "vtt")).collect()] == [(3.0, 4.5, "A cue")]


def test_round_trip_files(spark, tmp_path):
    for name, text in (("a.srt", "1\n00:00:01,000 --> 00:00:02,000\nx\n"), ("b.srt", "1\n00:00:05,000 --> 00:00:06,000\ny\n")):
        (tmp_path / name).write_text(text)
    got = captions.read_captions(spark, f"file://{tmp_path}", "srt").orderBy("media_id").collect()
    assert [(r["media_id"], r["start_time"]) for r in got] == [("a", 1.0), ("b", 5.0)]


def test_projects(spark):
    rows = table(spark, [(1.0, 2.0, "a"), (3.0, 4.0, "b")]).withColumn("index", (F.col("ord") + 1).cast("int"))
    docs = captions.project_documents(rows, "own")
    back = captions.project_cues(captions.parse_projects(docs, "own"))
    assert times(back, "text", "id") == [(1.0, 2.0, "a", "imported-1"), (3.0, 4.0, "b", "imported-2")]
    bad = spark.createDataFrame([("m", "nonsense"), ("n", '{"metadata":{"appName":"other","schemaVersion":2}}')], "media_id string, content string")
    assert [len(r["errors"]) > 0 for r in captions.parse_projects(bad, "own").collect()] == [True, True]


def test_wav():
    x = (np.sin(np.arange(100)) * 1000).astype("<i2")
    data = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\x01\0\x01\0\x80\x3e\0\0\0\x7d\0\0\x02\0\x10\0data" + len(x.tobytes()).to_bytes(4, "little") + x.tobytes()
    samples, rate = audio.decode_wav(data)
    assert rate == 16000 and np.allclose(samples, x / 32768)
    with pytest.raises(ValueError):
        audio.decode_wav(b"nothing at all")


def test_validate_and_export(spark):
    df = table(spark, [(1.0, 3.0, "a"), (2.5, 4.0, "b"), (6.0, 5.0, "c"), (8.0, 9.0, " "), (10.0, 11.0, "ok")])
    found = {(r["ord"], r["code"]) for r in cues.validate(df).collect()}
    assert found == {(0, "overlap"), (1, "overlap"), (2, "invalid-range"), (3, "empty-text")}
    assert [r["ord"] for r in cues.exportable(df).collect()] == [4]
    assert cues.with_issues(df).count() == 4


def test_edits_are_of_one_media(spark):
    schema = CUE + ", speaker string, words array<struct<text:string,start_time:double,end_time:double>>"
    rows = [(m, k, float(k), k + 0.5, f"t{k}", m.upper(), [(f"t{k}", float(k), k + 0.5)]) for m in ("m", "n") for k in range(3)]
    df = spark.createDataFrame(rows, schema)
    of = lambda out, m: [(r["ord"], r["text"], r["end_time"], r["speaker"], len(r["words"]), r["index"]) for r in out.where(F.col("media_id") == m).orderBy("index").collect()]
    whole = lambda m: [(k, f"t{k}", k + 0.5, m.upper(), 1, k + 1) for k in range(3)]
    merged = cues.merge_with_next(df, "m", 1)
    assert of(merged, "m") == [(0, "t0", 0.5, "M", 1, 1), (1, "t1\nt2", 2.5, "M", 2, 2)] and of(merged, "n") == whole("n")
    assert of(cues.merge_with_next(df, "m", 2), "m") == whole("m")
    for out, own in (
        (cues.delete(df, "m", 1), [(0, "t0", 0.5, "M", 1, 1), (2, "t2", 2.5, "M", 1, 2)]),
        (cues.update(df, "m", 2, text=F.lit("new")), [*whole("m")[:2], (2, "new", 2.5, "M", 1, 3)]),
        (cues.duplicate(df, "m", 2), [*whole("m"), (2, "t2", 3.1, "M", 1, 4)]),
    ):
        assert of(out, "m") == own and of(out, "n") == whole("n")


def test_shift(spark):
    assert times(cues.shift(table(spark, [(0.1, 1.1, "a")]), -500, F.lit(10.0))) == [(0.0, 0.6)]
    schema = CUE + ", confidence double, words array<struct<text:string,start_time:double,end_time:double>>"
    df = spark.createDataFrame([("m", 0, 0.0, 4.0, "a b", 0.91, [("a", 1.0, 1.5), ("b", 2.5, 3.0)])], schema)
    row = cues.shift(df, 500, F.lit(10.0)).first()
    assert [(w["start_time"], w["end_time"]) for w in row["words"]] == [(1.5, 2.0), (3.0, 3.5)] and row["confidence"] == 0.91


def test_edits(spark):
    df = table(spark, [(0.0, 2.0, "one two three four"), (3.0, 4.0, "five")])
    at = spark.createDataFrame([(10.0, 12.0, t) for t in (10.1, 11.9, 10.099, 11.901, float("nan"))], "start_time double, end_time double, t double")
    assert [r[0] for r in at.select(cues.can_split(F.col("t"))).collect()] == [True, True, False, False, False]
    assert times(cues.split_at(df, F.lit(1.0)), "text") == [(0.0, 1.0, "one two"), (1.0, 2.0, "three four"), (3.0, 4.0, "five")]
    assert times(cues.merge_with_next(df, "m", 0), "text") == [(0.0, 4.0, "one two three four\nfive")]
    assert times(cues.duplicate(df, "m", 1)) == [(0.0, 2.0), (3.0, 4.0), (4.1, 5.1)]
    assert times(cues.replace_range(df, table(spark, [(2.5, 9.0, "new")]), 2.5, 5.0), "text") == [(0.0, 2.0, "one two three four"), (2.5, 5.0, "new")]
    assert [r["change"] for r in cues.changed_rows(df, cues.delete(df, "m", 1), ["text"]).collect()] == ["delete"]


def test_intervals(spark):
    a = table(spark, [(0.0, 1.0, ""), (0.8, 2.0, ""), (3.0, 4.0, ""), (4.0, 5.0, ""), (9.0, 8.0, "")])
    assert times(intervals.union(a, "media_id")) == [(0.0, 2.0), (3.0, 5.0)]
    b = table(spark, [(1.5, 3.5, "")])
    assert times(intervals.intersect(a, b, "media_id", 1.0)) == [(1.5, 2.0), (3.0, 3.5)]
    assert times(intervals.subtract(a, b, "media_id")) == [(0.0, 1.5), (3.5, 5.0)]
    speech, cue = table(spark, [(0.0, 3.0, "")]), table(spark, [(0.0, 0.8, "")])
    assert [tuple(round(x, 6) for x in r) for r in times(intervals.uncovered(speech, cue, "media_id"))] == [(0.9, 3.0)]
    assert times(intervals.uncovered(table(spark, [(0.0, 2.0, "")]), table(spark, [(0.0, 0.9, ""), (1.1, 2.0, "")]), "media_id")) == []


def test_interval_identities(spark):
    rng = np.random.default_rng(1)
    rows = lambda n: [(float(s), float(s + d), "") for s, d in zip(rng.uniform(0, 500, n), rng.exponential(8, n) + 0.01)]
    a, b = table(spark, rows(60)), table(spark, rows(60))
    size = lambda df: df.agg(F.sum(F.col("end_time") - F.col("start_time"))).first()[0] or 0.0
    ua = intervals.union(a, "media_id")
    assert times(intervals.union(ua, "media_id")) == times(ua)
    assert size(ua) == pytest.approx(size(intervals.intersect(a, b, "media_id", 20.0)) + size(intervals.subtract(a, b, "media_id")))


def test_nearest(spark):
    points = spark.createDataFrame([("m", 1, 5.0), ("m", 2, 9.0), ("m", 3, 30.0), ("n", 4, 1.0)], "media_id string, ord int, t double")
    targets = spark.createDataFrame([("m", 4.0), ("m", 6.0), ("m", 9.0)], "media_id string, b double")
    got = intervals.nearest(points, targets, "media_id", "t", "b", 2.0).orderBy("ord").collect()
    assert [r["nearest"] for r in got] == [4.0, 9.0, None, None]


def test_windows(spark):
    media = spark.createDataFrame([("a", 61.0), ("b", 50.0), ("c", 0.0)], "media_id string, duration double")
    got = windows.plan(media, 30, 0).where("media_id = 'a'").orderBy("win_id").collect()
    assert [(r["core_start"], r["core_end"]) for r in got] == [(0.0, 29.0), (29.0, 58.0), (58.0, 61.0)]
    got = windows.plan(media, 20, 20).where("media_id = 'b'").orderBy("win_id").collect()
    assert [r["core_end"] for r in got] == [10.0, 20.0, 30.0, 40.0, 50.0] and got[1]["slice_start"] == 5.0
    gaps = spark.createDataFrame([("a", 10.0, 12.0, 30.0)], "media_id string, start_time double, end_time double, duration double")
    assert [tuple(r)[1:] for r in windows.repair_windows(gaps).collect()] == [(10.0, 12.0, 9.25, 12.75)]
    gaps = spark.createDataFrame([("a", 0.0, 65.0, 70.0)], gaps.schema)
    got = windows.repair_windows(gaps).collect()
    assert len(got) == 3 and all(r["slice_end"] - r["slice_start"] <= 29 + 1e-9 for r in got)


def test_ownership(spark):
    w = spark.createDataFrame([("m", 0, 0.0, 30.0, 0.0, 31.0), ("m", 1, 30.0, 60.0, 25.0, 61.0)], "media_id string, win_id int, core_start double, core_end double, slice_start double, slice_end double")
    chunks = spark.createDataFrame([("m", 1, 0.5, 2.0), ("m", 0, 29.6, 30.4), ("m", 1, 4.0, 6.0)], "media_id string, win_id int, start_time double, end_time double")
    assert times(windows.owned(chunks, w), "from_context") == [(29.6, 30.4, False), (30.0, 31.0, True)]


def test_speech_regions():
    def audio_(seconds, spans, level):
        x = np.zeros(int(seconds * 16000), np.float32)
        for s, e in spans:
            a, b = int(s * 16000), int(e * 16000)
            x[a:b] = np.where(np.arange(a, b) % 2 == 0, level, -level)
        return x

    assert windows.speech_regions(audio_(2, [], 0)) == []
    (r,) = windows.speech_regions(audio_(3, [(1, 2)], 0.08))
    assert r["start_time"] == pytest.approx(0.8, abs=0.06) and r["end_time"] == pytest.approx(2.3, abs=0.06) and r["average_rms"] > 0.05
    x = np.sin(np.arange(32000) * 0.017).astype(np.float32)
    direct = [np.sqrt(np.mean(x[k * 160 : k * 160 + 480].astype(float) ** 2)) for k in (0, 1, 37, 199)]
    assert np.allclose(windows.rolling_rms(x, 480, 160)[[0, 1, 37, 199]], direct, atol=1e-6)


def test_pack(spark):
    regions = spark.createDataFrame([("m", 0.0, 70.0, 70.0)], "media_id string, start_time double, end_time double, duration double")
    got = windows.pack(regions).orderBy("win_id").collect()
    assert got[0]["core_end"] == 23.0 and got[-1]["core_end"] == 70.0 and all(r["slice_end"] - r["slice_start"] <= 29 + 1e-9 for r in got)


def test_folds(spark):
    rows = [{"start_time": s, "end_time": e, "text": t, "ord": i} for i, (s, e, t) in enumerate([(0.0, 1.0, "a"), (0.5, 1.2, "b"), (5.0, 9.0, "c")])]
    out = folds.pushed_apart(rows)
    assert [(r["start_time"], r["end_time"]) for r in out] == [(0.0, 1.1), (1.18, 2.28), (5.0, 9.0)]
    df = folds.fold(table(spark, [(0.0, 1.0, "a"), (0.5, 1.2, "b")]), folds.pushed_apart)
    assert times(df) == [(0.0, 1.1), (1.18, 2.28)]
    same = [{"start_time": s, "end_time": e, "text": "the same words again"} for s, e in ((0.0, 2.5), (2.0, 4.0))]
    assert [(r["start_time"], r["end_time"]) for r in folds.without_repeats(same)] == [(0.0, 4.0)]
    near = folds.spaced([{"start_time": 0.0, "end_time": 1.0}, {"start_time": 1.05, "end_time": 2.0}])
    assert near[1]["start_time"] - near[0]["end_time"] == pytest.approx(0.08)


def test_reconcile():
    seg = lambda s, e, t: {"start_time": s, "end_time": e, "text": t}
    out = folds.reconciled([seg(23, 26.2, "The ferry leaves at nine")], [seg(25.4, 27, "The ferry leaves at nine.")], 26)
    assert [r["text"] for r in out] == ["The ferry leaves at nine."]
    out = folds.reconciled([seg(23, 26, "The old ferry leaves tonight")], [seg(25.5, 26.2, "leaves tonight with all crew")], 26)
    assert [r["text"] for r in out] == ["The old ferry leaves tonight", "with all crew"] and out[1]["start_time"] >= out[0]["end_time"]
    out = folds.reconciled([seg(0, 1, "far away")], [seg(20, 21, "far away")], 20)
    assert len(out) == 2


def test_alignment(spark):
    ops = metrics.align("oak elm ash".split(), "oak elm fir ash".split())
    assert [o for o, _, _ in ops] == ["equal", "equal", "insert", "equal"]
    df = spark.createDataFrame([("a", "oak elm ash".split(), "oak elm fir ash".split()), ("b", [], ["x"])], "case_id string, r array<string>, c array<string>")
    got = metrics.word_errors(df, "case_id", "r", "c").orderBy("case_id").collect()
    assert (got[0]["insertions"], got[0]["wer"], got[1]["wer"]) == (1, 0.333333, None)
    assert metrics.matched_cues([{"tokens": ["a", "b"]}, {"tokens": ["c"]}], [{"tokens": ["a", "b", "x"]}, {"tokens": ["c"]}]) == [(0, 0), (1, 1)]


def test_alignment_costs_least():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 25))] for _ in range(2))
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j - 1] + (a[i - 1] != b[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
        want, i, j = [], len(a), len(b)
        while i or j:  # a pair first, then a deletion, then an insertion
            if i and j and table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                want.append(("equal" if a[i] == b[j] else "substitute", i, j))
            elif i and table[i][j] == table[i - 1][j] + 1:
                i -= 1
                want.append(("delete", i, None))
            else:
                j -= 1
                want.append(("insert", None, j))
        assert metrics.align(a, b) == want[::-1]


def test_alignment_of_long_texts():
    rng = random.Random(2)
    a = [str(rng.randrange(500)) for _ in range(6000)]
    b = [x for x in a if rng.random() > 0.01]
    ops = metrics.align(a, b)
    assert sum(o == "delete" for o, _, _ in ops) == len(a) - len(b) and sum(o != "equal" for o, _, _ in ops) == len(a) - len(b)


def test_repeated_phrases(spark):
    rng = random.Random(3)
    cases = [[], ["a"], ["a", "b", "a", "b", "c"], None, ["a"] * 13] + [[rng.choice("ab") for _ in range(rng.randrange(30))] for _ in range(80)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k long, t array<string>")
    got = {r["k"]: r["x"] for r in df.select("k", metrics.repeated_phrases(F.col("t")).alias("x")).collect()}
    for k, c in enumerate(cases):
        text, times, said = "".join(c or []), 0, 0
        while c and len(text) > 2:  # what is left to hear, with up to 5 tokens before it
            heard = "".join(c)[: len(c) - len(text)]
            sizes = [n for n in (5, 4, 3, 2) if len(heard) >= n and text.startswith(heard[-n:])]
            times, said, text = (times + 1, said + sizes[0], text[sizes[0] :]) if sizes else (times, said, text[1:])
        if c and len(text) == 2 and "".join(c)[:-2].endswith(text):
            times, said = times + 1, said + 2
        assert (got[k] and (got[k]["times"], got[k]["said"])) == (None if c is None else (times, said)), c


def test_quality(spark):
    df = table(spark, [(0.0, 1.0, "x" * 30), (2.0, 12.0, "y" * 43)])
    row = metrics.quality(df, most=6.0).first()
    assert (row["fast"], row["wide"], row["long"], row["invalid"]) == (1, 1, 1, 0)
