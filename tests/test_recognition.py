from pyspark.sql import functions as F

from cuelake.operators import recognition

CHUNK = "array<struct<text:string,start_time:double,end_time:double>>"
SCHEMA = (
    f"media_id string, win_id long, text string, chunks {CHUNK}, by_word boolean, shift double, core_start double, core_end double, keep_suffix boolean, "
    "regions array<struct<start_time:double,end_time:double>>"
)
NAN = float("nan")


def found(spark, *rows):
    df = spark.createDataFrame([("m", k, *r) for k, r in enumerate(rows)], SCHEMA)
    out: dict[int, list] = {k: [] for k in range(len(rows))}
    for r in recognition.segments(df).orderBy("win_id", "ord").collect():
        out[r["win_id"]].append((r["start_time"], r["end_time"], r["text"], r["crosses"], r["confidence"], r["words"] and [tuple(w) for w in r["words"]]))
    return list(out.values())


def test_segments_of_a_window(spark):
    chunks = [(" before", 1.0, 4.9), ("tail", 2.0, 5.4), ("crossing ", 3.0, 6.0), ("own", 7.0, 9.0), ("next", 15.0, 16.0), ("", 8.0, 9.0), ("odd", NAN, 3.0), ("none", None, 3.0), ("back", 9.0, 8.0), (None, 1.0, 2.0)]
    keep, drop = found(spark, ("", chunks, False, 100.0, 105.0, 115.0, True, None), ("", chunks, False, 100.0, 105.0, 115.0, False, None))
    own = (107.0, 109.0, "own", False, None, None)
    assert keep == [(105.0, 106.0, "crossing", True, None, None), own] and drop == [own]


def test_words_of_a_window(spark):
    words = [("Late", 3.0, 3.5), ("out", 0.2, 0.9), (",", 3.5, 3.6), ("rain", 4.0, 4.4)]
    (got,) = found(spark, ("", words, True, 10.0, 11.0, None, True, None))
    assert got == [(13.0, 14.4, "Late, rain", False, None, [("Late", 13.0, 13.5), (",", 13.5, 13.6), ("rain", 14.0, 14.4)])]


def test_text_without_times(spark):
    text, none = " rain at last ", []
    got = found(
        spark,
        (text, none, False, 0.0, 10.0, 30.0, False, [(8.0, 12.0), (11.5, 14.0), (20.0, 20.3)]),  # one piece of speech, cut to the core
        (text, None, False, 0.0, 10.0, None, False, [(12.0, 40.0)]),  # eight seconds at most
        (text, none, False, 0.0, 10.0, 30.0, False, [(11.0, 12.0), (14.0, 15.0)]),  # two pieces
        (text, none, False, 0.0, 10.0, 30.0, False, []),
        (" ... ", none, False, 0.0, 10.0, 30.0, False, [(11.0, 12.0)]),
        (text, [("x", 50.0, 51.0)], False, 0.0, 10.0, 30.0, False, [(11.0, 12.0)]),  # chunks of another window
        (None, none, True, None, None, None, None, None),
    )
    one = lambda a, b: [(a, b, "rain at last", False, 0.35, None)]
    assert got == [one(10.0, 14.0), one(12.0, 20.0), [], [], [], [], []]


def test_no_rows(spark):
    assert recognition.segments(spark.createDataFrame([], SCHEMA).withColumn("x", F.lit(1))).count() == 0
