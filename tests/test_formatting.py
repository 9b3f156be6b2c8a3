from cuelake.operators import formatting as F


def seg(s, e, t, **more):
    return {"start_time": s, "end_time": e, "text": t, **more}


def test_pause_is_kept_and_fragment_joined():
    out = F.formatted([seg(0, 0.25, "Tonight,"), seg(0.8, 2, "the harbour pilots all stay ashore.")])
    assert len(out) == 2 and out[1]["start_time"] - out[0]["end_time"] >= 0.349
    out = F.formatted([seg(0, 0.25, "Tonight,"), seg(0.4, 2, "it rains.")])
    assert [r["text"] for r in out] == ["Tonight, it rains."]


def test_word_times():
    words = [{"text": t, "start_time": s, "end_time": e} for t, s, e in (("Rain", 1, 1.35), ("falls", 1.42, 1.85), ("today", 2.05, 2.4))]
    (r,) = F.formatted([seg(0, 8, "Rain falls today", words=words)])
    assert abs(r["start_time"] - 0.92) < 0.01 and abs(r["end_time"] - 2.58) < 0.01


def test_low_confidence():
    (r,) = F.formatted([seg(1, 1.4, "Perhaps", confidence=0.35)])
    assert (r["start_time"], r["end_time"], r["text"]) == (1, 1.4, "Perhaps")
    assert F.formatted([seg(1, 1.4, "far too many words for so short a time", confidence=0.35)]) == []


def test_repeats():
    assert len(F.formatted([seg(0, 2.5, "snow on every roof"), seg(2, 4, "snow on every roof")])) == 1


def test_no_word_is_lost():
    p = F.Preferences(line=24, cue=48, shortest=0.25, longest=2, top_speed=100)
    text = " ".join(f"word{i}." for i in range(700))
    out = F.formatted([seg(0, 700, text)], p)
    assert " ".join(" ".join(r["text"].split()) for r in out) == text
    assert all(r["end_time"] - r["start_time"] <= 2.001 for r in out)
    assert all(len(x) <= 24 for r in out for x in r["text"].split("\n"))
    assert all(a["end_time"] <= b["start_time"] for a, b in zip(out, out[1:]))


def test_in_spark(spark):
    df = spark.createDataFrame([("m", 0, 0.0, 0.25, "Tonight,"), ("m", 1, 0.4, 2.0, "it rains.")], "media_id string, ord long, start_time double, end_time double, text string")
    assert [r["text"] for r in F.format_captions(df).collect()] == ["Tonight, it rains."]
