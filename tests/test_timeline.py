from pyspark.sql import functions as F

from cuelake.operators import preview, timeline


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_snap(spark):
    cues = spark.createDataFrame([("m", 1, 1.0, 2.03), ("m", 2, 4.2, 5.0)], "media_id string, ord long, start_time double, end_time double")
    t = timeline.with_ends(F.col("targets"), F.lit(3.0), F.lit(10.0), F.lit(2))
    at = lambda x: timeline.snap(F.lit(x), t, F.lit(100.0)).alias(str(x).replace(".", "_"))
    row = timeline.targets(cues).select(at(2.1), at(2.97), at(4.21), at(6.52), at(9.95), at(7.3)).first()
    assert tuple(row) == (2.03, 3.0, 4.21, 6.5, 10.0, 7.3)


def test_moved(spark):
    t = F.array(F.struct(F.lit(5.0).alias("time"), F.lit(250).alias("priority"), F.lit(None).cast("bigint").alias("ord")))
    row = one(spark, a=timeline.moved(F.lit(1.0), F.lit(2.2), F.lit(2.75), t, F.lit(100.0), F.lit(10.0)), b=timeline.resized(F.lit(1.0), F.lit(2.0), "start", F.lit(4.0), t, F.lit(100.0), F.lit(10.0)))
    assert tuple(row["a"]) == (3.8, 5.0) and tuple(row["b"]) == (1.9, 2.0)


def cue(name, s, e, t):
    return {"id": name, "start_time": s, "end_time": e, "text": t}


def test_preview_keeps_edits():
    gen = lambda *rows: [{"start_time": s, "end_time": e, "text": t} for s, e, t in rows]
    rows, state = preview.merged([cue("base", 0, 9, "old")], gen((0, 1, "opening"), (3, 4, "keep this edit")), preview.Preview(base=frozenset({"base"})))
    assert [r["text"] for r in rows] == ["opening", "keep this edit"]
    edited = [dict(r) for r in rows]
    edited[1]["text"] = "edited by user"
    state = preview.mark_edits(rows, edited, state)
    rows, state = preview.merged(edited, gen((0, 1, "opening"), (1.5, 2.2, "recovered words"), (3, 4, "keep this edit")), state)
    assert [r["text"] for r in rows] == ["opening", "recovered words", "edited by user"] and rows[2]["id"] == edited[1]["id"]
    state = preview.mark_edits(rows, rows[1:], state)
    rows, _ = preview.merged(rows[1:], gen((0, 1, "opening"), (1.5, 2.2, "recovered words")), state)
    assert [r["text"] for r in rows] == ["recovered words", "edited by user"]


def test_history():
    h = preview.History([1])
    h.commit([2])
    h.commit([2])
    h.commit([3])
    h.undo()
    assert h.present == [2] and h.past == [[1]]
    h.redo()
    assert h.present == [3]
    h.begin("t")
    assert not h.update("stale", [9]) and h.update("t", [4]) and h.finish("t") and h.present == [4]
