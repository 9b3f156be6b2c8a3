import json
from datetime import datetime, timedelta

from cuelake.streaming import partials

START = datetime(2024, 1, 1)


def run(spark, tmp_path, rows, schema, fn, name):
    """Each list of rows is a file and a micro-batch of the stream."""
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k:03d}"))
    stream = spark.readStream.schema(spark.createDataFrame(rows[0], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = fn(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [r.asDict() for r in spark.table(name).collect()]


def test_deltas(spark, tmp_path):
    schema = "media_id string, version long, segments string, at timestamp"
    snap = lambda v, texts: ("m", v, json.dumps(texts), START + timedelta(seconds=v))
    got = run(spark, tmp_path, [[snap(1, ["a", "b"]), snap(2, ["a", "c", "d"])], [snap(2, ["late"]), snap(3, ["a", "c"])]], schema, lambda s: partials.suffix_deltas(s, "at"), "deltas")
    now = []
    for r in sorted(got, key=lambda r: r["version"]):
        now = partials.apply_delta(now, r["replace_from"], r["total"], json.loads(r["segments"]))
    assert [r["version"] for r in sorted(got, key=lambda r: r["version"])] == [1, 2, 3] and now == ["a", "c"]


def test_reconciled(spark, tmp_path):
    seg = lambda s, e, t: {"start_time": s, "end_time": e, "text": t}
    schema = "media_id string, win_id long, core_start double, segments string, at timestamp"
    one = ("m", 0, 0.0, json.dumps([seg(0, 2, "first one"), seg(3, 5, "second one"), seg(6, 8, "third"), seg(23, 26, "The old ferry leaves tonight")]), START)
    two = ("m", 1, 26.0, json.dumps([seg(25.5, 26.2, "leaves tonight with all crew"), seg(30, 31, "end")]), START)
    end = ("other", 0, 0.0, "[]", START + timedelta(hours=2))
    got = run(spark, tmp_path, [[two], [one], [end], [end]], schema, lambda s: partials.reconciled_stream(s, "at"), "reconciled")
    texts = [r["text"] for r in sorted(got, key=lambda r: r["start_time"])]
    assert texts == ["first one", "second one", "third", "The old ferry leaves tonight", "with all crew", "end"]


def test_windows(spark, tmp_path):
    schema = "user string, at timestamp"
    rows = [("u", START + timedelta(seconds=s)) for s in (1, 5, 65, 400)]
    got = run(spark, tmp_path, [rows, [("u", START + timedelta(hours=1))]], schema, lambda s: partials.counts_by_window(s, "at", "user", "1 minute"), "tumbling")
    assert sorted(r["n"] for r in got)[-1] == 2 and len(got) >= 3
