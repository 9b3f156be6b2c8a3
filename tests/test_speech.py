"""Speech queries on odd events, against their SQL or brute force: long cues, no media, the same cue twice, borders that meet."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from cuelake.operators import intervals, metrics
from cuelake.plans import catalog

CUE = "media_id long, ord long, start_time double, end_time double"


def events(seed=3, n=400, longest=9e11):
    rng = random.Random(seed)
    kinds, users = ["view", "click", "purchase", "signup", "error"], [*range(6), None]
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 9000)), rng.choice(users), rng.choice(kinds), rng.randint(-1, 12) / 4) for k in range(n)]
    rows += [(n, datetime(2024, 1, 1, 1), 7, "view", longest / 300), (n + 1, datetime(2024, 1, 1, 2), 7, "signup", longest / 300)]  # no table of buckets holds these
    return rows + [rows[k] for k in range(0, n, 9)]


@pytest.fixture()
def both(spark, tmp_path):
    def run(name, rows):
        df = spark.createDataFrame([(k, t, u, e, float(v), "{}") for k, t, u, e, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/events.parquet")
        found = catalog.QUERIES[name](spark, f"file://{tmp_path}")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        result = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in result.description]
        plain = lambda x: None if x is None else round(float(x), 3)
        return tuple(sorted(([plain(r[names.index(c)]) for c in found.columns] for r in rows), key=str) for rows in ([tuple(r[c] for c in names) for r in found.collect()], result.fetchall()))

    return run


def union(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def shared(s, e, regions):
    return sum(max(0.0, min(e, b) - max(s, a)) for a, b in regions)


@pytest.mark.parametrize("name", ["missed_speech", "suite_speech", "interval_intersect", "interval_subtract"])
def test_sql(both, name):
    got, want = both(name, events())
    assert got == want and len(want) > 5


def test_shared_seconds_by_brute_force(spark):
    rng = random.Random(8)
    made = lambda n: [(k % 4, k, float(s := rng.randint(0, 300)), float(s + rng.randint(0, 25))) for k in range(n)]
    cues, speech = made(300), made(60)
    found = intervals.shared_seconds(spark.createDataFrame(cues, CUE), spark.createDataFrame(speech, CUE), "media_id").collect()
    regions = {m: union((s, e) for x, _, s, e in speech if x == m and e > s) for m in range(4)}
    assert {r["ord"]: r["shared"] for r in found} == {k: shared(s, e, regions[m]) for m, k, s, e in cues if e > s}


def test_speech_coverage_of_a_long_cue(spark):
    df = lambda *rows: spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], CUE)
    (r,) = metrics.speech_coverage(df((0.0, 9e11)), df((1.0, 3e11), (9.5e11, 9.6e11))).collect()
    assert (r["speech"], r["covered"], r["over_silence"], r["mostly_silent"]) == (9e11, 3e11 - 1, 1e10, 1)


def test_speech_coverage_by_brute_force(spark):
    rng = random.Random(17)
    made = lambda n, long, ids: [(rng.choice([0, 1, 2, 3, None]), rng.choice(ids), s := rng.randint(-8, 1200) / 4, s + rng.choice([-1, 0, 1, 2, 8, long]) / 4) for _ in range(n)]
    speech, cues = made(160, 30, range(9)), made(240, 400, [*range(120), None])  # cues share ids, have none, and are over many regions
    speech, cues = [*speech, (5, 1, 0.0, 2.0)], [*cues, *cues[::7], (4, 1, 1.0, 2.0)]
    whole = lambda rows, m: [(s, e) for x, _, s, e in rows if x == m and 0 <= s < e]
    want = set()
    for m in [*range(6), None]:
        a, b = union(whole(speech, m)), union(whole(cues, m))
        long = lambda rows: sum(e - s for s, e in rows)
        if m is None:
            want |= {(None, long(a), 0.0, long(a), 0.0, 0), (None, 0.0, 0.0, 0.0, long(b), 0)}
            continue
        ids = {}
        for x, k, s, e in cues:
            if x == m and 0 <= s < e:
                ids.setdefault(k, []).append((s, e))
        ids = {k: v for k, v in ids.items() if len({e - s for s, e in v}) == 1}  # of several lengths any counts
        cues = [r for r in cues if r[0] != m or r[1] in ids]
        b = union(whole(cues, m))
        both = sum(shared(s, e, b) for s, e in a)
        silent = sum(sum(shared(s, e, a) for s, e in v) / (v[0][1] - v[0][0]) < 0.5 for v in ids.values())
        want.add((m, long(a), both, long(a) - both, long(b) - both, silent))
    found = metrics.speech_coverage(spark.createDataFrame(speech, CUE), spark.createDataFrame(cues, CUE))
    names = ("media_id", "speech", "covered", "missed", "over_silence", "mostly_silent")
    assert {tuple(r[c] for c in names) for r in found.collect()} == want and sum(r[-1] for r in want) > 20


def test_suite_speech_is_one_shuffle_of_borders(spark, tmp_path):
    df = spark.createDataFrame([(k, t, u, e, float(v), "{}") for k, t, u, e, v in events()], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"file://{tmp_path}/events.parquet")
    plan = catalog.QUERIES["suite_speech"](spark, f"file://{tmp_path}")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 2
    found = catalog.QUERIES["suite_speech"](spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert found.count("Exchange hashpartitioning") == 2 and found.count("- Sort [") == 1


def test_uncovered_speech_by_brute_force(spark):
    rng = random.Random(11)
    made = lambda n, long: [(rng.choice([0, 1, 2, None]), k, float(s := rng.randint(0, 400)), s + rng.randint(-4, long) / 4) for k in range(n)]
    speech, cues = made(90, 60), made(120, 30)
    speech, cues = [*speech, (3, 90, 5.0, 9e11)], [*cues, (3, 120, 100.0, 200.0), (3, 121, 6e11, 8e11)]
    want = []
    for m in range(4):
        regions = union((s, e) for x, _, s, e in speech if x == m and e > s)
        heard = union((s, e) for x, _, s, e in cues if x == m and e > s)
        wide = union((max(0.0, max(a, s) - 0.1), min(b, e) + 0.1) for a, b in regions for s, e in heard if max(a, s) < min(b, e))
        for a, b in regions:
            cuts = [a, *(t for s, e in wide if s < b and e > a for t in (s, e)), b]
            gaps = [(s, e) for s, e in zip(cuts[::2], cuts[1::2]) if e - s >= 0.25]
            if gaps and (sum(e - s for s, e in gaps) >= 0.4 * (b - a) or max(e - s for s, e in gaps) >= 2.0):
                want += [(m, s, e) for s, e in gaps if e - s >= 0.5]
    df = lambda rows: spark.createDataFrame(rows, CUE)
    assert sorted(map(tuple, intervals.uncovered(df(speech), df(cues), "media_id").collect())) == sorted(want) and len(want) > 40
