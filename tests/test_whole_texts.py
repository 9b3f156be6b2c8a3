"""Queries over conversations take whole texts of any script: brute force on a small table."""

import pytest

from cuelake.plans import catalog


@pytest.fixture()
def run(spark, tmp_path):
    def rows(name, turns):
        spark.createDataFrame([("c", i, t) for i, t in enumerate(turns)], "conv_id string, turn long, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
        return catalog.QUERIES[name](spark, f"file://{tmp_path}").collect()

    return rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


LONG = " ".join(f"w{k % 37}" for k in range(90))
TURNS = [LONG, LONG + " \u00e9t\u00e9 fin", "\u00e9t\u00e9 " + LONG.replace("w3", "v"), None, "fin"]


def test_word_error_rate(run):
    got = {r["case_id"]: r for r in run("word_error_rate", TURNS)}
    assert sorted(got) == ["c-0", "c-1"]
    for k in range(2):
        a, b, r = TURNS[k].split(), TURNS[k + 1].split(), got[f"c-{k}"]
        assert r["words"] == len(a) and r["substitutions"] + r["deletions"] + r["insertions"] == distance(a, b)
        assert r["wer"] == pytest.approx(distance(a, b) / len(a), abs=1e-6)


def test_char_error_rate(run):
    got = {r["turn"]: r for r in run("char_error_rate", TURNS)}
    assert sorted(got) == [0, 1]
    for k, r in got.items():
        want = distance(TURNS[k], TURNS[k + 1])
        assert r["distance"] == want and r["cer"] == pytest.approx(want / len(TURNS[k]), abs=1e-6)


def test_wrapped_lines(run):
    got = {r["turn"]: r["wrapped"] for r in run("wrapped_lines", ["one\ntwo", LONG, None])}
    w = LONG.split()
    assert got == {0: "one two", 1: " ".join(w[:45]) + "\n" + " ".join(w[45:])}


def test_turns_beyond_ascii(run, tmp_path, spark):
    got = run("norm_text", ["\u00c9t\u00e9, \u00e9t\u00e9!", "a \u00e9t\u00e9", "\u00e9t\u00e9 \u00c9T\u00c9", None])
    assert {r["turn"]: r["norm"] for r in got} == {0: "\u00e9t\u00e9 \u00e9t\u00e9", 1: "a \u00e9t\u00e9", 2: "\u00e9t\u00e9 \u00e9t\u00e9"}
    rows = lambda name: catalog.QUERIES[name](spark, f"file://{tmp_path}").collect()
    assert sorted(r["turn"] for r in rows("distinct_candidates")) == [0, 1]
    assert {r["turn"]: (r["token_similarity"], r["dice"]) for r in rows("token_similarity")} == {0: (0.5, 0.5), 1: (0.5, 0.5)}
    assert {r["turn"]: r["repeats"] for r in rows("adjacent_repeats")} == {0: 1, 1: 0, 2: 1}


def test_dominant_repetition(run):
    got = {r["turn"]: r["repetition"] for r in run("dominant_repetition", [" ".join(f"x{k}" for k in range(410)) + " a b" * 150, LONG[:40]])}
    assert got[0] is not None and got[0]["share"] >= 0.3 and got[1] is None


def test_phrase_repeats_of_long_turns(run, spark, tmp_path):
    words = [f"w{k}" for k in range(8000)]
    twice = words[:5000] + words[4996:]  # four words are said again
    got = {r["turn"]: (r["times"], r["said"]) for r in run("phrase_repeats", [" ".join(words), " ".join(twice), "Yes, no. Yes no!", None, ""])}
    assert got == {0: (0, 0), 1: (1, 4), 2: (1, 2), 4: (0, 0)}
    plan = catalog.QUERIES["phrase_repeats"](spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # the words are made once a turn, not once a place
