"""References of op7 learnt from documents, and both distances, against brute force."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from cuelake.llm import quality_divergence as Q

DOCS = "doc_id long, text string, lang string"


def shares(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    kinds = Counter()
    for c in "".join(w):
        kinds["lower" if unicodedata.category(c) == "Ll" else "symbol" if c in "#*$%&|<>" else "upper" if unicodedata.category(c) == "Lu" else "point" if c in ".,;:!?'\"()-" else "digit" if c in "0123456789" else "other"] += 1
    n = sum(kinds.values())
    return w, {k: kinds[k] / n for k in Q.CLASSES} if n else None


def distance(p, q):
    twice = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q))
    return math.sqrt(max(0.0, twice / 2))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    say = lambda pool, n: " ".join(rng.choice(pool) for _ in range(n))
    english = [say([*Q.COMMON["en"] * 2, "Stone", "river,", "walks", "1999"], rng.randint(70, 200)) for _ in range(60)]
    kana = ["".join(chr(0x3042 + rng.randrange(60)) for _ in range(4)) for _ in range(300)]
    japanese = [say(kana, 120) for _ in range(5)]
    odd = [None, "", " \t", "the", say(["of#%", "a|"], 120), say(kana, 90)]
    rows = [(t, "en") for t in english] + [(t, "ja") for t in japanese] + [(t, "xx") for t in odd] + [(english[0], None), (japanese[0], None), (japanese[0], "en")]
    return [(i, t, k) for i, (t, k) in enumerate(rows)]


def test_references_and_distances(spark, texts):
    df = spark.createDataFrame(texts, DOCS)
    refs = Q.learnt(df)
    taught = {}
    for _, t, k in texts:
        w, c = shares(t)
        if k and len(w) >= 80 and c["symbol"] <= Q.MOST_SYMBOLS:
            taught.setdefault(k, []).append((Counter(w), len(w), c))
    assert set(refs.classes) == {"en", "fr", "de", "es", "ja", "xx"} and set(refs.words) == set(Q.COMMON)
    for k, got in refs.classes.items():
        docs, weight = taught.get(k, []), Q.PRIOR if k in Q.COMMON else 0
        for c, q in got.items():
            assert q == pytest.approx((sum(d[2][c] for d in docs) + weight * Q.CLASSES[c]) / (len(docs) + weight), abs=2e-6)
    for w, q in refs.words["en"].items():
        docs = taught["en"]
        assert q == pytest.approx((sum(d[0][w] / d[1] for d in docs) + Q.PRIOR * Q.fixed_words("en")[w]) / (len(docs) + Q.PRIOR), abs=2e-6)
    rows = {r["doc_id"]: r for r in Q.judge(df, lang="lang", references=refs).collect()}
    for i, t, k in texts:
        w, c = shares(t)
        if not w:
            assert rows[i]["class_distance"] is None and rows[i]["word_distance"] is None and not rows[i]["kept"]
            continue
        by_class = {x: distance(c.values(), [refs.classes[x][y] for y in Q.CLASSES]) for x in refs.classes}
        assert rows[i]["class_distance"] == pytest.approx(by_class[k] if k else min(by_class[x] for x in Q.COMMON), abs=1e-9)
        if k in ("ja", "xx"):
            assert rows[i]["word_distance"] is None and rows[i]["nearest_lang"] is None
            continue
        near = {}
        for x in Q.COMMON:
            p = [w.count(y) / len(w) for y in Q.COMMON[x]]
            q = [refs.words[x][y] for y in Q.COMMON[x]]
            near[x] = distance([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        assert rows[i]["word_distance"] == pytest.approx(min(near.values()), abs=1e-7)


def test_languages_without_a_word_list_are_not_judged_by_words(spark, texts):
    df = spark.createDataFrame(texts, DOCS)
    rows = {r["doc_id"]: r for r in Q.judge(df, lang="lang", references=Q.learnt(df)).collect()}
    assert all(rows[i]["kept"] for i, _, k in texts if k == "ja")
    assert not rows[len(texts) - 1]["kept"]  # Japanese that is called English


def test_empty_table_has_the_fixed_references(spark):
    assert Q.learnt(spark.createDataFrame([], DOCS)) == Q.References()


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_LANGUAGES", 2)
    df = spark.createDataFrame([(i, "word " * 90, f"l{i}") for i in range(3)], DOCS)
    with pytest.raises(ValueError, match="languages"):
        Q.learnt(df)
