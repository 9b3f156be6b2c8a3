import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_duplicates", "decontamination", "bpe"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {r[0] for r in out.select("doc_id").collect()}
    assert 100 < len(ids) < docs.count() and ids <= {r[0] for r in docs.select("doc_id").collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "rejected", "predicted", "_result", "component_id", "row_id", "cls", "doc", "item_id", "key", "a.b")


def stages(spark, folder, rows, labels=(), items=()):
    """What each of the first four stages keeps: (doc_id, text) of rows, in order."""
    for name, data, schema in (("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(list(data), schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        found.write.mode("overwrite").parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        assert docs.where("`a.b` = 'clash' and score = 'clash'").count() == docs.count()
        out.append(sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str))
    return out


def test_what_stages_remove(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [a + b for a in "stone river field tower garden window silver morning".split() for b in ["", "ing", "ed", "er", "s", "less", "ful"]]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bad = ["blockhead", "nitwit", "dunderpate"]
    rows, labels = [], []
    for i in range(300):
        words = prose(40).split()
        for _ in range(3 * (i % 5 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    item, base = prose(20), prose(120)
    leak = f"{prose(30)} {item} {prose(30)}"
    odd = [(1000, None), (1001, ""), (1002, "5 € — ½"), (1003, " \n")]  # no language
    near = [(2000, base), (2001, base + " more"), (2002, "extra " + base), (None, base + " again"), (2000, base)]
    leaks = [(3000, leak), (None, leak + " end"), (3001, prose(50))]
    one_id = [(4000, prose(60)), (4000, base + " of one id")]
    repeated = [(5000, t) for t in [prose(45)] * 2]
    long = [(6000, " ".join(rng.choice(["paper", "candle", "mirror", "basket", "ladder", "copper"]) for _ in range(30_000)))]
    more = odd + near + leaks + one_id + repeated + long
    steps = stages(spark, f"file://{tmp_path}", rows + [(i, t, None, None, None) for i, t in more], labels, [(1, item), (2, None), (3, "")])
    everything = [(r[0], r[1]) for r in rows] + more
    gone = lambda k: [x for x in set(steps[k - 1] if k else everything) if x not in set(steps[k])]
    assert set(gone(0)) == set(odd)
    toxic = {(r[0], r[1]) for r in rows if r[0] % 5 == 0}
    assert len(set(gone(1)) & toxic) >= 0.9 * len(toxic) and len(set(gone(1)) - toxic) <= 5
    assert set(gone(2)) - {leaks[1]} == {near[1], near[2], near[3], one_id[1]}
    assert steps[2].count(near[0]) == 2 and steps[3].count(repeated[0]) == 2
    assert set(gone(3)) == {leaks[0]} | ({leaks[1]} - set(gone(2)))
    assert {leaks[2], one_id[0], long[0]} <= set(steps[3])


def test_empty_tables(spark, tmp_path):
    assert stages(spark, f"file://{tmp_path}", []) == [[]] * 4
    text = "a text that is the only one in this table, of some words of which no label tells anything"
    assert stages(spark, f"file://{tmp_path}", [(1, text, "en", "s", 0)])[3] == [(1, text)]
