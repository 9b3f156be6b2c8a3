"""License scans by diagonal voting. JVM side only.

All rolling 3-word hashes of all texts are held against those of the license templates; a window that is in none never leaves its
row. A hit of text place i with template place j votes for the diagonal i - j. Hits of one notice on diagonals that lie near
each other are one span: insertions and deletions shift the diagonal a little, by the notice's length at most. A span is
verified by the words that its hits have in common with the notice in the same order, a longest common subsequence that is folded over
the hits in bits, and by its length. The phrases' windows must all stand on one diagonal: that is the exact phrase.

The templates are a fixed table of some hundred windows, which is broadcast. Hits are few, and they alone are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.columns import read_table

#: Words of a window.
K = 3
#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices in the words that licenses are usually recognised by.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
    "license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation either version",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
    "distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
    "compile sell or distribute this software",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
}
#: Diagonals at most so many words apart are one span.
NEIGHBOURS = 3
#: The least share of a notice's words in a span, in order, and how often as long as the notice a span may be.
COVERED, STRETCHED = 0.6, 2
#: Words of a template: places of a subsequence are bits of a long.
MOST_WORDS = 60

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def license_words(text: Column) -> Column:
    """Words of letters and digits of the lower-cased text, in order; none for null.

    Two letters beyond ASCII have lower-case forms with ASCII letters, so texts with them have A-Z alone folded.
    """
    t = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(t.contains("K") | t.contains("İ"), F.translate(t, upper, upper.lower())).otherwise(F.lower(t))
    parts = F.split(low, _SEPARATORS, -1)
    first = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
    last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(F.lit(0), F.size(parts) - (first - 1) - last))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, exact, words, windows, j, h): a row for each window of each phrase and notice."""
    rows = [(f"phrase {k}", label, True, text.split()) for k, (text, label) in enumerate(PHRASES.items())]
    rows += [(f"notice {label}", label, False, text.split()) for label, text in NOTICES.items()]
    assert all(len(w) <= MOST_WORDS for *_, w in rows)
    df = spark.createDataFrame(rows, "template string, label string, exact boolean, w array<string>")
    return df.select(
        "template", "label", "exact", F.size("w").alias("words"), (F.size("w") - (K - 1)).alias("windows"),
        F.posexplode(rolling(F.col("w"))).alias("j", "h"),
    )


def rolling(words: Column) -> Column:
    """Hashes of all windows of ``K`` words, in order; none of fewer words. Each word is hashed once."""
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    window = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (K - 1)), lambda i: F.xxhash64(*[h[i + (k - 1)] for k in range(K)]))
    none = F.array().cast("array<bigint>")
    return F.transform(F.array(hashed), lambda h: F.when(F.size(h) < K, none).otherwise(window(h)))[0]


def _in_order(hits: Column, words: Column) -> Column:
    """Most words that a text has in common with a template in the same order, by ``hits``, structs of a diagonal and its places j.

    Pairs of equal places go by in text order, for one text word the later places first, and each moves one bit (Hunt and Szymanski).
    """
    one = F.lit(1).cast("bigint")
    full = F.call_function("shiftleft", one, words.cast("int")) - 1
    place = lambda d, j: F.transform(F.array(*[F.lit(k) for k in range(K)]), lambda k: F.struct((d + j + k).alias("at"), (-j - k).alias("back")))
    pairs = F.flatten(F.transform(hits, lambda x: F.flatten(F.transform(x["js"], lambda j: place(x["diagonal"], j)))))

    def step(state: Column, x: Column) -> Column:
        bit = state.bitwiseAND(F.call_function("shiftleft", one, (-x["back"]).cast("int")))
        return (state + bit).bitwiseOR(state - bit).bitwiseAND(full)

    return words - F.bit_count(F.aggregate(F.array_sort(F.array_distinct(pairs)), full, step))


def scan(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, template, label, exact, start, stop, votes, share) of each verified span.

    Null and empty texts have no words and no spans. ``key`` tells texts apart. start and stop are places of words from 0, stop excluded.
    A span of a phrase is one place of it; a span of a notice may shift by up to ``NEIGHBOURS`` words between neighbouring diagonals
    and by the notice's length in all; spans of one notice may overlap. votes is the number of different windows, share that of the
    template's words that are in order. Other columns of ``df``, whatever their names, are not read.
    """
    known = templates(df.sparkSession)
    hashes = [r["h"] for r in known.select("h").distinct().collect()]
    words = df.select(F.col(key).alias("_key"), license_words(F.col(text)).alias("_w"))
    placed = F.transform(rolling(F.col("_w")), lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    windows = words.select("_key", F.inline(F.filter(placed, lambda x: x["h"].isin(hashes))))
    hits = windows.join(F.broadcast(known), "h").withColumn("diagonal", F.col("i") - F.col("j"))
    same = ["_key", "template", "label", "exact", "words", "windows"]
    votes = hits.groupBy(*same, "diagonal").agg(F.collect_set("j").alias("js"), F.min("i").alias("low"), F.max("i").alias("high"))
    by = Window.partitionBy("_key", "template").orderBy("diagonal")
    near = ~F.col("exact") & (F.col("diagonal") - F.lag("diagonal").over(by) <= NEIGHBOURS)
    chains = votes.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("chain", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    drift = F.col("drift")
    chains = chains.withColumn("drift", F.col("diagonal") - F.min("diagonal").over(Window.partitionBy("_key", "template", "chain")))
    # cells of the notice's length in two alignments: what drifts by up to half of it is in one cell of either
    cells = F.array(2 * F.floor(drift / F.col("windows")), 2 * F.floor(drift / F.col("windows") + 0.5) + 1)
    cells = chains.withColumn("cell", F.explode(F.when(F.col("exact"), F.array(F.lit(0).cast("bigint"))).otherwise(cells)))
    spans = cells.groupBy(*same, "chain", "cell").agg(
        F.min("low").alias("start"), (F.max("high") + K).alias("stop"), F.collect_list(F.struct("diagonal", "js")).alias("hits")
    )
    spans = spans.withColumn("votes", F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["js"])))).cast("bigint"))
    whole = F.col("votes") == F.col("windows")
    spans = spans.withColumn("share", F.when(F.col("exact"), F.when(whole, 1.0).otherwise(0.0)).otherwise(_in_order(F.col("hits"), F.col("words")) / F.col("words")))
    verified = F.when(F.col("exact"), whole).otherwise((F.col("share") >= COVERED) & (F.col("stop") - F.col("start") <= STRETCHED * F.col("words")))
    return spans.where(verified).select(F.col("_key").alias(key), "template", "label", "exact", "start", "stop", "votes", "share").distinct()


def op9_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every whole text of ``documents``.

    score is the largest share of a template's words in a verified span, 0 without one. Rows are told apart by a hash of doc_id
    and text; repeated rows have one hash and equal results.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    base = F.col("exact")
    found = scan(docs, "_row").groupBy("_row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    counted = docs.select("doc_id", "_row", F.size(license_words(F.col("text"))).cast("bigint").alias("n_words"))
    return counted.join(found, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
