"""License scans by diagonal voting.

The rolling three-word hashes of every document, those that any template has, are joined to the positions of the same hashes in the templates (a fixed, small
table). A hit votes for its diagonal, the offset between document and template; diagonals that lie close together are one
sighting. It is then verified: its hits' words must be the template's, they must cover enough of the template's words, and the
span that they stand in must not be much longer than the template. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, NEAR, SHARE, SHORT, LONG = 3, 4, 0.6, 12, 1.5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"

# The base phrases, then characteristic passages of public licenses.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "under the gnu general public license version 3"),
    ("gpl-2", "under the gnu general public license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
)


def words(text: Column) -> Column:
    """The words as they are written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def rolling(w: Column, within: list[int] | None = None) -> Column:
    """array<struct<pos, h, t>> of the K-grams: place, hash and words with A-Z in lower case; empty under K words. within: only those of
    these hashes, so that the many others never become rows. The hash is of words all in lower case, which is cheaper and can only
    add hits that t tells apart."""
    three = lambda x, i: [F.get(x, i + k) for k in range(K)]

    def grams(low: Column) -> Column:
        at = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))
        at = at if within is None else F.filter(at, lambda i: F.xxhash64(*three(low, i)).isin(within))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*three(low, i)).alias("h"), F.struct(*[F.translate(x, CAPITALS, SMALL) for x in three(w, i)]).alias("t")))

    return F.get(F.transform(F.array(F.transform(w, F.lower)), grams), F.lit(0))


def template_positions(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """h, t, template, at, grams, base, label: one row for each K-gram of the given texts, so its size is theirs."""
    texts = [(i, i < len(phrases), label, text) for i, (label, text) in enumerate([*phrases, *templates])]
    rows = spark.createDataFrame(texts, "template int, base boolean, label string, text string").coalesce(1)
    rows = rows.select("template", "base", "label", rolling(words(F.col("text"))).alias("g"))
    return rows.select("template", "base", "label", F.size("g").alias("grams"), F.inline("g")).withColumnsRenamed({"pos": "at", "t": "t0"})


def sightings(docs: DataFrame, key: str, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """key, label, base, start, end, share: where a template is seen, in words (end exclusive), and how much of it.

    docs: key and w (array of words). A phrase counts where all of its words stand in a row; a passage where the hits
    on neighbouring diagonals (at most NEAR words apart, for words put in or left out) cover SHARE of its words (under SHORT K-grams:
    all) within a span of at most LONG times its length.
    """
    spark = docs.sparkSession
    positions = template_positions(spark, phrases, templates)
    hashes = sorted({r["h"] for r in positions.select("h").collect()})  # as many as the given texts have words
    # outer, as for an inner one the optimizer works the array out once more to filter by its size
    grams = docs.select(key, F.inline_outer(rolling(F.col("w"), hashes))).where("h is not null")
    votes = grams.join(F.broadcast(positions), "h").where(F.col("t") == F.col("t0"))
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("at"))
    lines = votes.groupBy(key, "template", "base", "label", "grams", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    near = Window.partitionBy(key, "template").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(near) > NEAR), 1).otherwise(0)
    merged = lines.withColumn("group", F.sum(apart).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(key, "template", "base", "label", "grams", "group").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("d"))
    n_words = F.col("grams") + (K - 1)
    share = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda at: F.sequence(at, at + (K - 1)))))) / n_words
    start = F.when(F.col("base"), F.col("d")).otherwise(F.col("lo"))
    whole = F.size("ats") == F.col("grams")
    passage = (share >= SHARE) & (F.col("hi") + K - F.col("lo") <= n_words * LONG)
    return merged.where(F.when(F.col("base") | (F.col("grams") < SHORT), whole).otherwise(passage)).select(key, "label", "base", start.alias("start"), (F.col("hi") + K).alias("end"), share.alias("share"))


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words and no labels. Rows that repeat doc_id and text get the same result each; score is the
    largest share of a template that is seen (1 for a phrase, 0 for none).
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(3), "text", "doc_id").alias("k2"))
    rows = rows.select("doc_id", F.struct("k1", "k2").alias("row"), "text")
    seen = sightings(rows.select("row", words(F.col("text")).alias("w")), "row", phrases, templates).distinct()
    base = F.when(F.col("base"), F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = seen.groupBy("row").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"),
    )
    out = rows.select("doc_id", "row", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words")).join(found, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
