"""License scans by diagonal voting, with DataFrame functions only.

All rolling word pairs of the documents meet the word pairs of templates in a join.  A
match at word ``p`` of a document and word ``t`` of a template votes for the diagonal
``p - t``: the place where the template would begin.  Neighbouring diagonals are merged,
which bridges inserted and missing words, and spans that hold enough of a template count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.session import materialise

# Phrases whose exact places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening words of public license texts and notices, with the labels the method adds.
TEMPLATES = {
    "mit": ("released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software"
            " and associated documentation files the software to deal in the software without restriction"),
    "apache": ("licensed under the apache license version 2 0",
               "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted"
            " provided that the following conditions are met",),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by-sa": ("licensed under cc by sa 4 0",),
    "gpl-notice": ("this work is licensed under the gnu general public license version 3",
                   "you can redistribute it and or modify it under the terms of the gnu general public license"),
    "mpl": ("subject to the terms of the mozilla public license v 2 0",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
}
# Words between, in both senses: a diagonal this near to the one before it goes on with it.
DIAGONAL_GAP = 2
# The share of a template's word pairs that a span must hold.
COVERAGE = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pairs(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(gram, first, second, template, label, exact, t, pairs)`` of every word pair, and a row that marks documents."""
    rows = []
    listed = [(text, label, True) for text, label in phrases.items()]
    listed += [(text, label, False) for label, texts in templates.items() for text in texts]
    for number, (text, label, exact) in enumerate(listed):
        words = text.split()
        if len(words) < 2:
            raise ValueError("a template needs two words")
        rows += [(words[t], words[t + 1], number, label, exact, t, len(words) - 1) for t in range(len(words) - 1)]
    pairs = spark.createDataFrame(rows, "first string, second string, template int, label string, exact boolean, t int, pairs int")
    mark = spark.range(1).select(
        F.lit(0).cast("long").alias("gram"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second"),
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("exact"),
        F.lit(0).alias("t"), F.lit(0).alias("pairs"))
    return pairs.withColumn("gram", F.xxhash64("first", "second")).unionByName(mark)


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES,
         coverage: float = COVERAGE, gap: int = DIAGONAL_GAP) -> DataFrame:
    """One row per document row with its license labels, score and spans.

    ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``.
    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in
    lower case.  A phrase is found where its words stand consecutively: ``n_base``
    places, of all phrases, with their smallest and largest first word.  A template is
    found where a run of neighbouring diagonals holds at least ``coverage`` of its word
    pairs.  ``labels`` are those of phrases and templates, ``score`` is 1 for a phrase,
    else the best share of a template's word pairs that counted, 0 without a label.
    ``spans`` are ``(label, start, end)`` in words.

    A null or empty text has no words, no labels (empty strings) and no places.  Repeated
    rows and ids stay one row each (a row is known by doc_id and its text's hash).
    Templates are a written table of known size: while that is small Spark broadcasts it
    and the documents' word pairs stay where they are, beyond it joins them by hash.  A
    pair's hash is confirmed by its words.  The work grows with the number of words,
    in a long text as in many short ones.
    """
    pairs = materialise(_pairs(docs.sparkSession, phrases, templates))
    words = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"),
                        F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), SEPARATORS), lambda x: x != "").alias("words"))
    # Each pair carries its own two words, so that the array of all words stays behind.
    listed = F.expr("concat(array(named_struct('gram', 0L, 'left', cast(null AS string), 'right', cast(null AS string))),"
                    " zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)),"
                    " (a, b) -> named_struct('gram', xxhash64(a, b), 'left', a, 'right', b)))")
    grams = (words.select("doc_id", "text_key", F.size("words").alias("n_words"), listed.alias("listed"))
             .select("doc_id", "text_key", "n_words", F.posexplode("listed").alias("place", "pair"))
             .select("doc_id", "text_key", "n_words", "place", "pair.gram", "pair.left", "pair.right"))
    confirmed = F.expr("(template = -1 AND place = 0) OR (template >= 0 AND place > 0 AND left = first AND right = second)")
    met = materialise(grams.join(pairs, "gram").where(confirmed).select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), "template", "label", "exact", "pairs",
        (F.col("place") - 1).cast("long").alias("place"), F.col("t").cast("long").alias("t")))
    rows = met.where("template = -1").select(
        "doc_id", "text_key", "n_words", F.lit(1).alias("row"), *[F.lit(None).cast(kind).alias(name) for name, kind in _EVENT])
    diagonals = (met.where("template >= 0").groupBy("doc_id", "text_key", "template", "label", "exact", "pairs",
                                                    (F.col("place") - F.col("t")).alias("diagonal"))
                 .agg(F.collect_set("t").alias("seen"), F.min("place").alias("low"), F.max("place").alias("high")))
    blank = [F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("int").alias("row")]
    exact = diagonals.where("exact AND size(seen) = pairs").select(
        "doc_id", "text_key", *blank, "label", F.lit(True).alias("base"), F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("pairs") + 1).alias("end"), F.lit(1.0).alias("share"))
    by_place = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    merged = (diagonals.where("NOT exact")
              .withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by_place) > gap).cast("int"))
              .withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(by_place))
              .groupBy("doc_id", "text_key", "template", "label", "pairs", "run")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("held"), F.min("low").alias("start"),
                   (F.max("high") + 2).alias("end"))
              .withColumn("share", F.col("held") / F.col("pairs")))
    spans = merged.where(F.col("share") >= coverage).select(
        "doc_id", "text_key", *blank, "label", F.lit(False).alias("base"), "start", "end", "share")
    events = rows.unionByName(exact).unionByName(spans)
    labels = F.array_join(F.sort_array(F.collect_set("label")), ",")
    base_labels = F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",")
    base_start = F.when(F.col("base"), F.col("start"))
    found = events.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.sum("row").alias("rows"), F.count(base_start).alias("n_base"),
        F.min(base_start).alias("first_word"), F.max(base_start).alias("last_word"), base_labels.alias("base_labels"),
        labels.alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "start", "end")))).alias("spans"))
    return (found.withColumn("_row", F.explode(F.expr("sequence(1L, rows)")))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"))


_EVENT = (("label", "string"), ("base", "boolean"), ("start", "long"), ("end", "long"), ("share", "double"))
