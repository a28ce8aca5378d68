"""License scans by diagonal voting, in DataFrame operations alone.

Every run of ``GRAM`` words of a text is hashed and joined with the places of such runs in a set of
templates. A match votes for a diagonal: its place in the text less its place in the template.
Votes are gathered by row, template and diagonal. A diagonal and those up to ``BAND`` after it, as words
put in or left out make them, are one stretch of text; it is a match where the distinct template
places that it holds cover enough of the template, so a line said over and over counts once, and
where no match of another label that covers more overlaps it. Matches that touch are told as one span. A hash that only looks the same has no vote: the words
themselves are compared.

Short phrases have to match in full: a phrase's place is a diagonal with all its runs.

Each row is judged by itself, repeated rows and null ids too: a row for each row. Null and empty texts
have no words: n_words 0, no place, labels ''. Very long texts: work is linear in the words, since only
words that begin a known run leave the row. Ties: of equal scores the label is in ``labels`` once.
An empty table gives no rows. Extra columns, whatever their names, are ignored. ``docs`` is a table's
scan, so that rows get the same number when a lost task runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.llm.common import table

GRAM, BAND, COVER = 3, 16, 0.6
#: Templates are known and few: more words than this in them are refused, since each task gets them all.
MOST_RUNS = 100_000

#: The phrases of the contract, and the label of each.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Forms(tuple):
    """Pairs of a label and a text, read like a dict's items; a label may have more than one text."""

    def items(self):
        return iter(self)


#: Notices of public licenses, and the short forms in which they are named.
NOTICES = Forms((
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl", "under the gnu general public license"),
    ("lgpl", "under the gnu lesser general public license"),
    ("agpl", "under the gnu affero general public license"),
    ("mit", "the mit license mit"),
    ("mit", "licensed under mit"),
    ("apache-2", "apache license 2 0"),
    ("cc-by", "cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "creative commons attribution non commercial"),
))

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No run of words hashes to it but by chance, and then its place isn't the text's end.
_END = -7046029254386353131


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, str] | Forms = NOTICES) -> DataFrame:
    """A row for each run of words of each template: h, gram, template, place, runs, label, phrase. As many rows as the templates have words."""
    rows = []
    for k, (text, label, phrase) in enumerate([*((t, n, True) for t, n in phrases.items()), *((t, n, False) for n, t in notices.items())]):
        words = text.split()
        runs = len(words) - GRAM + 1
        rows += [(words[i : i + GRAM], k, i, runs, label, phrase) for i in range(runs)]
    t = spark.createDataFrame(rows, "gram array<string>, template int, place int, runs int, label string, phrase boolean")
    t = t.withColumn("h", F.xxhash64(*[F.col("gram")[i] for i in range(GRAM)]))
    end = spark.createDataFrame([(None, -1, 0, 0, None, False, _END)], "gram array<string>, template int, place int, runs int, label string, phrase boolean, h long")
    return t.unionByName(end)


def _words(text):
    """Words of the text with A-Z lower-cased; the Kelvin sign, alone in having an ASCII letter as its lower case, is kept from it."""
    lowered = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def scan(docs: DataFrame, found: DataFrame | None = None, band: int = BAND, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, first, last, score) of each row."""
    found = templates(docs.sparkSession) if found is None else found
    listed = found.select("h", "runs").limit(MOST_RUNS + 1).collect()
    if len(listed) > MOST_RUNS:
        raise ValueError(f"the templates have more than {MOST_RUNS} runs of words")
    known, longest = sorted({r["h"] for r in listed}), max(r["runs"] for r in listed)
    d = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("words"))
    here = F.transform("words", lambda w, i: F.when(F.xxhash64(w, *[F.get("words", i + k) for k in range(1, GRAM)]).isin(known), i))
    d = d.withColumn("n", F.size("words")).withColumn("here", F.array_compact(here))
    run = lambda i: F.slice("words", i + 1, GRAM)
    hash_of = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(GRAM)])
    end = F.struct(F.col("n").alias("at"), F.lit(_END).alias("h"), F.array().cast("array<string>").alias("own"))
    hits = F.concat(F.transform("here", lambda i: F.struct(i.alias("at"), hash_of(i).alias("h"), run(i).alias("own"))), F.array(end))
    votes = d.select("doc_id", "row", "n", F.explode(hits).alias("v")).select("doc_id", "row", "n", "v.*").join(F.broadcast(found), "h")
    votes = votes.filter(F.when(F.col("template") < 0, F.col("at") == F.col("n")).otherwise(F.col("own") == F.col("gram")))
    # one shuffle: a row's votes stay together from here on
    votes = votes.select("doc_id", "row", "template", (F.col("at") - F.col("place")).alias("diagonal"), "at", "place", "runs", "label", "phrase").repartition("row")
    by = ["row", "doc_id", "template"]
    kept = [F.any_value(c).alias(c) for c in ("runs", "label", "phrase")]
    diagonals = votes.groupBy(*by, "diagonal").agg(F.collect_list("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"), *kept)
    # a diagonal has a place at most once, so each list here is bounded by the template and the band
    reach = Window.partitionBy(*by).orderBy("diagonal").rangeBetween(0, band)
    near = ~F.col("phrase") & (F.col("template") >= 0)
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("places").over(reach))))
    stretch = diagonals.withColumn("votes", F.when(near, covered).otherwise(F.size("places"))).withColumn("last", F.when(near, F.max("last").over(reach)).otherwise(F.col("last")))
    whole = F.col("phrase") & (F.col("votes") >= F.col("runs"))
    hit = whole | (near & (F.col("votes") >= F.lit(cover) * F.col("runs")))
    stretch = stretch.withColumn("whole", whole).withColumn("score", F.when(hit, F.col("votes") / F.col("runs")))
    # the matches that can overlap one begin within a template's length of it
    about = Window.partitionBy("row", "doc_id").orderBy("first").rangeBetween(-(longest + band + GRAM), longest + band + GRAM)
    others = F.collect_list(F.when(F.col("score").isNotNull(), F.struct("label", "score", "first", "last"))).over(about)
    beaten = F.exists("others", lambda o: (o["score"] > F.col("score")) & (o["label"] != F.col("label")) & (o["first"] < F.col("last") + GRAM) & (F.col("first") < o["last"] + GRAM))
    stretch = stretch.withColumn("others", others).withColumn("score", F.when(F.col("whole") | ~beaten, F.col("score"))).drop("others")
    # matches that touch are one span; rows without a match are kept for the words that they count
    earlier = Window.partitionBy(*by, "hit").orderBy("diagonal")
    stretch = stretch.withColumn("hit", F.col("score").isNotNull())
    apart = F.col("phrase") | F.coalesce(F.col("first") > F.max("last").over(earlier.rowsBetween(Window.unboundedPreceding, -1)) + GRAM, F.lit(True))
    stretch = stretch.withColumn("span", F.sum(apart.cast("int")).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    spans = stretch.groupBy(*by, "hit", "span").agg(
        F.any_value("label").alias("label"), F.bool_or("whole").alias("whole"), F.max("score").alias("score"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    span = F.when(F.col("hit"), F.struct("label", "first", (F.col("last") + GRAM - 1).alias("last"), "score"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") < 0, F.col("first"))).cast("long").alias("n_words"),
        F.count_if("whole").alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("first"))).cast("long").alias("last_word"),
        labels(F.col("whole")).alias("base_labels"),
        labels(F.col("hit")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    ).drop("row")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
