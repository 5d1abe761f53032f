"""License scans by diagonal voting, in DataFrame operations only.

Every run of k words (k = 2 and 3) of a document is hashed; hashes that no template has fall away in place (a filter
on a fixed set), and the others join the template positions of the same hash, and of the same words. A match at
document word p and template word q votes for the diagonal p - q. Votes are summed per document, template and
diagonal; diagonals at most NEAR apart, as inserted or dropped words leave them, are merged into a span. A span's
cover is the share of the template's words that lie in a voting run: a changed, inserted or dropped word takes away
no more than itself and, within two words of an end, what is left of that end. Templates of LONG words and more are found at COVER,
shorter ones, which differ by single words among themselves, whole. A phrase of k words is one run, so its diagonals
are its exact places. The score is the best cover of any span, also of one that is not enough for its label.

Templates are a parameter: (label, text) pairs, notices by default; whole license texts can be given too, up to the
few thousand distinct runs that the filter takes. Null and empty texts have no words and no labels. A document's
votes number at most its words times the places of a run in the templates, a constant. Repeated rows get equal
results; extra columns are not carried.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, BLANKED, LOWER, UPPER, materialize, with_row_id

NEAR, COVER, LONG = 2, 0.8, 12

# ---- fixed values: phrases, and notices as the licenses give them -----------------------------------
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "mit-notice": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "gpl-notice": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "cc-by-4.0": ["licensed under cc by 4 0"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "all-rights-reserved": ["copyright all rights reserved", "all rights reserved"],
}
# -----------------------------------------------------------------------------------------------------


def templates(notices: dict[str, list[str]] | None = None) -> list[dict]:
    """A row per template and run: template number, label, whether a base phrase, k, place q, words, the cover that
    the label takes, the run's words and their hash."""
    out = []
    listed = [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for label, ts in (NOTICES if notices is None else notices).items() for t in ts]
    for n, (text, label, base) in enumerate(listed):
        w = text.encode().translate(ALNUM).decode().split()
        k = min(3, len(w))
        if k < 2:
            raise ValueError(f"a template of fewer than two words: {text!r}")
        for q in range(len(w) - k + 1):
            out.append({"template": n, "label": label, "base": base, "k": k, "q": q, "words": len(w), "enough": COVER if len(w) >= LONG else 1.0, "run": " ".join(w[q : q + k]), "hash": run_hash(w[q : q + k])})
    return out


def run_hash(words: list[str]) -> int:
    """What F.xxhash64 gives for these strings: each hash seeds the next."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def words_of(text):
    """The words, [] for none. A text without words splits into one empty string."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER + BLANKED, LOWER + " " * len(BLANKED)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def runs_found(k: int, wanted: set[int]):
    """Places and words of the runs of k words whose hash some template has."""
    w = F.col("w")
    h = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))
    places = F.filter(F.sequence(F.lit(0), F.size(w) - k), lambda i: h(i).isin(*wanted))
    found = F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), i.alias("p"), F.array_join(F.slice(w, i + 1, k), " ").alias("run"), h(i).alias("hash")))
    return F.when(F.size(w) >= k, found).otherwise(F.array().cast("array<struct<k:int,p:int,run:string,hash:bigint>>"))


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """Per row: _row, doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    spark, rows = docs.sparkSession, templates(notices)
    wanted = {k: {r["hash"] for r in rows if r["k"] == k} for k in (2, 3)}
    split = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    # One projection by itself, else the split would be repeated where w is used.
    scanned = materialize(with_row_id(split, "_row").select("_row", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(*(runs_found(k, wanted[k]) for k in (2, 3) if wanted[k])).alias("runs")), "runs")
    t = F.broadcast(spark.createDataFrame(rows, "template int, label string, base boolean, k int, q int, words int, enough double, run string, hash bigint"))
    votes = (
        scanned.select("_row", F.explode("runs").alias("d")).select("_row", "d.*").join(t, ["hash", "k", "run"])
        .groupBy("_row", "template", "label", "base", "words", "enough", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.count("*").alias("n"), F.collect_set(F.struct("q", "k")).alias("places"))
    )
    one = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one) > NEAR, F.lit(True))
    covered = F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda x: F.sequence(x.q, x.q + x.k - 1)))
    # A span starts at the diagonal with most votes; of equal ones, at the least.
    best = F.min_by("diagonal", F.struct(-F.col("n"), F.col("diagonal"))).alias("start")
    merged = (
        votes.withColumn("island", F.sum(apart.cast("int")).over(one))
        .groupBy("_row", "template", "label", "base", "words", "enough", "island")
        .agg(best, F.array_distinct(covered).alias("covered"))
        .withColumn("cover", F.size("covered") / F.col("words"))
        .withColumn("found", F.col("cover") >= F.col("enough"))
    )
    found = merged.groupBy("_row").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))).alias("labels"),
        F.max("cover").alias("score"),
    )
    none = F.array().cast("array<string>")
    return scanned.select("_row", "doc_id", "n_words").join(found, "_row", "left").select(
        "_row", "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")
