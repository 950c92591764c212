"""Licence scans: MinHash bands over overlapping text windows retrieve notices, exact shingle containment confirms them.

Words are runs of letters and digits in lower case; shingles are word pairs, since notices may be as short as three
words. Every text is cut into windows of WINDOW words, one starting every STRIDE words, and so is every template. For
each of `bands` hash functions (bands of one row) the lowest shingle of a window is kept; a window is a candidate for
a template whose window has the same lowest shingle in any band. The number of bands is set so that the least
alike pair of a whole notice and the window that holds it collides with probability TARGET. Candidates are checked
exactly: the share of the template's shingles that stand around the window must be at least MIN_CONTAINED.

DataFrame functions only. Two windows can only share a lowest shingle that both hold, so of a text only the windows that
hold a lowest shingle of some template window are looked at; they are cut, hashed and checked where the text stands, and
no text is shuffled. Templates may be many and long: up to LITERALS different lowest shingles are spelled out in the
plan; beyond that templates are tables like any other, all windows are looked at, and all joins are shuffled.

Null and empty texts, and texts of one word, have no windows; very long texts are scanned whole; every row counts for
itself, so repeated rows and rows of equal or null id each give their own results; of equal hits of a template in a
text the first window is told; a table without rows gives none; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm.common import written
from plexmat.llm.textstats import held

WINDOW, STRIDE, TARGET, MIN_CONTAINED = 8, 4, 0.999, 0.8
#: Templates with up to this many different lowest shingles are spelled out and broadcast; results are the same beyond it.
LITERALS = 4_000
#: Notices of common public licences.
NOTICES = {
    "rights-reserved": "All rights reserved.",
    "mit-short": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_LOW46 = (1 << 46) - 1


def least_jaccard(words: int) -> float:
    """The lowest index between a notice of so many words and the window that holds most of it, wherever it starts."""
    inside = words if words <= WINDOW - STRIDE + 1 else min((WINDOW + min(words, WINDOW) - STRIDE) // 2, WINDOW)
    own = min(words, WINDOW)
    common = inside - 1
    return common / ((WINDOW - 1) + (own - 1) - common)


def bands_for(words: int, target: float = TARGET) -> int:
    """Bands of one row so that such a notice is retrieved with probability `target`."""
    return math.ceil(math.log(1 - target) / math.log(1 - least_jaccard(words)))


def words_column(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def pair_hashes(words: str) -> Column:
    """The 64-bit hashes of the word pairs of an array column."""
    n = F.size(words)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(F.col(words), i), F.get(F.col(words), i + 1)))).otherwise(F.array().cast("array<bigint>"))


def windowed(grams: DataFrame, keep: tuple[str, ...], anchors: list[int] | None = None) -> DataFrame:
    """A row for each window of each row: keep, _grams, _window and its own pairs, _pairs. anchors: only windows that hold one of these."""
    if anchors is None:
        places = F.when(F.size("_grams") > 0, F.sequence(F.lit(0), F.floor((F.size("_grams") - 1) / STRIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
    else:
        at = F.filter(F.transform("_grams", lambda h, i: F.when(h.isin(anchors), i)), lambda i: i.isNotNull())
        before = lambda i: F.when((i >= STRIDE) & (i % STRIDE < WINDOW - 1 - STRIDE), F.floor(i / STRIDE) - 1)
        places = F.filter(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / STRIDE), before(i))))), lambda w: w.isNotNull())
    each = grams.select(*keep, "_grams", F.explode(F.transform(places, lambda w: w.cast("int"))).alias("_window"))
    return each.withColumn("_pairs", F.slice("_grams", F.col("_window") * STRIDE + 1, WINDOW - 1))


def by_band(windows: DataFrame, keep: tuple[str, ...], bands: int, seed: int = 41) -> DataFrame:
    """A row for each band of each window: keep, _band, and the lowest value of the window's pairs with the pair that has it, _low."""
    rng = random.Random(seed)
    factors = F.array(*[F.lit(rng.getrandbits(31) | 1).cast("bigint") for _ in range(bands)])
    value = lambda g, f: (F.shiftrightunsigned(g, 33) * f).bitwiseAND(_LOW46)
    lows = F.transform(factors, lambda f: F.array_min(F.transform("_pairs", lambda g: F.struct(value(g, f).alias("_value"), g.alias("_gram")))))
    return windows.select(*keep, F.posexplode(lows).alias("_band", "_low"))


class Templates:
    """The notices as shingles and as lowest shingles of bands, computed by the same columns as the texts."""

    def __init__(self, spark: SparkSession, notices: dict[str, str]):
        given = spark.createDataFrame(list(notices.items()), "license string, notice string")
        frame = held(given.select("license", words_column(F.col("notice")).alias("words")), drop=("words",), _words=F.size("words"), _grams=pair_hashes("words"))
        sizes = [r["_words"] for r in frame.select("_words").distinct().collect()]
        if min(sizes, default=2) < 2:
            raise ValueError("a template needs two words")
        self.bands, self.most = max((bands_for(n) for n in sizes), default=1), max(sizes, default=2)
        named = by_band(windowed(frame, ("license",)), ("license",), self.bands)
        index = written(named.select("license", "_band", "_low._value", "_low._gram").distinct(), "templates")
        found = index.select("_gram").distinct().limit(LITERALS + 1).collect()
        self.anchors = [r["_gram"] for r in found] if len(found) <= LITERALS else None
        self.index = index.select("license", "_band", "_value")
        self.grams = frame.select("license", "_words", F.array_distinct("_grams").alias("_own"))


def _contained(window: Column, around: Column) -> Column:
    """The share of a template's shingles that stand around a window, and the window's first word."""
    return F.struct((F.size(F.array_intersect("_own", around)) / F.size("_own")).alias("contained"), (-window * STRIDE).cast("long").alias("before"))


def _around(window: Column, words: Column | int, grams: Column) -> Column:
    begin = F.greatest(window * STRIDE - words, F.lit(0))
    return F.slice(grams, (begin + 1).cast("int"), F.lit(2) * words + (WINDOW - 1))


def _near_few(grams: DataFrame, templates: Templates) -> DataFrame:
    """Candidates of templates whose lowest shingles are spelled out: doc_id, _row, license, _best; one narrow step."""
    windows = windowed(grams, ("doc_id", "_row"), templates.anchors).withColumn("_grams", _around(F.col("_window"), templates.most, F.col("_grams")))
    bands = by_band(windows, ("doc_id", "_row", "_window", "_grams"), templates.bands).withColumn("_value", F.col("_low._value"))
    met = bands.join(F.broadcast(templates.index), ["_band", "_value"])
    near = met.join(F.broadcast(templates.grams), "license")
    # what is left of the window is what the longest template would have; a shorter one sees less of it
    skip = F.least(F.col("_window") * STRIDE, F.lit(templates.most)) - F.least(F.col("_window") * STRIDE, F.col("_words"))
    around = F.slice("_grams", (skip + 1).cast("int"), F.col("_words") * 2 + (WINDOW - 1))
    return near.select("doc_id", "_row", "license", _contained(F.col("_window"), around).alias("_best"))


def _near_many(grams: DataFrame, templates: Templates) -> DataFrame:
    """The same for any number of templates: windows meet templates by shuffle, and the shingles of a text are read once more."""
    texts = written(grams, "shingles")  # a written row keeps its number
    bands = by_band(windowed(texts, ("_row",)), ("_row", "_window"), templates.bands).withColumn("_value", F.col("_low._value"))
    met = bands.join(templates.index, ["_band", "_value"])
    windows = met.select("_row", "_window", "license").distinct().groupBy("_row", "license").agg(F.collect_list("_window").alias("_windows"))
    near = windows.join(templates.grams, "license").join(texts, "_row")
    best = F.array_max(F.transform("_windows", lambda w: _contained(w, _around(w, F.col("_words"), F.col("_grams")))))
    return near.select("doc_id", "_row", "license", best.alias("_best"))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, min_contained: float = MIN_CONTAINED) -> DataFrame:
    """One row for each document and template found in it: doc_id, license, contained, first_word (of the first window)."""
    templates = Templates(docs.sparkSession, notices or NOTICES)
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), words_column(F.col("text")).alias("_all"))
    grams = held(words, drop=("_all",), _grams=pair_hashes("_all"))
    near = (_near_few if templates.anchors is not None else _near_many)(grams, templates).where(F.col("_best")["contained"] >= min_contained)
    best = near.groupBy("_row", "license").agg(F.first("doc_id").alias("doc_id"), F.max("_best").alias("_best"))
    return best.select("doc_id", "license", F.col("_best")["contained"].alias("contained"), (-F.col("_best")["before"]).alias("first_word"))
