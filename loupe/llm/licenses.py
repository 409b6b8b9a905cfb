"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by directory.

Every line of a file, neighbouring lines together, and a licence file as a
whole, are passages.  Lines without a word don't count as lines between, so a
notice wrapped in a comment is put together; the longest template's words
bound the lines, as each holds one, and twice as many the words.  A licence
file as a whole is also compared with whole licence texts.  Passages and
templates are vectors of word counts times inverse document frequency,
which is counted over all lines for the words of the templates; any other word
weighs as much as the rarest of those.  A passage's licence is the template of
the largest cosine, if that reaches the threshold.

Only passages with an anchor word are compared: each template's anchors carry
so much of its weight that the others alone could not reach the threshold.

A file without a licence of its own takes that of its nearest directory, from
its own upwards, for which a file speaks.  Directories are matched by joins on
their paths, one row a directory, not a file.

Everything runs as DataFrame operations.  Defined results: NULL text is empty
and has no licence; a NULL path lies in no directory; equal scores go to the
first template by name; files that speak for one directory are ranked by
score, then path; repeated rows are answered each; no rows give no rows.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loupe.frames import col, require
from loupe.llm.rows import fresh, row_key, text_of
from loupe.session import durable

#: fixed values: public notices by licence identifier
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
THRESHOLD = 0.8
#: file names that speak for their directory
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
TOKEN = "[a-z0-9]+"
#: digits that scores are rounded to, so that sums in any order compare alike
DIGITS = 6


def words(text: str) -> Counter:
    return Counter(re.findall(TOKEN, text.lower()))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def lowered(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_texts() -> list[tuple[str, dict[str, int]]]:
    """(licence, its words with their counts) of whole licence texts."""
    lines = pkgutil.get_data("loupe.llm", "licence_words.jsonl").decode().splitlines()
    return [(x["license"], x["words"]) for x in map(json.loads, lines)]


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted(set().union(*(words(t) for _, t in templates)))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory_of(path: Column) -> Column:
    """All before the last ``/``; the root directory is the empty path."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def passages(files: DataFrame) -> DataFrame:
    """(row, at, passage): the lines, and as place -1 the whole of a licence file."""
    text = text_of()
    whole = F.when(name_of(F.col("path")).rlike(LICENCE_FILE), F.array(F.struct(F.lit(-1).alias("at"), text.alias("passage"))))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("passage")))
    return files.select(row_key(files).alias("row"), F.inline(F.concat(lines, F.coalesce(whole, F.array().cast("array<struct<at:int,passage:string>>")))))


def wrapped(files: DataFrame, marker: str, longest: int) -> DataFrame:
    """(row, at, lines, passage): two or more neighbouring lines with a marker among them.

    ``lines`` is how many lines with words are put together, ``at`` the place
    of the first.  They are at most ``longest``, and of twice as many words.
    """
    most = 2 * longest
    marked = files.select(row_key(files).alias("row"), text_of().alias("text")).where(lowered(F.col("text")).rlike(marker)).dropDuplicates(["row"])
    each = marked.select("row", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("n", F.size(tokens(F.col("line")))).where("n > 0")
    # a line of too many words is in no passage, so its text isn't needed
    fits = F.col("n") <= most
    each = each.withColumn("marked", fits & lowered(F.col("line")).rlike(marker)).withColumn("line", F.when(fits, F.col("line")))
    ahead = W.partitionBy("row").orderBy("at").rowsBetween(0, longest - 1)
    near = each.select(
        "row", "at", F.max("marked").over(ahead).alias("near"), F.collect_list(F.struct("line", "n", "marked")).over(ahead).alias("next")
    ).where(F.col("near") & (F.size("next") > 1))
    window = F.slice("next", F.lit(1), F.col("lines"))
    held = F.aggregate(window, F.lit(0), lambda total, x: total + x["n"]) <= most
    counted = near.select("row", "at", "next", F.explode(F.sequence(F.lit(2), F.size("next"))).alias("lines"))
    return counted.where(held & F.exists(window, lambda x: x["marked"])).select(
        "row", "at", "lines", F.array_join(F.transform(window, lambda x: x["line"]), "\n").alias("passage")
    )


def inverse_frequencies(pieces: DataFrame, known: list[str]) -> dict[str, float]:
    """ln((1 + passages) / (1 + passages with the word)) + 1 for each of the known words."""
    here = F.array_intersect(tokens(F.col("passage")), F.array(*[F.lit(w) for w in known]))
    counts = pieces.select(F.explode(F.concat(here, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}  # at most a row a known word
    total = n.get("", 0)
    return {w: math.log((1 + total) / (1 + n.get(w, 0))) + 1 for w in known}


def anchors(weights: list[dict[str, float]], threshold: float) -> list[str]:
    """Words without one of which no passage reaches the threshold with any template."""
    chosen = set()
    for vector in weights:
        rest = 1.0
        for word, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold**2 * 0.999:
                break
            chosen.add(word)
            rest -= w * w
    return sorted(chosen)


def classify(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, license, score, header): the best passage of every file that has one.

    ``header`` tells whether the file's first line, or a licence file as a
    whole, states that licence.
    """
    spark = files.sparkSession
    pieces = passages(files)
    idf = inverse_frequencies(pieces, vocabulary(templates))
    rarest = max(idf.values())
    weights, everywhere = [], [(name, words(text)) for name, text in templates]
    for _, counts in everywhere + whole_texts():
        vector = {w: c * idf.get(w, rarest) for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        weights.append({w: x / norm for w, x in vector.items()})
    # whole texts are compared with licence files as a whole
    named = [(name, False) for name, _ in everywhere] + [(name, True) for name, _ in whole_texts()]
    postings = [(w, name, k, x, whole) for k, ((name, whole), v) in enumerate(zip(named, weights)) for w, x in v.items()]
    posted = F.broadcast(spark.createDataFrame(postings, "word string, license string, template int, weight double, whole boolean"))
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))

    marker = f"(?<![a-z0-9])(?:{'|'.join(anchors(weights[: len(everywhere)], threshold))})(?![a-z0-9])"
    # few, and read several times below
    alone = pieces.where((F.col("at") < 0) | lowered(F.col("passage")).rlike(marker)).distinct().withColumn("lines", F.lit(1))
    suspects = durable(alone.unionByName(wrapped(files, marker, max(c.total() for _, c in everywhere))))
    place = ["row", "at", "lines"]
    counted = suspects.select(*place, F.explode(tokens(F.col("passage"))).alias("word")).groupBy(*place, "word").agg(F.count("*").alias("n"))
    weighed = counted.join(known, "word", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(rarest)))
    norms = weighed.groupBy(*place).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    met = weighed.join(posted, "word").where(~F.col("whole") | (F.col("at") < 0))
    dots = met.groupBy(*place, "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, place).withColumn("score", F.round(F.col("dot") / F.col("norm"), DIGITS)).where(F.col("score") >= threshold)
    rank = F.struct(-F.col("score"), "license", "at")
    return scores.groupBy("row").agg(
        F.min_by("license", rank).alias("license"), F.max("score").alias("score"), (F.min_by("at", rank) <= 0).alias("header")
    )


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, speaks: Column | None = None) -> DataFrame:
    """The columns of ``files`` but text, and license, score, origin and directory.

    ``origin`` is ``own``, ``inherited`` or NULL; ``directory`` is the one it is
    inherited from.  ``speaks`` picks the files that speak for their directory;
    by default those with the name of a licence file.  It may use ``path`` and
    ``header``.  A result that clashes with a column of ``files`` gets ``_``.
    """
    require(files, "path", "text")
    speaks = name_of(F.col("path")).rlike(LICENCE_FILE) if speaks is None else speaks
    row = fresh(files, "_row")
    kept = [c for c in files.columns if c != "text"]
    found = classify(files, templates, threshold).withColumnRenamed("row", row)
    # under names of their own, the files' columns can't clash with what is found
    given = files.withColumn(row, row_key(files)).select(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)], "path", row)
    own = given.join(found, row, "left")
    here = own.withColumns({"home": directory_of(F.col("path")), "speaks": speaks}).withColumnRenamed("path", "where")

    rank = F.struct(-F.col("score"), "where")
    declared = here.where("speaks AND license IS NOT NULL AND home IS NOT NULL").groupBy("home").agg(
        F.min_by("license", rank).alias("said"), F.max("score").alias("said_score")
    ).withColumnRenamed("home", "directory")
    # every directory with its ancestors, itself first; the root has depth 0
    homes = here.where("home IS NOT NULL").select("home").distinct()
    parts = F.split("home", "/")
    depth = F.when(F.col("home") == "", 0).otherwise(F.size(parts))
    chain = homes.withColumn("depth", F.explode(F.sequence(F.lit(0), depth))).withColumn(
        "directory", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest("depth", F.lit(1))), "/"))
    )
    nearest = chain.join(declared, "directory").groupBy("home").agg(
        F.max_by(F.struct("directory", "said", "said_score"), "depth").alias("near")
    )
    joined = here.join(nearest, "home", "left")
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
        F.coalesce("license", "near.said").alias(fresh(files, "license")), F.coalesce("score", "near.said_score").alias(fresh(files, "score")),
        F.when(F.col("license").isNotNull(), F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).alias(fresh(files, "origin")),
        F.when(F.col("license").isNull(), F.col("near.directory")).alias(fresh(files, "directory")),
    )
