"""License notices found by MinHash over overlapping windows of words, in DataFrame operations alone.

Templates are cut into passages of at most 16 three-word shingles, hashed to BANDS one-row bands. A band can only collide
in a window that holds the passage's own minimum, so windows are laid around such shingles only, which loses no
collision: windows of SHINGLES shingles, one each STRIDE words, and one that lies as the passage would with its minimum
in this place. A passage that stands unchanged in a text has Jaccard similarity 1 with the latter, so that every band
collides and it is always retrieved; one changed in some words, with a similarity of J to a window, is missed by it with
(1 - J)^BANDS, under 1 % from J = 0.25 on. What the bands retrieve is then verified by exact containment of the
template's five-word shingles in the document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLES, STRIDE, BANDS, LEAST = 16, 4, 16, 0.8
PASSAGE_WORDS = 18
#: Words: runs of ASCII letters, digits and anything beyond ASCII, in lower case.
BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: Wordings of public licenses and of the notices that refer to them.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MIT whole text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0 text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", text.lower()) if w]


def _shingle_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))


def _seeded(band: int):
    return lambda x: F.xxhash64(x, F.lit(band))


def _bands(hashes: Column) -> Column:
    """A key for each band: the band's number with the least of its own hashes of the shingles."""
    return F.array(*[F.xxhash64(F.lit(j), F.array_min(F.transform(hashes, _seeded(j)))) for j in range(BANDS)])


def _minimum(band: int):
    return lambda x: F.struct(_seeded(band)(x).alias("h"), x.alias("x"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generator of one row, which no filter is pushed through."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def _positions(words: Column, last: int) -> Column:
    """0 to the number of words less last; none in shorter texts."""
    return F.when(F.size(words) >= last, F.sequence(F.lit(0), F.size(words) - last)).otherwise(F.array().cast("array<int>"))


def _five(words: Column) -> Column:
    return F.transform(_positions(words, 5), lambda i: F.array_join(F.slice(words, i + 1, 5), " "))


def template_tables(spark: SparkSession, templates: dict[str, str]) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[str]], dict[str, list[str]]]:
    """(places of the shingles that are some band's minimum, templates by band key, five-word shingles by template).

    A place is (shingles before it, shingles in all) of its passage."""
    passages = []
    for name, text in templates.items():
        w = words_of(text)
        if len(w) < 5:
            raise ValueError(f"template {name} has fewer than five words")
        passages += [(name, w[at : at + PASSAGE_WORDS]) for at in range(0, max(1, len(w) - 2), PASSAGE_WORDS - 2) if len(w[at : at + PASSAGE_WORDS]) >= 3]
    df = spark.createDataFrame(passages, "name string, words array<string>")
    df = df.withColumn("h", F.transform(_positions(F.col("words"), 3), lambda i: _shingle_hash(F.col("words"), i)))
    low = F.array(*[F.array_min(F.transform("h", _minimum(j))).getField("x") for j in range(BANDS)])
    anchors, keys = {}, {}
    for row in df.select("name", "h", low.alias("low"), _bands(F.col("h")).alias("bands")).collect():
        for x in row["low"]:
            place = (row["h"].index(x), len(row["h"]))
            if place not in anchors.setdefault(x, []):
                anchors[x].append(place)
        for key in row["bands"]:
            if row["name"] not in keys.setdefault(key, []):
                keys[key].append(row["name"])
    five = {n: list(dict.fromkeys(" ".join(w[i : i + 5]) for i in range(len(w) - 4))) for n, w in ((n, words_of(t)) for n, t in templates.items())}
    return anchors, keys, five


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id_col, license, containment, first_word) of each row of docs and each template that it contains to at least
    the share least of its distinct five-word shingles; first_word is the place of the first of them found.

    Null, empty and short texts contain none; repeated rows are reported each; further columns are ignored; an empty
    table gives no rows. The lists of templates are fixed and small, and so literals of the plan.
    """
    anchors, keys, five = template_tables(docs.sparkSession, templates)
    words = F.filter(F.split(F.lower(F.col(text_col).cast("string")), BETWEEN), lambda w: w != "")
    base = _once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "w", words).drop("text")
    w = F.col("w")
    hits = _once(base, "p", F.filter(_positions(w, 3), lambda i: _shingle_hash(w, i).isin(sorted(anchors)))).where(F.size("p") > 0)
    last = F.size("w") - 3
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    # windows whose shingles STRIDE * k to STRIDE * k + SHINGLES - 1 hold an anchor, and those that lie as its passage would
    around = F.transform("p", lambda p: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((p - SHINGLES + 1) / STRIDE)).cast("int"), F.floor(p / STRIDE).cast("int")), lambda k: span(k * STRIDE, F.least(k * STRIDE + SHINGLES - 1, last))))
    places = F.create_map(*[x for h, own in sorted(anchors.items()) for x in (F.lit(h), F.array(*[span(F.lit(before), F.lit(size)) for before, size in own]))])
    aligned = F.transform("p", lambda p: F.transform(places[_shingle_hash(w, p)], lambda x: span(p - x["a"], p - x["a"] + x["b"] - 1)))
    inside = F.filter(F.flatten(F.concat(around, aligned)), lambda x: (x["a"] >= 0) & (x["b"] <= last))
    laid = _once(hits, "k", F.array_distinct(inside))
    window = lambda k: F.transform(F.sequence(k["a"], k["b"]), lambda i: _shingle_hash(w, i))
    known = F.array(*[F.lit(x) for x in keys])
    lists = F.transform("k", lambda k: F.array_intersect(_bands(window(k)), known))
    retrieved = _once(laid, "keys", F.array_distinct(F.flatten(lists)))
    named = F.create_map(*[x for key, names in keys.items() for x in (F.lit(key), F.array(*map(F.lit, names)))])
    found = retrieved.where(F.size("keys") > 0).select("id", "w", F.array_distinct(F.flatten(F.transform("keys", lambda x: named[x]))).alias("names"))
    shingles = F.create_map(*[x for n, s in five.items() for x in (F.lit(n), F.array(*map(F.lit, s)))])
    pairs = _once(found, "s", _five(w)).select("id", "s", F.explode("names").alias("license"))
    pairs = _once(_once(pairs, "t", shingles[F.col("license")]), "shared", F.array_intersect("t", "s"))
    return (
        pairs.withColumn("containment", F.size("shared") / F.size("t"))
        .where(F.col("containment") >= least)
        .select(F.col("id").alias(id_col), "license", "containment", F.array_min(F.transform("shared", lambda x: F.array_position("s", x) - 1)).cast("long").alias("first_word"))
    )


def oracle_sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same containment for DuckDB, of every template in every document, without retrieval."""
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{x}'" for x in dict.fromkeys(" ".join(w[i : i + 5]) for i in range(len(w) - 4)))) for n, w in ((n, words_of(t)) for n, t in templates.items()))
    return f"""
WITH templates(license, t) AS (VALUES {rows}),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS s FROM words WHERE len(w) >= 5
),
shared AS (
  SELECT doc_id, license, t, s, list_filter(t, lambda x: list_contains(s, x)) AS c
  FROM shingles, templates WHERE list_has_any(s, t)
)
SELECT doc_id, license, len(c) / len(t) AS containment,
  list_min(list_transform(c, lambda x: list_position(s, x) - 1))::BIGINT AS first_word
FROM shared WHERE len(c) / len(t) >= {least}"""
