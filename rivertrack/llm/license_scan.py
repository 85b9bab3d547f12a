"""License notices in texts, by MinHash bands and exact containment. Built-in functions only.

A text's words are lower-case runs of letters and digits, its shingles five words. A template of T
shingles (T <= S, S a power of two) is looked for in windows of 2S shingles that start every S
shingles, so wherever it stands, one window holds it whole. With at least CONTAINED of the
template in it, such a window has a Jaccard similarity of at least J = CONTAINED T / (2S + (1 -
CONTAINED) T) with it, and of BANDS bands of one row each at least one is equal with probability
1 - (1 - J)^BANDS. BANDS is set so that a miss is rarer than MISS. What the bands retrieve is
verified on the shingles' words.

The templates are a fixed list, so all happens where a row is read: no shuffle, no join.
"""

import math

from pyspark.sql import functions as F

from rivertrack.llm.common import let, whole_text

# Wording of common public notices.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-terms": (
        "you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at"
    ),
    "apache-2.0-disclaimer": (
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
        "ANY KIND, either express or implied."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-terms": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation"
    ),
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted"
    ),
    "mit-notice": "Released under the MIT License",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction"
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"
    ),
}
WORDS = 5
CONTAINED = 80  # per cent of a template's distinct shingles
MISS = 1e-6
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text):
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _shingles(words, make):
    """``make`` of every run of WORDS words; none for fewer words."""
    return F.when(F.size(words) < WORDS, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), make)
    )


def _hashes(words):
    return _shingles(words, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))


def _phrase(words, i):
    return F.array_join(F.slice(words, i + 1, WORDS), " ")


def bands_needed(size, span, miss=MISS):
    similar = CONTAINED / 100 * size / (span + (1 - CONTAINED / 100) * size)
    return math.ceil(math.log(miss) / math.log(1 - similar))


def _signature(hashes, bands):
    """One minimum per band, tagged with the band, so that arrays of them can be intersected."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))),
    )


def _classes(spark, templates):
    """Templates by window class: {S: [(name, phrases, hashes, signature), ...]}, and the bands of
    each class. A handful of rows, computed with the same functions as the texts."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = rows.select("name", _words(F.col("text")).alias("w"))
    rows = rows.select(
        "name",
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - WORDS), lambda i: _phrase(F.col("w"), i))).alias("phrases"),
        F.array_distinct(_hashes(F.col("w"))).alias("hashes"),
    )
    rows = rows.withColumn("size", F.size("phrases"))
    found = {}
    sizes = {r["name"]: r["size"] for r in rows.select("name", "size").collect()}
    for step in sorted({1 << (s - 1).bit_length() for s in sizes.values()}):
        names = [n for n, s in sizes.items() if 1 << (s - 1).bit_length() == step]
        bands = max(bands_needed(sizes[n], 2 * step) for n in names)
        part = rows.filter(F.col("name").isin(names)).withColumn("sig", _signature(F.col("hashes"), bands))
        found[step] = (bands, [tuple(r) for r in part.select("name", "phrases", "hashes", "sig").collect()])
    return found


def _longs(values):
    return F.array(*[F.lit(v).cast("long") for v in values])


def _best(words, hashes, step, template, windows):
    """(license, n_shingles, n_found, word_start) of the fullest window that the bands retrieve
    for one template, the first of equals; n_found is null without any."""
    name, phrases, _, sig = template
    wanted = F.array(*[F.lit(p) for p in phrases])
    retrieved = F.filter(windows, lambda r: F.arrays_overlap(r["sig"], _longs(sig)))

    def held(r):
        last = F.least(r["at"] + 2 * step, F.size(hashes)) - 1
        said = F.transform(F.sequence(r["at"], last), lambda i: _phrase(words, i))
        return F.struct(
            F.size(F.array_intersect(wanted, said)).alias("n_found"), (-r["at"]).alias("before")
        )

    best = F.array_max(F.transform(retrieved, held))
    return F.struct(
        F.lit(name).alias("license"),
        F.lit(len(phrases)).cast("long").alias("n_shingles"),
        best["n_found"].cast("long").alias("n_found"),
        (-best["before"]).cast("long").alias("word_start"),
    )


def _matches(words, hashes, classes):
    """The templates of which some window holds enough, as an array of `_best`."""
    out = []
    for step, (bands, templates) in classes.items():
        out.append(_of_class(words, hashes, step, bands, templates))
    return F.concat(*out)


def _of_class(words, hashes, step, bands, templates):
    of_class = _longs(sorted({h for t in templates for h in t[2]}))
    last = F.floor((F.size(hashes) - 1) / step).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * step)
    # a window without a shingle of any template cannot match one
    near = F.filter(
        starts, lambda s: F.arrays_overlap(F.slice(hashes, s + 1, 2 * step), of_class)
    )
    signed = F.transform(
        near,
        lambda s: F.struct(
            s.alias("at"), _signature(F.slice(hashes, s + 1, 2 * step), bands).alias("sig")
        ),
    )

    def verified(windows):
        found = F.array(*[_best(words, hashes, step, t, windows) for t in templates])
        return F.filter(found, lambda m: 100 * m["n_found"] >= CONTAINED * m["n_shingles"])

    return let(signed, verified)


def scan(docs, id_col="doc_id", text="text", templates=None):
    """One row (id, license, n_shingles, n_found, word_start) per row of ``docs`` and template of
    which a window holds at least CONTAINED per cent: the distinct shingles of the template, how
    many the fullest window holds, and the first word of the first such window.

    Null, empty and short texts (fewer than five words) match nothing. Rows that repeat are
    answered each. Other columns are not read."""
    templates = TEMPLATES if templates is None else templates
    classes = _classes(docs.sparkSession, templates)
    every = _longs(sorted({h for _, ts in classes.values() for t in ts for h in t[2]}))
    none = "array<struct<license: string, n_shingles: bigint, n_found: bigint, word_start: bigint>>"

    def found(words):
        # a text without a single shingle of any template cannot match
        return let(
            _hashes(words),
            lambda h: F.when(F.arrays_overlap(h, every), _matches(words, h, classes)).otherwise(
                F.array().cast(none)
            ),
        )

    base = docs.select(id_col, whole_text(text).alias("_text"))
    rows = base.select(id_col, F.explode(let(_words(F.col("_text")), found)).alias("_m"))
    return rows.select(id_col, "_m.*")


def oracle_sql(templates=None):
    """The same rows in DuckDB SQL: every window compared exactly with every template."""
    templates = TEMPLATES if templates is None else templates
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(templates.items()))
    return f"""
WITH template AS (
  SELECT license, list_filter(string_split_regex(lower(t), '[^\\pL\\pN]+'), lambda x: x <> '') AS w
  FROM (VALUES {values}) AS v(license, t)
), wanted AS (
  SELECT DISTINCT license, array_to_string(w[i:i + {WORDS - 1}], ' ') AS phrase
  FROM (SELECT license, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS i FROM template)
), size AS (
  SELECT license, count(*) AS n_shingles, (2 ** ceil(log2(count(*))))::BIGINT AS step
  FROM wanted GROUP BY license
), texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda x: x <> '') AS w
  FROM documents
), said AS (
  SELECT r, doc_id, i - 1 AS i, array_to_string(w[i:i + {WORDS - 1}], ' ') AS phrase
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS i FROM texts)
), hit AS (
  SELECT r, doc_id, license, n_shingles, phrase, unnest([i // step * step, i // step * step - step]) AS s
  FROM said JOIN wanted USING (phrase) JOIN size USING (license)
), held AS (
  SELECT r, doc_id, license, n_shingles, s, count(DISTINCT phrase) AS n_found
  FROM hit WHERE s >= 0 GROUP BY ALL
)
SELECT doc_id, license, n_shingles, max(n_found) AS n_found,
       arg_min(s, (-n_found, s)) AS word_start
FROM held GROUP BY r, doc_id, license, n_shingles
HAVING 100 * max(n_found) >= {CONTAINED} * n_shingles
"""
