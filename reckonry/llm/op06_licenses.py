"""License notices in documents: MinHash bands over overlapping windows, exact containment.

A template of n shingles belongs to the width w, the power of two from n up. Windows of 2w shingles
begin every w shingles, so each stretch of w lies whole in one of them. A window that holds 80 % of a
template has a similarity of 0.17 or more with it, and with one minimum a band the chance that none of
72 agrees is (1 - 0.17) ** 72, below 2e-6. (For w = 1, windows of one shingle: similarity 1.) A window
without any shingle of a template of its width has similarity 0 and needs no minima. What the bands
bring is counted exactly: the share of the template's distinct shingles in the window.

All steps are DataFrame operations. Windows of equal content are looked up once.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, functions as F

from reckonry.llm.native import with_shingles
from reckonry.plans.staging import stage

LEAST, MINIMA, SEED = 80, 72, 11
WORDS = r"[^\p{L}\p{N}]+"
#: A template table of more shingles than this is joined by a shuffle and not sent to every task.
BROADCAST_SHINGLES = 2_000_000

#: Short public notices by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                         "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


def _width(n: str) -> str:
    return f"cast(pow(2, ceil(log2({n}))) as int)"


def minima(window: str) -> F.Column:
    """``MINIMA`` minima of ``a * x + b`` modulo a prime over 31-bit shingle values, a and b drawn once from ``SEED``."""
    draw = random.Random(SEED)
    pairs = ", ".join(f"struct({draw.randrange(1, 2**31 - 1)}L as a, {draw.randrange(2**31 - 1)}L as b)" for _ in range(MINIMA))
    return F.expr(f"transform(array({pairs}), f -> array_min(transform({window}, x -> (f.a * pmod(x, 2147483647L) + f.b) % 2147483647L)))")


def templates_of(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """template, license, shingles (distinct), width."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, license string, text string")
    return with_shingles(table, "shingles", apart=WORDS).select("template", "license", F.array_distinct("shingles").alias("shingles")).where(
        "size(shingles) > 0").withColumn("width", F.expr(_width("size(shingles)")))


def windows(docs: DataFrame, templates: DataFrame, limit: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, width, at (first shingle), window: those that hold a shingle of a template of their width."""
    wanted = templates.select(F.explode("shingles").alias("shingle"), "width").distinct()
    # a shingle lies in the window that begins at its own step, and in the one before
    first = "cast(floor(p / width) * width as int)"
    at = F.expr(f"if(width = 1, array(p), filter(array({first} - width, {first}), x -> x >= 0))")
    texts = with_shingles(docs, "h", apart=WORDS).select("doc_id", "h")
    cut = F.slice("h", F.col("at") + 1, F.when(F.col("width") == 1, 1).otherwise(2 * F.col("width")))
    # posexplode_outer: the plain one would test the arrays' sizes before they are columns, text by text and shingle by shingle
    if wanted.count() <= limit:
        hits = texts.select("doc_id", "h", F.posexplode_outer("h").alias("p", "shingle")).join(F.broadcast(wanted), "shingle")
        found = hits.select("doc_id", "h", "width", F.explode(at).alias("at")).select("doc_id", "width", "at", cut.alias("window"))
        return found.groupBy("doc_id", "width", "at", "window").agg(F.lit(1).alias("one")).drop("one")
    keyed = texts.select(F.xxhash64("doc_id", "h").alias("row"), F.posexplode_outer("h").alias("p", "shingle"))
    found = keyed.join(wanted, "shingle").select("row", "width", F.explode(at).alias("at")).distinct()
    held = texts.select("doc_id", F.xxhash64("doc_id", "h").alias("row"), "h").dropDuplicates(["row"])
    return found.join(held, "row").select("doc_id", "width", "at", cut.alias("window"))


def licenses(docs: DataFrame, templates: DataFrame, least: int = LEAST, limit: int = BROADCAST_SHINGLES) -> DataFrame:
    """One row per document and license found: doc_id, license, containment of the best window, at_word (its first word).

    Words are runs of letters and digits in lower case. Null and blank texts hold nothing. Rows that
    share a doc_id share its rows here; a null doc_id is reported as null. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = [F.xxhash64("width", "window").alias("k1"), F.xxhash64("window", "width").alias("k2")]
    placed = stage(windows(docs, templates, limit).select("doc_id", "width", "at", "window", *ids), "license-windows")
    distinct = stage(placed.groupBy("k1", "k2").agg(F.first("width").alias("width"), F.first("window").alias("window")).withColumn(
        "minima", minima("window")), "license-minima")
    bands = distinct.select("k1", "k2", "width", F.posexplode("minima").alias("band", "value"))
    model = templates.withColumn("minima", minima("shingles")).select("template", "width", F.posexplode("minima").alias("band", "value"))
    met = bands.join(model, ["width", "band", "value"]).select("k1", "k2", "template").distinct()
    both = met.join(distinct.select("k1", "k2", "window"), ["k1", "k2"]).join(templates, "template")
    share = F.size(F.array_intersect("shingles", "window")) / F.size("shingles")
    good = both.select("k1", "k2", "license", share.alias("containment")).where(f"100 * containment >= {least}")
    good = good.groupBy("k1", "k2", "license").agg(F.max("containment").alias("containment"))
    return placed.select("doc_id", "at", "k1", "k2").join(good, ["k1", "k2"]).groupBy("doc_id", "license").agg(
        F.max(F.struct("containment", (-F.col("at")).alias("at"))).alias("best")).select(
        "doc_id", "license", "best.containment", (-F.col("best.at")).cast("long").alias("at_word"))


def op6_license_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{folder}/documents.parquet"), templates_of(spark))


def _sql(templates: tuple[tuple[str, str], ...]) -> str:
    """Shares of template shingles in the same windows, without minima."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(templates))
    return rf"""
with t(template, license, text) as (values {rows}), w as (
  select 'd' as side, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') w from documents
  union all select 't', template, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') from t
), s as (
  select side, id, unnest(h) as g, unnest(range(len(h))) as p from (
    select side, id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end as h from w)
), n as (select id, count(distinct g) as n, pow(2, ceil(log2(count(distinct g))))::bigint as width from s where side = 't' group by 1
), tg as (select distinct s.id, s.g, n.n, n.width from s join n on n.id = s.id where s.side = 't'
), hit as (
  select s.id as doc_id, tg.id as template, tg.n, tg.g,
    unnest(case when tg.width = 1 then [s.p] else [(s.p // tg.width) * tg.width, (s.p // tg.width - 1) * tg.width] end) as first
  from s join tg on tg.g = s.g where s.side = 'd'
), c as (select doc_id, template, first, count(distinct g)::double / n as containment from hit where first >= 0 group by doc_id, template, first, n)
select doc_id, license, max(containment) as containment, arg_min(first, (-containment, first))::bigint as at_word
from c join t on t.template = c.template where 100 * containment >= {LEAST} group by doc_id, license
"""


QUERY = op6_license_minhash
SQL = _sql(TEMPLATES)
