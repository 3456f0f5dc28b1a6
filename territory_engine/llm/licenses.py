"""License scans by sparse TF-IDF cosine and directory inheritance (operator 10).

Every line of a file (headers may stand anywhere), and the whole text of files named like licence
files, is a unit. Units and templates are sparse TF-IDF vectors; a unit whose cosine with a template reaches
THRESHOLD carries that licence, and the best unit decides for its file. A file without a licence of
its own inherits from the nearest directory above it that holds a licence file with a recognised
licence, by an equi-join of directories and their ancestors.

Document frequencies of the template terms are counted over all files. Units are filtered before
their terms are exploded: a cosine of THRESHOLD is impossible without one of a template's heaviest
terms (those without which the rest of its vector is too short), so lines with none of them need
no vector. The filter is exact. Everything is DataFrame functions; templates are a parameter of
bounded size whose terms become literals of the plan.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import table, written

THRESHOLD = 0.6
#: Distinct template terms at most; they are literals of the plan.
MOST_TERMS = 20_000

TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"

# Licence identifiers and the wording of their headers and texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
            " (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
                " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
                     " conditions are met"),
]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def template_vectors(templates: list[tuple[str, str]], frequency: dict[str, int], files: int) -> list[tuple[str, dict[str, float]]]:
    """Unit-length TF-IDF vectors of the templates."""
    out = []
    for licence, text in templates:
        found = re.findall(TERM, text.lower())
        raw = {t: found.count(t) * idf(frequency.get(t, 0), files) for t in found}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out.append((licence, {t: x / length for t, x in sorted(raw.items())}))
    return out


def idf(frequency: int, files: int) -> float:
    return math.log((1 + files) / (1 + frequency)) + 1


def needed_terms(vectors: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """Terms of which a unit has at least one if its cosine with any template reaches the threshold."""
    out = set()
    for _, v in vectors:
        rest = 1.0
        for t, x in sorted(v.items(), key=lambda tx: (-tx[1], tx[0])):
            if rest < threshold * threshold * (1 - 1e-9):
                break
            out.add(t)
            rest -= x * x
    return sorted(out)


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals."""
    made = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def scan_licences(files: DataFrame, templates: list[tuple[str, str]], path_col: str = "path", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with licence, licence_score, licence_origin and licence_path added (replaced if present).

    Origin is ``own`` (a unit of the file; the path is the file's), ``inherited`` (the path is that of
    the licence file; of several in a directory the best score, then the smallest path) or ``none``
    (licence, score and path null). Equal scores go to the smaller licence id. Null texts have no
    units, a null path has neither name nor directory; rows repeated as a whole keep their number. A
    directory's own licence file is the nearest for the files in it. An empty table gives an empty
    result.
    """
    spark = files.sparkSession
    vocabulary = sorted({t for _, text in templates for t in re.findall(TERM, text.lower())})
    if not vocabulary or len(vocabulary) > MOST_TERMS:
        raise ValueError(f"templates must have 1 to {MOST_TERMS} distinct terms")
    added = ("licence", "licence_score", "licence_origin", "licence_path")
    kept = [c for c in files.columns if c not in added]
    path, text = F.col(f"`{path_col}`"), F.col(f"`{text_col}`")
    nulls = F.concat(path.isNull().cast("string"), text.isNull().cast("string"))
    base = F.element_at(F.split(path, "/", -1), -1)
    directory = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))
    own = files.select(path.alias("path"), text.alias("text"), F.xxhash64(nulls, path, text).alias("f1"),
                       F.xxhash64(F.lit(1), nulls, path, text).alias("f2"), F.coalesce(base.rlike(LICENCE_FILE), F.lit(False)).alias("is_licence"))

    counted = (own.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(
        F.array_intersect(terms(F.col("text")), F.array(*[F.lit(t) for t in vocabulary])), F.array().cast("array<string>")))).alias("term"))
        .groupBy("term").count().collect())  # one row for each template term, and "" for each file
    frequency = {r["term"]: r["count"] for r in counted}
    total = frequency.pop("", 0)
    vectors = template_vectors(templates, frequency, total)

    some = rf"(?<![a-z0-9])(?:{'|'.join(re.escape(t) for t in needed_terms(vectors, threshold))})(?![a-z0-9])"
    lines = F.when(F.col("is_licence"), F.concat(F.array("text"), F.split("text", "\n"))).otherwise(F.split("text", "\n"))
    units = (own.select("f1", "f2", F.posexplode(F.filter(lines, lambda u: F.lower(u).rlike(some))).alias("unit", "words"))
             .select("f1", "f2", "unit", F.explode(terms(F.col("words"))).alias("term"))
             .groupBy("f1", "f2", "unit", "term").agg(F.count("*").alias("tf")))
    weights = literal_rows(spark, [(t, idf(frequency.get(t, 0), total)) for t in vocabulary], ["term", "idf"])
    unit_terms = units.join(weights, "term", "left").select(
        "f1", "f2", "unit", "term", (F.col("tf") * F.coalesce("idf", F.lit(idf(0, total)))).alias("w"))
    unit_terms = written(unit_terms, "licence-units")
    by_template = literal_rows(spark, [(i, licence, t, x) for i, (licence, v) in enumerate(vectors) for t, x in v.items()],
                               ["template", "licence", "term", "x"])
    length = unit_terms.groupBy("f1", "f2", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    cosine = (unit_terms.join(by_template, "term").groupBy("f1", "f2", "unit", "template", "licence").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
              .join(length, ["f1", "f2", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 4)).filter(F.col("score") >= threshold))
    smallest = F.min(F.struct((-F.col("score")).alias("s"), "licence"))
    recognised = written(cosine.groupBy("f1", "f2").agg(smallest.alias("best"))
                         .select("f1", "f2", F.col("best.licence").alias("own_licence"), (-F.col("best.s")).alias("own_score")), "licence-own")

    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")  # whatever the input's columns are called
    placed = files.select(row, path.alias("path"), F.xxhash64(nulls, path, text).alias("f1"),
                          F.xxhash64(F.lit(1), nulls, path, text).alias("f2"), directory.alias("directory")).join(recognised, ["f1", "f2"], "left")
    licence_files = own.filter("is_licence").select("f1", "f2", "path").distinct().join(recognised, ["f1", "f2"])
    given = (licence_files.withColumn("above", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(""))
             .groupBy("above").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_licence")).alias("best"))
             .select("above", F.col("best.own_licence").alias("dir_licence"), (-F.col("best.s")).alias("dir_score"), F.col("best.path").alias("dir_path")))
    parts = F.split("directory", "/", -1)
    upwards = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    nearest = (files.select(directory.alias("directory")).filter("directory is not null").distinct()
               .select("directory", F.explode(F.array_distinct(upwards)).alias("above")).join(given, "above")
               .groupBy("directory").agg(F.max(F.struct(F.length("above").alias("n"), "dir_licence", "dir_score", "dir_path")).alias("up"))
               .select("directory", "up.dir_licence", "up.dir_score", "up.dir_path"))
    has_own = F.col("own_licence").isNotNull()
    return placed.join(nearest, "directory", "left").select(
        *[F.col(f"row.`{c}`") for c in kept],
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(has_own, F.col("own_score")).otherwise(F.col("dir_score")).alias("licence_score"),
        F.when(has_own, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("licence_origin"),
        F.when(has_own, F.col("path")).otherwise(F.col("dir_path")).alias("licence_path"))


# -- query ---------------------------------------------------------------------------------------

def files_of(documents: DataFrame) -> DataFrame:
    """Documents as files: source, language and a numbered directory, one file a document.

    A stand-in for a source tree; every fortieth document has the name of a licence file.
    """
    folder = F.concat_ws("/", "source", "lang", F.pmod("doc_id", F.lit(16)).cast("string"))
    name = F.when(F.col("doc_id") % 640 == 0, F.concat(F.col("source"), F.lit("/LICENSE."), F.col("doc_id"))).when(
        F.col("doc_id") % 40 == 0, F.concat(folder, F.lit("/LICENSE."), F.col("doc_id"))).otherwise(
        F.concat(folder, F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    return documents.select("doc_id", name.alias("path"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory."""
    out = scan_licences(files_of(table(spark, sf_dir, "documents")), TEMPLATES)
    return out.select("doc_id", "path", "licence", F.col("licence_score"), "licence_origin", "licence_path")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH files AS (
  SELECT doc_id, text,
         CASE WHEN doc_id % 640 = 0 THEN source || '/LICENSE.' || doc_id
              WHEN doc_id % 40 = 0 THEN concat_ws('/', source, lang, (doc_id % 16)::VARCHAR) || '/LICENSE.' || doc_id
              ELSE concat_ws('/', source, lang, (doc_id % 16)::VARCHAR) || '/' || doc_id || '.txt' END AS path
  FROM documents),
templates(n, licence, words) AS (VALUES {", ".join(f"({i}, {_sql(a)}, {_sql(b)})" for i, (a, b) in enumerate(TEMPLATES))}),
template_terms AS (
  SELECT n, licence, term, count(*) AS tf
  FROM (SELECT n, licence, unnest(regexp_extract_all(lower(words), '{TERM}')) AS term FROM templates) GROUP BY ALL),
total AS (SELECT count(*) AS files FROM files),
frequency AS (
  SELECT term, count(DISTINCT doc_id) AS df
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM files)
  WHERE term IN (SELECT term FROM template_terms) GROUP BY term),
template_weights AS (
  SELECT n, licence, term, tf * (ln((1 + files) / (1 + coalesce(df, 0))) + 1) AS w
  FROM template_terms LEFT JOIN frequency USING (term), total),
vectors AS (SELECT n, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY n)) AS x FROM template_weights),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM files
  UNION ALL SELECT doc_id, text, 0 FROM files WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}')),
unit_terms AS (
  SELECT doc_id, unit, term, count(*) * (ln((1 + any_value(files)) / (1 + coalesce(any_value(df), 0))) + 1) AS w
  FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(words), '{TERM}')) AS term FROM units)
       LEFT JOIN frequency USING (term), total
  GROUP BY doc_id, unit, term),
lengths AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS l FROM unit_terms GROUP BY ALL),
cosines AS (
  SELECT doc_id, unit, n, licence, round(sum(w * x) / any_value(l), 4) AS score
  FROM unit_terms JOIN vectors USING (term) JOIN lengths USING (doc_id, unit) GROUP BY ALL),
own AS (
  SELECT doc_id, licence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r
  FROM cosines WHERE score >= {THRESHOLD}),
found AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS directory, licence, score
          FROM files LEFT JOIN (SELECT * FROM own WHERE r = 1) USING (doc_id)),
given AS (
  SELECT directory AS above, licence, score, path,
         row_number() OVER (PARTITION BY directory ORDER BY score DESC, path) AS r
  FROM found WHERE licence IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}')),
inherited AS (
  SELECT f.doc_id, g.licence, g.score, g.path,
         row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.above) DESC) AS r
  FROM found f JOIN given g ON g.r = 1 AND starts_with(f.directory || '/', g.above || '/'))
SELECT f.doc_id, f.path, coalesce(f.licence, i.licence) AS licence, coalesce(f.score, i.score) AS licence_score,
       CASE WHEN f.licence IS NOT NULL THEN 'own' WHEN i.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS licence_origin,
       CASE WHEN f.licence IS NOT NULL THEN f.path ELSE i.path END AS licence_path
FROM found f LEFT JOIN (SELECT * FROM inherited WHERE r = 1) i USING (doc_id)
"""
