"""License notices in texts, found by diagonal voting.

Every rolling word k-gram of every text is joined by hash with the k-grams of the
templates (a small fixed table, so the join is a broadcast and unmatched grams
never leave their task). A match at word p of the text and q of the template
votes for diagonal p - q; copies of a template pile up on one diagonal, and
inserted or lost words move the rest of a copy to a neighbouring one. So
the votes of diagonals up to ``SLACK`` apart are merged, and a span is accepted
when they cover enough distinct template grams. Matched grams are compared word for
word, not by hash alone.

Base phrases are templates too: a place needs all votes of its diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewscope.session import materialize

GRAM = 2                        # the shortest base phrases have two words
SLACK = 4                       # words inserted into or missing from a copy
MIN_COVER_PERCENT = 85          # share of a template's grams that a span must hold


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# fixed values: base phrases of the contract, then the opening words of well-known public license notices
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                    "fee is hereby granted"),
    Template("mpl", "subject to the terms of the Mozilla Public License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc0", "waived all copyright and related or neighboring rights to this work"),
    Template("cc-by", "Licensed under CC BY 4.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def text_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of a-z, 0-9 and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _GAP, -1), "")


def _template_words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in _UPPER else c for c in text))


def template_rows(templates=TEMPLATES, k: int = GRAM) -> list[tuple]:
    """(template, label, base, n_grams, position, gram) of every k-gram of every template."""
    rows = []
    for t, template in enumerate(templates):
        words = _template_words(template.text)
        n = len(words) - k + 1
        if n < 1:
            raise ValueError(f"template {template.text!r} has fewer than {k} words")
        rows += [(t, template.label, template.base, n, q, " ".join(words[q:q + k])) for q in range(n)]
    return rows


def diagonal_votes(docs: DataFrame, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """Votes by row, template and diagonal: row, doc_id, n_words, template, label, base, n_grams, diagonal, held, votes.

    ``held`` lists the template positions that voted. Each row of ``docs`` also has one line without a template,
    so texts without a match keep their word count. ``row`` numbers the rows of ``docs``, as ids may repeat or be null.
    """
    spark = docs.sparkSession
    grams = (spark.createDataFrame(template_rows(templates, k), "template int, label string, base boolean, n_grams int, _q int, _gram string")
             .withColumn("_hash", F.xxhash64("_gram")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       text_words(F.col("text")).alias("_words"))
    n = F.size("_words")
    rolling = F.transform(F.slice("_words", 1, F.greatest(n - (k - 1), F.lit(0))), lambda word, i: F.concat_ws(
        " ", word, *[F.get("_words", i + j) for j in range(1, k)]))
    # element 0 is the line of the row itself; word positions follow from 1. The words end here: exploded rows are narrow
    listed = (rows.select("row", "doc_id", n.cast("long").alias("n_words"), F.concat(F.array(F.lit("")), rolling).alias("_grams"))
              .select("row", "doc_id", "n_words", F.posexplode_outer("_grams").alias("_p", "_at")))
    matched = (listed.withColumn("_key", F.xxhash64("_at"))
               .join(F.broadcast(grams), (F.col("_key") == F.col("_hash")) & (F.col("_at") == F.col("_gram")), "left")
               .filter("template IS NOT NULL OR _p = 0"))
    return matched.groupBy("row", "doc_id", "n_words", "template", "label", "base", "n_grams",
                           (F.col("_p") - 1 - F.col("_q")).cast("long").alias("diagonal")).agg(
        F.collect_list("_q").alias("held"), F.count("_q").alias("votes"))


def license_spans(votes: DataFrame, k: int = GRAM, slack: int = SLACK,
                  min_cover_percent: int = MIN_COVER_PERCENT) -> DataFrame:
    """Accepted spans: row, doc_id, template, label, base, first_word, last_word, cover.

    A base phrase gives one span per place. For other templates the diagonals within ``slack`` of a diagonal are merged
    around it, so a span exceeds its template by 2 x slack words at most; overlapping spans of one copy all come out.
    """
    columns = ["row", "doc_id", "template", "label", "base"]
    base = (votes.filter("base AND votes = n_grams")
            .select(*columns, F.col("diagonal").alias("first_word"),
                    (F.col("diagonal") + F.col("n_grams") + (k - 2)).alias("last_word"), F.lit(1.0).alias("cover")))
    own = Window.partitionBy("row", "template")
    near = own.orderBy("diagonal").rangeBetween(-slack, slack)
    enough = 100 * F.col("_cover") >= min_cover_percent * F.col("n_grams")
    merged = (votes.filter("NOT base").withColumn("_all", F.sum("votes").over(own))
              .filter(100 * F.col("_all") >= min_cover_percent * F.col("n_grams"))
              .withColumn("_cover", F.size(F.array_distinct(F.flatten(F.collect_list("held").over(near)))))
              .withColumn("first_word", F.min(F.col("diagonal") + F.array_min("held")).over(near))
              .withColumn("last_word", F.max(F.col("diagonal") + F.array_max("held")).over(near) + (k - 1))
              .filter(enough)
              .select(*columns, "first_word", "last_word", (F.col("_cover") / F.col("n_grams")).alias("cover")))
    return base.unionByName(merged)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``docs`` needs doc_id and text; other columns are ignored. n_base counts the places of base phrases, first_word
    and last_word are the first words of the first and last place (null without one). Labels are sorted, distinct and comma-joined,
    '' if there are none; score is the best cover of an accepted span, 0 without one. Null or empty texts have no words;
    repeated rows give repeated rows; an empty table gives none.
    """
    votes = materialize(diagonal_votes(docs, templates, k), "license-votes")
    found = license_spans(votes, k).select("row", "label", "base", "first_word", "cover")
    whole = votes.filter("template IS NULL").select("row", "doc_id", "n_words")
    place = F.when(F.col("base"), F.col("first_word"))

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(which)), ",")

    by_row = found.groupBy("row").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"), labels(F.col("label")).alias("labels"),
        F.max("cover").alias("score"))
    return whole.join(by_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _oracle() -> str:
    rows = ",\n".join(f"({t}, '{label}', {str(base).lower()}, {n}, {q}, '{gram}')"
                      for t, label, base, n, q, gram in template_rows())
    return rf"""
WITH g(template, label, base, n_grams, q, gram) AS (VALUES
{rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(0, len(w) - 1)) AS i FROM d)),
v AS (SELECT r, template, label, base, n_grams, i - q AS diagonal, list(q) AS held, count(*) AS votes
      FROM p JOIN g USING (gram) GROUP BY ALL),
m AS (SELECT r, label, len(list_distinct(flatten(list(held) OVER (PARTITION BY r, template ORDER BY diagonal
             RANGE BETWEEN {SLACK} PRECEDING AND {SLACK} FOLLOWING)))) AS cover, n_grams FROM v WHERE NOT base),
f AS (SELECT r, label, diagonal AS place, 1.0::DOUBLE AS cover FROM v WHERE base AND votes = n_grams
      UNION ALL SELECT r, label, NULL, cover / n_grams FROM m WHERE 100 * cover >= {MIN_COVER_PERCENT} * n_grams),
a AS (SELECT r, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place IS NOT NULL) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)"""


ORACLE = _oracle()
