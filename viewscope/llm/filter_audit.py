"""How five text filters overlap, over every order in which they can run.

Filters A to D look at one text, E at the whole table: a row fails E when a
row of smaller doc_id holds the identical text. All figures of the audit are
sums over (part, set of failed filters), so each row is reduced to a five-bit
mask once and the 120 orders are read off at most 32 counts of each part.

E does not shuffle every text. Each row gives four cells, of one segment, to a
counting Bloom sketch of the text hashes (counters stop at two); partial
sketches are merged by segment. A row that owns a cell alone has a text that
no other row holds: it passes E without being compared. Only the texts of the other
rows are shuffled, to be grouped in full with the least doc_id of each text.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewscope.llm.common import trimmed
from viewscope.session import materialize, ship_package

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"

SEGMENT_BITS = 20               # cells of a segment, as a power of two: 128 KB of bits once merged
SEGMENT_ROWS = 1 << 16          # rows that share a segment: 16 cells a row
MAX_SEGMENTS = 1024             # the merged sketch is broadcast, so at most 128 MB; beyond that a sketch only clears less
_PARTIAL_ROWS = 1 << 20         # hashes a task adds up before it passes a partial sketch on
_HOT_TEXTS = 1000               # a text with more than a thousandth of the rows: fewer than this many

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD_GAP = "[ \\t-\\r]+"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: failure of filters A to D by a text without nulls."""
    words = F.array_remove(F.split(text, _WORD_GAP, -1), "")
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    fails = [F.size(words) < MIN_WORDS,
             100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
             100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
             text.rlike(SYMBOLS)]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]


def _cells(h1: Column, h2: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1)
    return [c.bitwiseAND(mask).cast("int") for c in
            (h1, F.shiftrightunsigned(h1, 20), F.shiftrightunsigned(h1, 40), h2)]


def _segment(h2: Column, segments: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h2, 32), F.lit(segments)).cast("int")


def counting_sketch(hashes: DataFrame, segments: int, bits: int = SEGMENT_BITS) -> DataFrame:
    """(segment, repeated): the cells that rows of ``hashes`` (_h1, _h2) hit at least twice, as bits of longs.

    A task adds up a bounded number of rows and emits its cells once each with a mark for "twice or more", so a text
    that fills a third of the table reaches its segment as four cells a partial sketch. A segment's group holds the
    cells of about ``SEGMENT_ROWS`` rows.
    """
    rows = hashes.select(_segment(F.col("_h2"), segments).alias("_segment"),
                         *[c.alias(f"_c{i}") for i, c in enumerate(_cells(F.col("_h1"), F.col("_h2"), bits))])

    def partial(held):
        flat = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.diff(flat, prepend=-1))
        cells, twice = flat[first], np.diff(first, append=len(flat)) > 1
        at = cells >> bits
        edges = np.flatnonzero(np.diff(at, prepend=-1))
        coded = ((cells & ((1 << bits) - 1)) << 1 | twice).astype("<i4")
        return pd.DataFrame({"_segment": at[edges].astype("int32"),
                             "_cells": [c.tobytes() for c in np.split(coded, edges[1:])]})

    def add(batches):
        held, n = [], 0
        for batch in batches:
            base = batch["_segment"].to_numpy("int64") << bits
            cells = np.sort(np.stack([base | batch[f"_c{i}"].to_numpy("int64") for i in range(4)], axis=1), axis=1)
            # a cell that a row hits with two of its hashes counts once, so equal neighbours of a row go
            fresh = np.ones(cells.shape, bool)
            fresh[:, 1:] = cells[:, 1:] != cells[:, :-1]
            held.append(cells[fresh])
            n += len(batch)
            if n >= _PARTIAL_ROWS:
                yield partial(held)
                held, n = [], 0
        if n:
            yield partial(held)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(1 << bits, np.uint8)
        for cells in group["_cells"]:
            coded = np.frombuffer(cells, "<i4")
            at = coded >> 1            # distinct within a partial sketch
            count[at] = np.minimum(count[at] + 1 + (coded & 1), 2)
        words = np.packbits(count > 1, bitorder="little").view("<i8")
        return pd.DataFrame({"_segment": [group["_segment"].iloc[0]], "_repeated": [words]})

    partials = rows.mapInPandas(trimmed(add), "_segment int, _cells binary")
    return partials.groupBy("_segment").applyInPandas(merge, "_segment int, _repeated array<bigint>")


def _with_repeated(rows: DataFrame, sketch: DataFrame, segments: int, bits: int) -> DataFrame:
    """Adds ``_possible``: whether other rows may hold the text; the sketch is at most ``MAX_SEGMENTS`` rows."""
    def held(cell: Column) -> Column:
        word = F.element_at("_repeated", F.shiftright(cell, 6) + 1)
        return F.getbit(word, cell.bitwiseAND(F.lit(63))) == 1

    cells = _cells(F.col("_h1"), F.col("_h2"), bits)
    test = held(cells[0]) & held(cells[1]) & held(cells[2]) & held(cells[3])
    keyed = rows.withColumn("_segment", _segment(F.col("_h2"), segments))
    return keyed.join(F.broadcast(sketch), "_segment").withColumn("_possible", test).drop("_segment", "_repeated")


def mask_rows(docs: DataFrame, segments: int | None = None, bits: int = SEGMENT_BITS) -> DataFrame:
    """One row (doc_id, part, mask) per row of ``docs``; bit i of the mask is set when filter i fails.

    ``docs`` needs doc_id, text and lang; other columns are ignored. A null text counts as empty, a null lang as part ''.
    A null doc_id is neither smaller nor larger than any other, so such a row never fails E nor makes another fail;
    repeated rows of one id don't fail each other. An empty table gives no rows.
    ``segments`` and ``bits`` size the sketch; they change what is shuffled, not the result.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"),
                       F.coalesce(F.col("lang"), F.lit("")).alias("part"), *_hashes(text))
    facts = materialize(base.select("doc_id", "part", text_mask(F.col("_text")).alias("_mask"), "_h1", "_h2"), "audit-facts")
    n = facts.count()
    segments = segments or min(MAX_SEGMENTS, max(1, -(-n // SEGMENT_ROWS)))
    sketch = materialize(counting_sketch(facts, segments, bits), "audit-sketch")

    tested = _with_repeated(facts, sketch, segments, bits)
    texts = _with_repeated(base.select("doc_id", "_text", "_h1", "_h2"), sketch, segments, bits).filter("_possible")
    # the text itself is the key; its rows find their minimum by its two hashes, so texts are shuffled once
    least = materialize(texts.groupBy("_text").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
                        .filter("_n > 1").select(*_hashes(F.col("_text")), "_least", "_n"), "audit-least")
    hot = least.filter(F.col("_n") > n // _HOT_TEXTS)

    fails_e = F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))
    mask = F.col("_mask") + F.when(fails_e, F.lit(16)).otherwise(F.lit(0))
    key, cols = ["_h1", "_h2"], ["doc_id", "part", mask.alias("mask")]
    clear = tested.filter("NOT _possible").select("doc_id", "part", F.col("_mask").alias("mask"))
    suspects = tested.filter("_possible")
    # a text with a thousandth of all rows or more has fewer than 1,000 companions, so their minimums are broadcast
    of_hot = suspects.join(F.broadcast(hot.select(*key, "_least")), key).select(*cols)
    others = (suspects.join(F.broadcast(hot.select(*key)), key, "left_anti")
              .join(least.join(F.broadcast(hot.select(*key)), key, "left_anti").select(*key, "_least"), key, "left")
              .select(*cols))
    return clear.unionByName(of_hot).unionByName(others)


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic) of ``mask_rows``; a document is good or toxic when any label row says 1.

    Rows are counted by id first, so an id on a third of all rows meets its labels as at most 32 rows a part.
    """
    flags = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL")
             .groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"),
                                    F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")))
    by_id = rows.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("_n"))
    joined = by_id.join(flags, "doc_id", "left")

    def total(cond):
        return F.sum(F.when(cond, F.col("_n")).otherwise(F.lit(0)))

    return joined.groupBy("part", "mask").agg(F.sum("_n").alias("n"), total(F.col("_good") == 1).alias("n_good"),
                                              total(F.col("_toxic") == 1).alias("n_toxic"))


def _order_rules(spark) -> DataFrame:
    """What each step of each order does to a mask: 120 x 5 x 32 rows, whatever the input."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            bit = 1 << f
            for mask in range(1 << len(FILTERS)):
                fails = bool(mask & bit)
                rows.append(("".join(FILTERS[i] for i in order), step + 1, mask,
                             int(not mask & (before | bit)), int(fails and not mask & before),
                             int(fails and bool(mask & before)), int(mask == bit),
                             120 // mask.bit_count() if fails else 0))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, mask int, _kept int, _removed int, "
                                       "_redundant int, _unique int, _share int")


def audit_filters(docs: DataFrame, labels: DataFrame, segments: int | None = None,
                  bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per part, filter order and step with the counts of the audit, zeros included; see ``mask_rows``.

    In a random order each of the m filters that a row fails comes first equally often, so a row adds 120 / m
    removals over all orders (shapley) to each of them.
    """
    counts = mask_counts(mask_rows(docs, segments, bits), labels)

    def total(flag, n="n"):
        return F.sum(F.col(flag) * F.col(n))

    return (counts.join(F.broadcast(_order_rules(docs.sparkSession)), "mask").groupBy("part", "filter_order", "step")
            .agg(total("_kept").alias("kept"), total("_removed").alias("removed"),
                 total("_redundant").alias("redundant"), total("_unique").alias("unique_fails"),
                 total("_removed", "n_good").alias("good_lost"), total("_removed", "n_toxic").alias("toxic_lost"),
                 total("_share").alias("shapley")))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM m LEFT JOIN l USING (doc_id)),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.name || b.name || c.name || g.name || h.name AS filter_order, [a.bit, b.bit, c.bit, g.bit, h.bit] AS bits
      FROM f a JOIN f b ON b.name <> a.name JOIN f c ON c.name NOT IN (a.name, b.name)
      JOIN f g ON g.name NOT IN (a.name, b.name, c.name) JOIN f h ON h.name NOT IN (a.name, b.name, c.name, g.name)),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS seen
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (seen + bit)::INT = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & seen::INT = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & seen::INT <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & seen::INT = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & seen::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""
