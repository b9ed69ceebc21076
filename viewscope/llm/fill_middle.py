"""Fill-in-the-middle rearrangement of texts, as a pipeline of Arrow kernels.

Each batch is cut into units, one list of units a text. The lists are flattened
with the number of their parent, a unit's ordinal is its distance from the
first unit of its parent, and two cut points of each text turn ordinals into
roles (prefix, middle, suffix). The units of a role are filtered out, gathered into
lists again and joined; the pieces of a text are then joined around the
sentinels in the order of its form. No step depends on another text, so there
is no shuffle, and a batch is worked on in slices of bounded bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewscope.llm.common import trimmed

SEED = 42
PLAIN_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SLICE_BYTES = 8 << 20
_CUT = b"\xff"             # never a byte of UTF-8, so it can't be part of a text
_UNIT_END = rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])"   # white space belongs to the word after it

_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers drawn from the id by SHA-256; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def split_units(texts: pa.Array) -> pa.ListArray:
    """The units of each text (large binary): a word with the white space before it, or white space at the end."""
    marked = pc.replace_substring_regex(texts, pattern=_UNIT_END, replacement=rb"\1" + _CUT + rb"\2")
    return pc.split_pattern(marked, pattern=_CUT)


def _joined(flat: pa.Array, parents: np.ndarray, role: np.ndarray, n: int) -> pa.Array:
    """The units with a role, joined to one piece per parent."""
    ends = np.cumsum(np.bincount(parents[role], minlength=n))
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()), pc.filter(flat, pa.array(role)))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def _chars(pieces: pa.Array) -> pa.Array:
    return pc.utf8_length(pieces.cast(pa.large_string()))


def _rearrange(texts: pa.Array, h: list[np.ndarray], plain_percent: int, spm_percent: int,
               sentinels: tuple[str, str, str]) -> pa.RecordBatch:
    n = len(texts)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    units = split_units(texts)
    flat, parents = pc.list_flatten(units), pc.list_parent_indices(units).to_numpy()
    counts = pc.list_value_length(units).to_numpy()
    ordinals = np.arange(len(flat)) - (np.cumsum(counts) - counts)[parents]
    counts = np.where(empty, 0, counts).astype("int64")

    cut1, cut2 = h[0] % (counts + 1), h[1] % (counts + 1)
    low, high = np.minimum(cut1, cut2)[parents], np.maximum(cut1, cut2)[parents]
    prefix = _joined(flat, parents, ordinals < low, n)
    middle = _joined(flat, parents, (ordinals >= low) & (ordinals < high), n)
    suffix = _joined(flat, parents, ordinals >= high, n)

    spelled = np.zeros(n, bool)
    for s in sentinels:
        spelled |= pc.match_substring(texts, s.encode()).to_numpy(zero_copy_only=False)
    plain = empty | spelled | (h[2] % 100 >= plain_percent)
    spm = h[3] % 100 < spm_percent
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in sentinels)
    no_gap = pa.scalar(b"", pa.large_binary())
    as_psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, no_gap)
    as_spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, no_gap)
    is_plain, is_spm = pa.array(plain), pa.array(spm)
    output = pc.if_else(is_plain, texts, pc.if_else(is_spm, as_spm, as_psm))
    form = pc.if_else(is_plain, "plain", pc.if_else(is_spm, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    return pa.record_batch(
        [pa.array(counts), form, pc.if_else(is_plain, none, _chars(prefix).cast(pa.int64())),
         pc.if_else(is_plain, none, _chars(middle).cast(pa.int64())), output.cast(pa.large_string())],
        names=["n", "form", "prefix_chars", "middle_chars", "output"])


def _slices(sizes: np.ndarray):
    """(start, stop) of runs of rows of about ``_SLICE_BYTES``."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > _SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT,
                   sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Rearranged texts: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``docs`` needs doc_id and text (UTF-8); other columns are ignored. A null text counts as empty; an empty text, one that
    spells a sentinel, and ``100 - plain_percent`` percent of the rest stay plain, with null piece lengths. Cuts follow from
    the id alone, so repeated rows give equal rows, and a null id draws as an empty id. An empty table gives no rows.
    """
    def run(batches):
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary())
            h = [batch.column(f"_h{i}").to_numpy() for i in range(4)]
            for a, b in _slices(pc.binary_length(texts).to_numpy()):
                got = _rearrange(texts.slice(a, b - a), [x[a:b] for x in h], plain_percent, spm_percent, sentinels)
                output = got.column("output").cast(pa.string())
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), *got.columns[:-1], output],
                                      names=["doc_id", *got.schema.names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"),
                       *[d.alias(f"_h{i}") for i, d in enumerate(draws(F.col("doc_id"), seed))])
    return rows.mapInArrow(trimmed(run), "doc_id long, " + _SCHEMA)


def restored_text(form: Column, output: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text a row was made of, from its output and form alone."""
    pieces = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    first, second, middle = (F.get(pieces, F.lit(i)) for i in (1, 2, 3))
    return (F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second))
            .otherwise(F.concat(second, middle, first)))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of ``fill_in_middle`` with its defaults."""
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored_text(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
           FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS y,
             ('0x' || d[17:24])::BIGINT % 100 AS p, ('0x' || d[25:32])::BIGINT % 100 AS q FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p >= 50 THEN 'plain'
                     WHEN q < 80 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid,
             array_to_string(u[greatest(x, y) + 1:], '') AS suf FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM f"""
