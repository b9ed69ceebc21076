"""TF-IDF postings of long texts: most of their terms are rare, so postings outweigh the texts many times.

Words are dealt by document into parts of a bounded length, once. A part sends each of its distinct terms a single time, packed by
hash into buckets; a bucket adds up the document frequencies and answers with bare numbers in the order it was asked.
Postings stay with their part. The order is that of the bucket and the term, so it doesn't depend on the order of rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from viewscope.functions.distribute import tasks_for
from viewscope.functions.textfn import tokens

BUCKET_CHARS = 32_000_000   # of text to a bucket of terms: about four million terms of all parts
_ROWS_A_BATCH = 100_000
_ASKED = "_part int, _bucket int, n int, size long, terms binary, counts binary"
_ANSWERED = "_part int, _bucket int, n int, sum long, df binary"


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers, "<i8").tobytes(), codec="zstd", asbytes=True)


def _unpacked(numbers: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(numbers, 8 * n, codec="zstd"), "<i8")


def _groups(columns: list[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group, a row of each group) of rows with like values; nulls are alike."""
    code = np.zeros(len(columns[0]), "int64")
    for c in columns:
        values = c.combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(values.dictionary) + 1) + values.indices.to_numpy(), return_inverse=True)[1]
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first


def _postings(words: pa.ChunkedArray, group: np.ndarray, buckets: int) -> tuple[pa.Array, np.ndarray, tuple]:
    """(terms by bucket and term, their buckets, (document, number of the term, term frequency) of each posting)."""
    some = pc.greater(pc.binary_length(words), 0)
    lists = pc.split_pattern(words.filter(some).combine_chunks(), " ")
    row = np.repeat(group[some.to_numpy()], pc.list_value_length(lists).to_numpy())
    text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    single = lists.flatten().dictionary_encode()
    code, vocabulary = single.indices.to_numpy().astype("int64"), single.dictionary
    near = text[:-1] == text[1:]
    pairs, pair = np.unique((code[:-1] * len(vocabulary) + code[1:])[near], return_inverse=True)
    left, right = (vocabulary.take(pa.array(x)) for x in np.divmod(pairs, max(len(vocabulary), 1)))
    terms = pa.concat_arrays([vocabulary, pc.binary_join_element_wise(left, right, " ")])
    found = np.concatenate([row, row[:-1][near]]) * len(terms) + np.concatenate([code, len(vocabulary) + pair])
    found, tf = np.unique(found, return_counts=True)
    doc, term = np.divmod(found, max(len(terms), 1))
    bucket = (pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype("int32")
    order = pc.sort_indices(pa.table({"b": bucket, "t": terms}), sort_keys=[("b", "ascending"), ("t", "ascending")])
    at = np.empty(len(terms), "int64")
    at[order.to_numpy()] = np.arange(len(terms))
    return terms.take(order), bucket[order.to_numpy()], (doc, at[term], tf)


def _slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first term, end) of each bucket that has terms."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, "int64")
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(start, [*start[1:], len(bucket)])]


def _text(terms: pa.Array) -> pa.Buffer:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms), "\n")[0].as_buffer()


def _ask(buckets: int, keys: list[str]):
    def ask(table: pa.Table) -> pa.Table:
        group, _ = _groups([table[k] for k in keys])
        terms, bucket, (_, term, _) = _postings(table["_words"], group, buckets)
        part, counts, rows = table["_part"][0].as_py(), np.bincount(term, minlength=len(terms)), []
        for b, i, j in _slices(bucket):
            text = _text(terms[i:j])
            rows.append((part, b, j - i, text.size, pa.compress(text, codec="zstd", asbytes=True), _packed(counts[i:j])))
        return _table(rows, _ASKED)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    asked = table.to_pylist()
    texts = [pa.decompress(r["terms"], r["size"], codec="zstd") for r in asked]
    terms = pa.concat_arrays([pc.split_pattern(pa.array([x.to_pybytes()], pa.binary()).cast(pa.string()), "\n").flatten() for x in texts])
    code = terms.dictionary_encode().indices.to_numpy()
    df = np.bincount(code, np.concatenate([_unpacked(r["counts"], r["n"]) for r in asked])).astype("int64")
    end = np.cumsum([r["n"] for r in asked])
    return _table([(r["_part"], r["_bucket"], r["n"], zlib.crc32(x), _packed(df[code[e - r["n"]:e]]))
                   for r, x, e in zip(asked, texts, end)], _ANSWERED)


def _weigh(n_docs: int, buckets: int, id_col: str, carry: tuple[str, ...], least_df: int, schema: pa.Schema):
    def weigh(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        group, first = _groups([table[c] for c in (id_col, *carry)])
        terms, bucket, (doc, term, tf) = _postings(table["_words"], group, buckets)
        said = sorted(answers.to_pylist(), key=lambda r: r["_bucket"])
        if [(r["_bucket"], r["n"], r["sum"]) for r in said] != [
                (b, j - i, zlib.crc32(_text(terms[i:j]))) for b, i, j in _slices(bucket)]:
            raise RuntimeError("document frequencies don't match the terms they were asked for")
        df = np.concatenate([np.empty(0, "int64"), *(_unpacked(r["df"], r["n"]) for r in said)])
        idf = np.log((1 + n_docs) / (1 + df)) + 1
        weight = tf * idf[term]
        owner = _groups([table[id_col]])[0][first][doc]       # rows of one id are scaled together, whatever they carry
        weight = weight / np.sqrt(np.bincount(owner, weight * weight))[owner] if len(owner) else weight
        kept = df[term] > least_df
        doc, term, tf, weight = doc[kept], term[kept], tf[kept], weight[kept]
        owners, out = table.select([id_col, *carry]).take(pa.array(first)), []
        for i in range(0, len(doc), _ROWS_A_BATCH):
            cut = slice(i, i + _ROWS_A_BATCH)
            out.append(pa.table([*owners.take(pa.array(doc[cut])).columns, terms.take(pa.array(term[cut])), pa.array(tf[cut]),
                                 pa.array(idf[term[cut]]), pa.array(weight[cut])], names=schema.names).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return weigh


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (f.split(" ") for f in schema.split(", "))]
    return pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def long_text_postings(df: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...] | None, carry: tuple[str, ...],
                       n_docs: int, chars: int, parts: int, least_df: int = 0) -> DataFrame:
    """(id, carried columns, term, tf, idf, weight) as ``operators.text.tfidf`` defines them."""
    buckets = tasks_for(df.sparkSession, chars, BUCKET_CHARS)
    words = (df.select(id_col, *carry, F.array_join(tokens(text_col, stop_words), " ").alias("_words"))
             .withColumn("_part", F.pmod(F.hash(id_col), F.lit(parts))).repartition(parts, "_part"))
    asked = words.groupBy("_part").applyInArrow(_ask(buckets, [id_col, *carry]), _ASKED)
    answers = (asked.repartition(buckets, "_bucket").groupBy("_bucket").applyInArrow(_answer, _ANSWERED)
               .repartition(parts, "_part"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in words.select(id_col, *carry).schema),
                           T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()),
                           T.StructField("idf", T.DoubleType()), T.StructField("weight", T.DoubleType())])
    weigh = _weigh(n_docs, buckets, id_col, carry, least_df, to_arrow_schema(schema))
    return words.groupBy("_part").cogroup(answers.groupBy("_part")).applyInArrow(weigh, schema)
