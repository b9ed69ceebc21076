"""Language identification by nearest centroid.

A text becomes the TF-IDF vector of its hashed letter 1- to 3-grams, over the
whole text, with unit length. Each language has several centroids (spherical
k-means of its training vectors); a text gets the language of the centroid of
highest cosine, and is rejected when it is farther from that centroid than
all but a small share of the training texts by a wide margin.

Fitting uses a documented, bounded sample: about ``per_lang`` texts of each
language, drawn by a hash of the id. Prediction reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewscope.llm.common import null_ids, trimmed, with_id
from viewscope.session import ship_package

BUCKETS = 1 << 13
PER_LANG = 400        # training texts of a language, about
CENTROIDS = 4
ITERATIONS = 8
MARGIN = 0.3          # accepted down to this share of the training texts' low cosine
UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: 1 for a letter; one table a worker."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _LETTER[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter 1- to 3-grams (a blank where other characters are); None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]     # one blank after every run of letters
    x = np.where(letter, codes, 32)[keep].astype(np.uint32)
    x = np.concatenate([np.array([32], np.uint32), x])
    grams = [x[1:] * np.uint32(2654435761)]
    if len(x) > 1:
        two = x[:-1] * np.uint32(2246822519) + x[1:] * np.uint32(3266489917)
        grams.append(two)
    if len(x) > 2:
        grams.append(two[:-1] * np.uint32(668265263) + x[2:] * np.uint32(374761393))
    h = np.concatenate(grams)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return np.bincount(h >> np.uint32(32 - 13), minlength=BUCKETS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, unit-length TF-IDF values)."""
    at = np.flatnonzero(counts)
    v = (1.0 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(v @ v)
    return at, v / norm if norm else v


@dataclass
class LanguageModel:
    langs: list[str]          # language of each centroid
    centroids: np.ndarray     # (BUCKETS, centroids)
    floor: np.ndarray         # least cosine accepted by each centroid
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine clipped to 0..1, rejected)."""
        counts = gram_counts(text)
        if counts is None or not self.langs:
            return UNDETERMINED, 0.0, True
        at, v = _weighted(counts, self.idf)
        cos = v @ self.centroids[at]
        best = int(np.argmax(cos))
        return self.langs[best], float(min(max(cos[best], 0.0), 1.0)), bool(cos[best] < self.floor[best])


def _cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-point starts: (centroids, label of each row)."""
    mean = x.mean(axis=0)
    centers = [x[int(np.argmax(x @ mean))]]
    while len(centers) < min(k, len(x)):
        near = np.max(x @ np.array(centers).T, axis=1)
        if near.min() > 1 - 1e-9:
            break
        centers.append(x[int(np.argmin(near))])
    c = np.array(centers)
    for _ in range(ITERATIONS):
        label = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (label == j).any():
                m = x[label == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


def fit(labelled: DataFrame, per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on doc_id, text, lang (rows without lang, or without letters, take no part).

    At most about ``per_lang`` texts of a language are used: rows whose id hash
    lies below per_lang / (rows of the language). With no labelled row at all
    every text comes out undetermined.
    """
    ship_package(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(per_lang / n)).otherwise(share)

    def vectors(batches):
        for batch in batches:
            got = [(lang, gram_counts(t)) for lang, t in zip(batch["lang"], batch["text"])]
            got = [(lang, c) for lang, c in got if c is not None]
            yield pd.DataFrame({"lang": [g[0] for g in got],
                                "at": [np.flatnonzero(g[1]).astype("int32") for g in got],
                                "n": [g[1][g[1] > 0].astype("int32") for g in got]})

    # the sample is bounded by the parameter, so the vectors may be gathered
    sample = rows.where(unit < share).mapInPandas(trimmed(vectors), "lang string, at array<int>, n array<int>").toPandas()
    df = np.zeros(BUCKETS)
    for at in sample["at"]:
        df[np.asarray(at, int)] += 1
    idf = np.log((1 + len(sample)) / (1 + df)) + 1.0
    langs, columns, floor = [], [], []
    for lang, group in sample.groupby("lang", sort=True):
        x = np.zeros((len(group), BUCKETS), np.float32)
        for row, (at, n) in enumerate(zip(group["at"], group["n"])):
            counts = np.zeros(BUCKETS, int)
            counts[np.asarray(at, int)] = n
            at, v = _weighted(counts, idf)
            x[row, at] = v
        c, label = _cluster(x, centroids)
        for j in range(len(c)):
            cos = (x[label == j] @ c[j]) if (label == j).any() else np.ones(1)
            langs.append(lang)
            columns.append(c[j])
            floor.append(MARGIN * float(np.quantile(cos, 0.01)))
    matrix = np.array(columns, np.float32).T.copy() if columns else np.zeros((BUCKETS, 0), np.float32)
    return LanguageModel(langs, matrix, np.array(floor), idf)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of ``docs`` (doc_id, text).

    A text that is null or has no letters is ``und`` with score 0, rejected.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)   # BUCKETS x centroids floats

    def run(batches):
        m = shared.value
        for batch in batches:
            out = pd.DataFrame([m.predict(t) for t in batch["text"]], columns=["lang_pred", "score", "rejected"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return null_ids(with_id(docs, "doc_id", "text").mapInPandas(
        trimmed(run), "doc_id long, lang_pred string, score double, rejected boolean"))


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text the model, fitted on their own lang column, doesn't reject.

    Columns stay. Each row is judged by itself: repeated ids are allowed.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):   # Arrow batches, as pandas would turn ids with nulls among them into floats
        for batch in batches:
            yield batch.filter(pa.array([not shared.value.predict(t)[2] for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; fitted on the documents that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")



