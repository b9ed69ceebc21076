"""TF-IDF over titles, similar titles and token lift.

Weights follow the smoothed TF-IDF definition: raw term count times
ln((1 + n) / (1 + df)) + 1, then each document's vector scaled to unit length.

Everything is sparse: a postings table (doc, term, weight). Similarity of
one anchor against all documents joins the anchor's few postings (broadcast,
bounded by the anchor's own length) to the postings on the term and sums per
document; no n x n matrix exists anywhere. Document frequencies and lifts are
partial aggregates per term; the weights of common terms are broadcast. Long
texts, most of whose terms are rare, go by ``functions.longtext``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewscope.functions.distribute import tasks_for
from viewscope.functions.longtext import long_text_postings
from viewscope.functions.numeric import fixed
from viewscope.functions.quantile import exact_quantiles
from viewscope.functions.textfn import with_terms
from viewscope.session import materialize


def title_terms(df: DataFrame, id_col: str = "video_id", text_col: str = "title",
                stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """(id, term, position) for every unigram and bigram of every text."""
    return (with_terms(df.select(id_col, text_col), text_col, "_t", stop_words)
            .select(id_col, F.posexplode("_t").alias("position", "term")))


TEXT_CHARS_PER_TASK = 4_000_000
TERM_SHARE = 100_000        # terms with more than this fraction of all postings are broadcast, fewer than this many
LONG_TEXT = 1_000           # characters; texts longer than this on average have mostly rare terms
LIFT_FLOOR = 500            # of long texts, lifts that can't exceed one in so many are left for a second pass


def _extent(df: DataFrame, text_col: str) -> tuple[int, int, bool]:
    """(number of texts, characters of all, whether they are long)."""
    n_docs, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    return n_docs, chars, chars > LONG_TEXT * n_docs


def tfidf(df: DataFrame, id_col: str = "video_id", text_col: str = "title",
          stop_words: tuple[str, ...] | None = None, carry: tuple[str, ...] = (), least_df: int = 0,
          extent: tuple[int, int, bool] | None = None) -> DataFrame:
    """Postings (id, term, tf, idf, weight) with unit-length document vectors.

    ``carry`` names further columns of a document that its postings keep. Texts, which are far smaller than their postings,
    are dealt by id into tasks of a bounded length, once for the document frequencies and again for the weights.
    Postings then stay with their document: only those of rare terms leave it to fetch their weight. Of long texts none do.
    Only postings of terms that more than ``least_df`` documents have come out; weights take all terms into account.
    ``extent`` is a result of ``_extent`` to share.
    """
    n_docs, chars, long_texts = extent or _extent(df, text_col)
    parts = tasks_for(df.sparkSession, chars, TEXT_CHARS_PER_TASK)
    if long_texts:
        return long_text_postings(df, id_col, text_col, stop_words, carry, n_docs, chars, parts, least_df)
    tf = (with_terms(df.select(id_col, *carry, text_col).repartition(parts, id_col), text_col, "_t", stop_words)
          # an inner explode would have Spark test the terms before the shuffle as well, so split every text twice
          .select(id_col, *carry, F.explode_outer("_t").alias("term")).where(F.col("term").isNotNull())
          .groupBy(id_col, *carry, "term").agg(F.count(F.lit(1)).alias("tf")))
    freq = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                       .withColumn("idf", F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1), "document-frequencies")
    terms, total = freq.agg(F.count(F.lit(1)), F.sum("df")).first()
    least = 0 if terms <= TERM_SHARE else total // TERM_SHARE
    found = tf.join(F.broadcast(freq.where(F.col("df") > least)), "term")    # at most TERM_SHARE terms
    if least:
        rare = (tf.join(F.broadcast(freq.where(F.col("df") > least).select("term")), "term", "left_anti")
                .join(freq.where(F.col("df") <= least), "term"))
        found = found.unionByName(rare.repartition(parts, id_col))
    raw = found.withColumn("_w", F.col("tf") * F.col("idf"))
    # one document's terms per window group: bounded by that document's length
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    found = raw.select(id_col, *carry, "term", "tf", "idf", (F.col("_w") / norm).alias("weight"), "df")
    return (found.where(F.col("df") > least_df) if least_df else found).drop("df")


def similar_titles(df: DataFrame, video_id: int, top_n: int = 5, postings: DataFrame | None = None) -> DataFrame:
    """The ``top_n`` titles most similar to the anchor (cosine), anchor excluded.

    Every other item is a candidate (similarity 0 when no term is shared), so
    exactly ``top_n`` rows come back when the table has that many. An unknown
    anchor raises KeyError. Ties are broken by the smaller id.
    """
    if not 1 <= top_n <= 20:
        raise ValueError("top_n must be between 1 and 20")
    if df.where(F.col("video_id") == video_id).limit(1).count() == 0:
        raise KeyError(f"video_id {video_id} not found")
    post = postings if postings is not None else tfidf(df)
    anchor = (post.where(F.col("video_id") == video_id)
              .select("term", F.col("weight").alias("_aw")))
    dots = (post.join(F.broadcast(anchor), "term")      # bounded by the anchor's own length
            .groupBy("video_id").agg(F.sum(F.col("weight") * F.col("_aw")).alias("_sim")))
    rest = df.where(F.col("video_id") != video_id).select(
        "video_id", "title", "category", "thumbnail_style", "views", "engagement_rate_pct")
    # order on a 10-decimal snap so summation-order noise cannot reorder exact ties
    near = dots.where((F.col("video_id") != video_id) & (fixed("_sim", 10) > 0)).orderBy(
        fixed("_sim", 10).desc(), F.col("video_id").asc()).limit(top_n)
    # the least ids fill up with similarity 0 when fewer than top_n titles share a term
    fill = rest.select("video_id").orderBy("video_id").limit(2 * top_n).select("video_id", F.lit(0.0).alias("_sim"))
    best = near.unionByName(fill).groupBy("video_id").agg(F.max("_sim").alias("similarity")).orderBy(
        fixed("similarity", 10).desc(), F.col("video_id").asc()).limit(top_n)
    top = rest.join(F.broadcast(best), "video_id").orderBy(   # top_n rows
        fixed("similarity", 10).desc(), F.col("video_id").asc())
    return top.select("video_id", "title", "category", "thumbnail_style", "views",
                      fixed("engagement_rate_pct", 4).alias("engagement_rate_pct"),
                      fixed("similarity", 4).alias("similarity"))


def similar_report(df: DataFrame, video_id: int, top_n: int = 5, postings: DataFrame | None = None) -> DataFrame:
    """X3 with its anchor: the anchor's card as rank 0 (null similarity), then ``similar_titles`` as ranks 1..n."""
    shown = ["video_id", "title", "category", "thumbnail_style", "views", "engagement_rate_pct"]
    similar = similar_titles(df, video_id, top_n, postings)
    w = Window.orderBy(F.col("similarity").desc(), "video_id")      # at most 20 rows
    ranked = similar.select(F.row_number().over(w).alias("rank"), *shown, "similarity")
    anchor = df.where(F.col("video_id") == video_id).select(
        F.lit(0).alias("rank"), *shown[:-1], fixed("engagement_rate_pct", 4).alias("engagement_rate_pct"),
        F.lit(None).cast("double").alias("similarity"))
    return anchor.unionByName(ranked)


def token_lift(df: DataFrame, target: str = "views", top_n: int = 12,
               stop_words: tuple[str, ...] | None = None, text_col: str = "title",
               id_col: str = "video_id") -> DataFrame:
    """Terms whose mean weight is higher in the top quartile of ``target``.

    high = target >= its 75th percentile; lift = mean weight over high rows
    minus mean weight over the other rows (absent terms count as 0). The
    ``top_n`` largest lifts are kept, then only positive ones.
    """
    thr = exact_quantiles(df, target, [0.75], prefix="thr").withColumn("_k", F.lit(0))
    flagged = (df.select(id_col, text_col, target).withColumn("_k", F.lit(0))
               .join(F.broadcast(thr), "_k")       # one-row side
               .select(id_col, text_col, (F.col(target) >= F.col("thr0")).alias("_high")))
    sizes = flagged.agg(F.count_if("_high").alias("_nh"), F.count_if(~F.col("_high")).alias("_nr")) \
                   .withColumn("_k", F.lit(0))
    extent = _extent(flagged, text_col)

    def best(least_df: int) -> DataFrame:
        post = tfidf(flagged, id_col=id_col, text_col=text_col, stop_words=stop_words, carry=("_high",),
                     least_df=least_df, extent=extent)
        per_term = (post.groupBy("term").agg(F.sum(F.when(F.col("_high"), F.col("weight")).otherwise(0.0)).alias("_sh"),
                                             F.sum(F.when(~F.col("_high"), F.col("weight")).otherwise(0.0)).alias("_sr"))
                    .withColumn("_k", F.lit(0))
                    .join(F.broadcast(sizes), "_k")    # one-row side
                    .where(F.col("_nr") > 0)
                    .withColumn("_lift", F.col("_sh") / F.col("_nh") - F.col("_sr") / F.col("_nr")))
        return per_term.orderBy(fixed("_lift", 10).desc(), F.col("term").asc()).limit(top_n).select("term", "_lift")

    top = _best_of_long_texts(best, sizes.first()["_nh"], top_n) if extent[2] else best(0)
    return top.where(F.col("_lift") > 0).select("term", fixed("_lift", 4).alias("lift"))


def _best_of_long_texts(best, n_high: int, top_n: int) -> DataFrame:
    """``best(0)``, without adding up the weights of terms too rare to be among it.

    No weight exceeds 1, so a term of ``df`` documents has a lift of ``df`` / ``n_high`` at most. The terms above a first bound
    are ranked; when the last of the ``top_n`` does not exceed what the others can reach, the bound is lowered to that
    lift and all terms above it are ranked.
    """
    bound = n_high // LIFT_FLOOR
    frame = best(bound)
    rows = frame.collect()                            # top_n rows
    if bound:
        last = rows[-1]["_lift"] - 1e-9 if len(rows) == top_n else 0.0     # ranks are snapped to ten decimals
        if last * n_high <= bound:
            frame = best(max(0, math.floor(last * n_high) - 1))
            rows = frame.collect()
    return frame.sparkSession.createDataFrame([tuple(r) for r in rows], frame.schema)
