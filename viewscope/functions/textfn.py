"""Tokenizer as pure column expressions (X1): no Python per row.

Tokens: lower-cased runs of two or more ASCII letters between word
boundaries, English stop words removed, then unigrams followed by bigrams of
adjacent kept tokens (a bigram may bridge a removed stop word).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewscope.functions.stopwords import ENGLISH

TOKEN_PATTERN = r"(?U)\b[a-zA-Z][a-zA-Z]+\b"


def english_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop-word list."""
    return ENGLISH


def tokens(col: str | Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Array of kept unigram tokens, in text order."""
    c = F.col(col) if isinstance(col, str) else col
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    stops = tuple(stop_words if stop_words is not None else english_stop_words())
    # a literal list of this size becomes a hashed set, not a scan per token
    return F.filter(words, lambda w: ~w.isin(*stops)) if stops else words


def uni_bigrams(unigrams: Column) -> Column:
    """Unigrams followed by bigrams of adjacent unigrams.

    ``unigrams`` is referenced several times, so it must be a bound value (see
    ``terms``); an inlined tokenizer would run once per reference.
    """
    n = F.size(unigrams)
    pairs = F.arrays_zip(F.slice(unigrams, 1, F.greatest(n - 1, F.lit(0))),
                         F.slice(unigrams, 2, F.greatest(n - 1, F.lit(0))))
    bigrams = F.transform(pairs, lambda p: F.concat(p.getField("0"), F.lit(" "), p.getField("1")))
    return F.concat(unigrams, F.coalesce(bigrams, F.array().cast("array<string>")))


def terms(col: str | Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Unigrams then bigrams. The unigram array is bound once through a one-element
    ``transform`` so the tokenizer is not re-evaluated for every reference."""
    bound = F.transform(F.array(tokens(col, stop_words)), lambda u: uni_bigrams(u))
    return F.element_at(bound, 1)


def with_terms(df, text_col: str, out_col: str = "_terms", stop_words: tuple[str, ...] | None = None):
    """Add the unigram+bigram array of ``text_col``; the tokenizer runs once per row."""
    return df.withColumn(out_col, terms(text_col, stop_words))
