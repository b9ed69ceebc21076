"""Quality classifier with hierarchical empirical Bayes.

1. Document evidence: a logistic model over the shape of the whole text
   (shares of character classes, word lengths, repetition, line structure),
   fitted on a bounded sample of labelled documents.
2. Site evidence: documents are grouped by host and by path below it; each
   group's count and sum of evidence come from one grouped aggregation over
   all documents. A labelled document counts with its label, any other with
   its probability. A path's rate is shrunk toward its host's, a host's toward
   the global rate, with strengths from the method of moments, so sparse sites
   stay near their prior.
3. A document's own evidence is left out of its site's rates. The posterior
   log-odds add the site's shift against the global rate, times a weight, to
   the document's evidence; the weight is the one of WEIGHTS under which all
   labelled documents are likeliest. Documents below 0.5 are rejected.

In ``documents`` the host is ``source`` and the path below it ``lang``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewscope.llm.common import NULL_ID, null_ids, trimmed, unused
from viewscope.session import materialize, ship_package

SAMPLE = 6_000          # labelled documents used to fit, about
WEIGHTS = [w / 20 for w in range(31)]   # of a site's log-odds shift, to choose from
SITE_WEIGHT = 0.5       # the weight where no document is labelled
THRESHOLD = 0.5
FEATURES = 16

_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """By byte: 0 lower/other letters, 1 upper case, 2 digit, 3 blank, 4 line end, 5 . and ,, 6 other signs, 7 UTF-8."""
    if not _CLASS:
        t = np.full(256, 6, np.uint8)
        t[ord("a"):ord("z") + 1] = 0
        t[ord("A"):ord("Z") + 1] = 1
        t[ord("0"):ord("9") + 1] = 2
        t[[32, 9]] = 3
        t[[10, 13]] = 4
        t[[ord("."), ord(",")]] = 5
        t[128:] = 7
        _CLASS.append(t)
    return _CLASS[0]


def text_features(text: str | None) -> np.ndarray:
    """Shape of the whole text, each value in 0..1 or a bounded logarithm; zeros for an empty one."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    raw = text.encode()
    kind = _classes()[np.frombuffer(raw, np.uint8)]
    out[:8] = np.bincount(kind, minlength=8) / len(raw)
    words = text.lower().split()
    n = len(words)
    out[8] = np.log1p(n) / 12
    if n:
        distinct = set(words)
        out[9] = len(distinct) / n
        out[10] = min(len(text) / n / 20, 1.0)
        same = sum(map(str.__eq__, words, words[1:]))
        out[11] = same / n
        pairs = set(zip(words, words[1:]))
        out[12] = len(pairs) / n
        out[13] = min(np.log1p(n / len(distinct)) / 5, 1.0)
    lines = text.split("\n")
    out[14] = len(set(lines)) / len(lines)
    out[15] = sum(c * c for c in np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """Values, square roots and squares: enough bend for shares near 0 or 1."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), x * x], axis=-1)


@dataclass
class DocumentModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = ((_expand(features) - self.mean) / self.scale) @ self.weight + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> DocumentModel:
    """Ridge logistic regression by Newton steps."""
    x = _expand(x)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return DocumentModel(mean, scale, w[:-1], float(w[-1]))


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DocumentModel | None:
    """Logistic model of quality = 1, from about ``sample`` labelled documents drawn by a hash of their id.

    Null labels take no part; contradicting labels of a document all count, rows of equal shape and label once.
    At most twice ``sample`` rows reach the driver. None when they hold one class only.
    """
    ship_package(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", (F.col("quality") > 0).cast("double").alias("quality")).distinct()
    n = known.count()
    unit = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(unit < min(1.0, sample / max(n, 1)))
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")   # bounded by ``sample``, as ids are distinct

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"x": [text_features(t) for t in batch["text"]], "y": batch["quality"].astype(float)})

    # an id may stand on any number of rows: equal rows go, then the hash order bounds their number
    got = (texts.mapInPandas(trimmed(run), "x array<double>, y double").distinct()
           .orderBy(F.xxhash64("x", "y"), "y", "x").limit(2 * sample).toPandas())
    if got.empty or got["y"].nunique() < 2:
        return None
    # rows arrive in any order; a fixed order makes the fit repeatable
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy() > 0
    order = np.argsort([zlib.crc32(r.tobytes()) for r in x], kind="stable")
    return _fit_logistic(x[order], y[order].astype(float))


def document_probability(docs: DataFrame, model: DocumentModel | None, host: str, path: str,
                         row: str = "doc_id") -> DataFrame:
    """doc_id (from the column ``row``), known_id (doc_id itself), host, path, p of every document.

    An empty text has p 0, and without a model p is 1.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.array([text_features(t) for t in batch["text"]]).reshape(-1, FEATURES)
            p = shared.value.probability(x) if shared.value else np.ones(len(x))
            p = np.where(batch["text"].fillna("").str.strip() == "", 0.0, p)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "known_id": batch["known_id"], "host": batch["host"],
                                "path": batch["path"], "p": p})

    part = docs.select(F.coalesce(F.col(row).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("known_id"), "text",
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                   F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    return null_ids(part.mapInPandas(trimmed(run), "doc_id long, known_id long, host string, path string, p double"),
                    "known_id")


def with_evidence(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label (mean of the document's labels, 0 to 1, or null) and evidence (the label, else p)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("known_id")).agg(F.avg((F.col("quality") > 0).cast("double")).alias("label"))
    # rows without id stay out of the join, where they would meet in one task
    out = scored.where(F.col("known_id").isNotNull()).join(known, "known_id", "left").select(*scored.columns, "label")
    out = out.unionByName(scored.where(F.col("known_id").isNull()).withColumn("label", F.lit(None).cast("double")))
    return out.withColumn("evidence", F.coalesce("label", "p"))


def _strength(groups: DataFrame, prior: Column) -> float:
    """Beta strength of the prior by the method of moments over groups (n, good): how many documents it is worth."""
    r = groups.select((F.col("good") / F.col("n") - prior).alias("d"), F.col("n"), prior.alias("m")).agg(
        F.sum(F.col("n") * F.col("d") * F.col("d")).alias("ss"), F.sum(F.col("m") * (1 - F.col("m"))).alias("within"),
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("total")).first()
    if not r["n"] or not r["total"]:
        return 1.0
    between = max((r["ss"] - r["within"]) / r["n"], 1e-6)
    return float(min(max(r["total"] / r["n"] / between - 1.0, 1.0), 1e6))


def site_rates(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, good, host_n, host_good of every site; global rate; strengths of a host's and a path's prior).

    One grouped aggregation over all documents, combined before the shuffle;
    what follows works on its result, one row a site.
    """
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("good")),
                        "quality-sites")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = min(max((total["good"] or 0.0) / (total["n"] or 1), 1e-3), 1 - 1e-3)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k_host = _strength(hosts, F.lit(prior))
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host")
    k_path = _strength(sites, _shrunk("host_good", "host_n", k_host, F.lit(prior)))
    return sites, prior, k_host, k_path


def _shrunk(good: str, n: str, strength: float, prior: Column, own: Column | None = None) -> Column:
    """Posterior rate of a group; ``own`` is the evidence of one of its documents, to be left out."""
    if own is None:
        return (F.col(good) + strength * prior) / (F.col(n) + strength)
    return (F.greatest(F.col(good) - own, F.lit(0.0)) + strength * prior) / (F.col(n) - 1 + strength)


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, host_rate, path_rate of every site, from all its documents; the global rate)."""
    sites, prior, k_host, k_path = site_rates(scored)
    host_rate = _shrunk("host_good", "host_n", k_host, F.lit(prior))
    return sites.select("host", "path", "n", host_rate.alias("host_rate"),
                        _shrunk("good", "n", k_path, host_rate).alias("path_rate")), prior


def _logit(c: Column) -> Column:
    x = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(x / (1 - x))


def site_weight(judged: DataFrame) -> float:
    """The weight of least mean log loss over all labelled documents that have text; SITE_WEIGHT without any."""
    sign = 2 * F.col("label") - 1
    known = judged.where(F.col("label").isNotNull() & (F.col("p") > 0) & F.col("label").isin(0.0, 1.0))
    loss = known.agg(*[F.avg(F.log1p(F.exp(-sign * (_logit(F.col("p")) + w * F.col("shift"))))).alias(f"w{i}")
                       for i, w in enumerate(WEIGHTS)]).first()
    if loss["w0"] is None:
        return SITE_WEIGHT
    # rounded, so that the order of sums doesn't choose between equals
    return WEIGHTS[min(range(len(WEIGHTS)), key=lambda i: (round(loss[f"w{i}"], 9), i))]


def _judged(docs: DataFrame, labels: DataFrame, model: DocumentModel | None, host: str, path: str,
            row: str = "doc_id") -> DataFrame:
    """The rows of ``judge_quality``; doc_id is the column ``row``, nulls as NULL_ID."""
    # written first: the features of a text are computed once, however often its probability is read
    scored = materialize(document_probability(docs, model, host, path, row), "quality-probabilities")
    scored = materialize(with_evidence(scored, labels), "quality-documents")
    sites, prior, k_host, k_path = site_rates(scored)
    # sites are aggregates of the documents: small here, of no fixed bound, so the planner chooses the join
    own = F.col("evidence")
    out = scored.join(sites, ["host", "path"])
    out = out.withColumn("host_rate", _shrunk("host_good", "host_n", k_host, F.lit(prior), own))
    out = out.withColumn("path_rate", _shrunk("good", "n", k_path, F.col("host_rate"), own))
    out = out.withColumn("shift", _logit(F.col("path_rate")) - _logit(F.lit(prior)))
    z = _logit(F.col("p")) + site_weight(out) * F.col("shift")
    quality = F.when(F.col("p") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-z)))
    return out.select("doc_id", F.col("p").alias("p_document"), "host_rate", "path_rate",
                      quality.alias("quality"), (quality >= THRESHOLD).alias("keep"))


def judge_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, p_document, host_rate, path_rate, quality (posterior), keep of every document.

    A null or empty text is rejected; null hosts and paths form a site of
    their own; repeated rows repeat; with no usable labels every document
    that has text is kept.
    """
    return null_ids(_judged(docs, labels, fit_documents(docs, labels), host, path))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that aren't rejected, columns unchanged.

    Each row is judged by itself, so ids may repeat or be missing.
    """
    # written once: every later read must see the same numbers
    row = unused(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    judged = _judged(rows, labels, fit_documents(rows, labels), "source", "lang", row)
    rejected = judged.where(~F.col("keep")).select(F.col("doc_id").alias(row))
    return rows.join(rejected, row, "left_anti").select(*docs.columns)
