"""Removal of repeated byte strings, with suffix order by bucket-pointer refinement.

Every byte covered by a string of ``length`` bytes that also starts earlier in
the corpus is removed. No task sees the corpus; equal strings are brought
together instead:

1. Each window of ``length`` bytes belongs to the q-gram of least hash inside
   it (its minimizer). Runs of neighbouring windows with one minimizer form a
   span of up to 2 * length - q bytes. Equal windows have equal minimizers.
2. Spans are keyed by (minimizer, content) hashes. Later copies of the same
   content are repeats as a whole; copies inside one task are resolved there,
   so a frequent passage sends at most one row a task.
3. Where a minimizer has different contents, their bytes come together and
   their windows are ordered by bucket-pointer refinement: initial buckets by
   q-gram, refined by sorting on the bucket identifiers at later offsets, which are
   written back and read again by the next round. Windows in one
   bucket at full depth are equal; all but the earliest are repeats.
4. A minimizer with very many different contents (the edge of a passage that
   a share of all documents has) is not gathered: its windows are hashed and
   grouped by an aggregate that combines before the shuffle.

So whole spans (2) and the windows of hot minimizers (4) are settled by 64-bit
hashes, the rest by refinement of q-gram hashes; bytes are not compared again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.llm.common import trimmed, unused
from viewscope.session import materialize, ship_package

LENGTH = 100
Q = 25
MAX_HOT = 1_000_000       # rows of the list of hot minimizers at most
HOT_SPANS = 5_000         # different contents of a minimizer, about, beyond which it counts as hot
_HELD_ROWS = 1_000_000    # rows of one minimizer that a task holds before it decides
_SAMPLE = 100             # one of so many spans is looked at to find hot minimizers
_BATCH_BYTES = 3 << 20    # text handled by one numpy pass
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of data[i:i + width] for every i, by doubling; len(data) - width + 1 values."""
    have, size, mult = _mix(data.astype(np.uint64) + np.uint64(1)), 1, _MULT
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out = have
            else:   # the part so far, then the next ``size`` bytes
                n = min(len(out), len(have) - done)
                out = out[:n] * mult + have[done:done + n]
            done += size
        if done == width:
            return _mix(out[:len(data) - width + 1])
        have = have[:-size] * mult + have[size:] if len(have) > size else have[:0]
        size, mult = 2 * size, np.uint64(int(mult) ** 2 & 0xFFFFFFFFFFFFFFFF)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i + width] for every i."""
    have, size = x, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(have[:n], have[width - size:width - size + n])


def bucket_pointer_refine(data: np.ndarray, starts: np.ndarray, depth: int, q: int = Q) -> np.ndarray:
    """Bucket of each start: equal for starts whose next ``depth`` bytes are equal, -1 for a start alone in its own.

    Every position that matters begins in the bucket of its q-gram. A round sorts the positions of shared buckets by
    (bucket, bucket of the position ``step`` bytes on) and writes the refined identifiers back, so the next round
    reads pointers that are already refined and the depth doubles: 25, 50, 100 bytes. A position alone in its bucket
    is never sorted again, and whatever points at it is told apart by it.
    """
    # positions whose identifier a round reads: the starts, and those that later rounds point at
    steps, have = [], q
    while have < depth:
        steps.append(min(have, depth - have))
        have += steps[-1]
    wanted = [starts]
    for step in reversed(steps):
        wanted.append(np.unique(np.concatenate([wanted[-1], wanted[-1] + step])))
    places = wanted.pop()                                    # all positions read at all, in order
    _, first = np.unique(rolling_hash(data, q)[places], return_inverse=True)
    bucket = np.zeros(len(data) + 1, np.int64)
    bucket[places] = first
    shared = np.bincount(first) > 1 if len(first) else np.zeros(0, bool)
    free = len(shared)                                       # identifiers from here on are unused
    single = np.ones(free, bool)
    single[:len(shared)] = ~shared
    for step in steps:
        active = wanted.pop()
        active = active[~single[bucket[active]]]
        group, pointer = bucket[active], bucket[active + step]
        order = np.lexsort((pointer, group))
        g, p = group[order], pointer[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
        ids = np.cumsum(new) - 1
        bucket[active[order]] = free + ids
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        single = np.concatenate([single, counts == 1])
        free += len(counts)
    out = bucket[starts]
    # copies of one start count as sharing, so starts are counted, not positions
    _, which, n = np.unique(out, return_inverse=True, return_counts=True)
    return np.where(n[which] > 1, out, -1)


def spans_of(grams: np.ndarray, ends: np.ndarray, length: int = LENGTH, q: int = Q):
    """Spans of concatenated texts: (first window, number of windows, minimizer hash).

    ``grams`` are the q-gram hashes of the bytes, ``ends[i]`` is the end of
    the text that byte i lies in; windows never cross texts. The minimizer is
    the leftmost q-gram of least hash, so equal windows choose it at the same
    place, and windows of one span are at most length - q apart.
    """
    if len(ends) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _window_min((grams & ~np.uint64(0xFFFFFFFF)) | place, length - q + 1) & np.uint64(0xFFFFFFFF)
    inside = np.arange(len(least)) + length <= ends[:len(least)]
    first = np.ones(len(least), bool)
    first[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first &= inside
    stop = np.ones(len(least), bool)
    stop[:-1] = first[1:] | ~inside[1:]
    edges, stops = np.flatnonzero(first), np.flatnonzero(stop & inside) + 1
    return edges, stops - edges, grams[least[edges].astype(np.int64)]


def _window_hash(grams: np.ndarray, at: np.ndarray, length: int, q: int) -> np.ndarray:
    """Hash of the windows that start at ``at``, from the hashes of the q-grams that cover them."""
    out = np.zeros(len(at), np.uint64)
    for offset in [*range(0, length - q, q), length - q]:
        out = _mix(out * _MULT + grams[at + offset])
    return out


def _ranges(doc: np.ndarray, start: np.ndarray, n: np.ndarray):
    """Join touching runs of windows of a document."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(n, at) if len(at) else n


def _texts(batch: pd.DataFrame):
    """Groups of a batch's rows of at most about _BATCH_BYTES: (ids, data, start of each text)."""
    ids, parts, size = [], [], 0
    for doc_id, text in zip(batch["doc_id"], batch["text"]):
        raw = (text or "").encode()
        if parts and size + len(raw) > _BATCH_BYTES:
            yield ids, parts
            ids, parts, size = [], [], 0
        ids.append(doc_id)
        parts.append(raw)
        size += len(raw)
    if parts:
        yield ids, parts


_SPANS = "doc_id long, start int, n int, mini long, content long, repeated boolean"


def _first_and_later(doc: np.ndarray, start: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether an earlier row has the same keys."""
    order = np.lexsort((start, doc, *keys))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    later = np.empty(len(order), bool)
    later[order] = same
    return later


def find_spans(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """Spans of every document. Later copies that a task sees itself come as joined ranges, marked repeated."""
    def run(batches):
        for batch in batches:
            for ids, parts in _texts(batch):
                sizes = np.array([len(p) for p in parts])
                data = np.frombuffer(b"".join(parts), np.uint8)
                if len(data) < length:
                    continue
                offsets = np.cumsum(sizes) - sizes
                grams = rolling_hash(data, q)
                edges, n, mini = spans_of(grams, np.repeat(offsets + sizes, sizes), length, q)
                if not len(edges):
                    continue
                # first window, last window and their distance cover every byte of a span
                content = _mix(_window_hash(grams, edges, length, q) * _MULT
                               + _window_hash(grams, edges + n - 1, length, q) + n.astype(np.uint64))
                doc = np.searchsorted(offsets, edges, side="right") - 1
                start, doc = edges - offsets[doc], np.array(ids, np.int64)[doc]
                later = _first_and_later(doc, start, content, mini)
                d, s, k = _ranges(doc[later], start[later], n[later])
                spread = _mix(d.astype(np.uint64) ^ _MULT * s.astype(np.uint64)).view(np.int64)
                one = ~later
                yield pd.DataFrame({
                    "doc_id": np.concatenate([doc[one], d]), "start": np.concatenate([start[one], s]).astype("int32"),
                    "n": np.concatenate([n[one], k]).astype("int32"),
                    "mini": np.concatenate([mini[one].view(np.int64), spread]),
                    "content": np.concatenate([content[one].view(np.int64), spread]),
                    "repeated": np.arange(len(d) + int(one.sum())) >= int(one.sum())})

    return docs.mapInPandas(trimmed(run), _SPANS)


def hot_minimizers(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """Minimizers with many different contents, judged from one document in _SAMPLE.

    This only chooses how spans are dealt, never a result. A minimizer is
    listed from max(HOT_SPANS, spans / MAX_HOT) spans on, estimated, so the
    list has at most MAX_HOT rows of 8 bytes.
    """
    part = docs.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(_SAMPLE)) == 0)
    counts = materialize(find_spans(part, length, q).where(~F.col("repeated")).groupBy("mini").agg(
        F.count(F.lit(1)).alias("c")), "minimizers")
    total = counts.agg(F.sum("c")).first()[0] or 0
    least = max(HOT_SPANS / _SAMPLE, total / MAX_HOT)
    return materialize(counts.where(F.col("c") >= least).select("mini"), "hot-minimizers")


def resolve(spans: DataFrame, hot: DataFrame, partitions: int) -> DataFrame:
    """Later copies of a content (repeated), and first copies where the minimizer has other contents.

    Spans are sorted by (minimizer, content, place), so one pass over the
    rows of a partition decides, holding a batch at a time. Hot minimizers
    are dealt by content.
    """
    out = "doc_id long, start int, n int, mini long, hot boolean, repeated boolean"
    most = _HELD_ROWS

    def decide(rows: pd.DataFrame, before, after) -> pd.DataFrame:
        """before, after: (minimizer, content) of the neighbouring rows, or None."""
        m, c = rows["mini"].to_numpy(), rows["content"].to_numpy()
        same_m = np.append(before is not None and before[0] == m[0], m[1:] == m[:-1])
        same_c = same_m & np.append(before is not None and before[1] == c[0], c[1:] == c[:-1])
        # another content stands next to a row of this run, before or after
        differs = same_m & ~same_c
        run_id = np.cumsum(~same_m)
        several = np.bincount(run_id, weights=differs)[run_id] > 0
        if after is not None and after[0] == m[-1] and after[1] != c[-1]:
            several |= run_id == run_id[-1]
        if before is not None and before[0] == m[0] and before[2]:
            several |= run_id == run_id[0]
        known = rows["repeated"].to_numpy()
        later = (same_c | known)
        res = rows[["doc_id", "start", "n", "mini", "hot"]].assign(repeated=later)
        return res[later | several | rows["hot"].to_numpy()], (m[-1], c[-1], bool(several[-1]))

    def run(batches):
        before = held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            m = rows["mini"].to_numpy()
            cut = int(np.searchsorted(m, m[-1]))   # the last minimizer may go on in the next batch
            long_run = len(rows) - cut > most
            if long_run:
                cut = len(rows) - 1
            if cut:
                # a run too long to hold counts as one of several contents, whatever follows: its first copies are
                # compared, which costs a row a run if nothing else comes
                after = (m[cut], None if long_run else rows["content"].iloc[cut])
                done, before = decide(rows.iloc[:cut], before, after)
                yield done
            held = rows.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield decide(held, before, None)[0]

    marked = spans.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "mini", "left")   # <= MAX_HOT rows
    marked = marked.withColumn("hot", F.coalesce("hot", F.lit(False)))
    key = F.when(F.col("hot"), F.col("content")).otherwise(F.col("mini"))
    return (marked.withColumn("_key", key).repartition(partitions, "_key")
            .sortWithinPartitions("mini", "content", "doc_id", "start")
            .select("doc_id", "start", "n", "mini", "content", "hot", "repeated").mapInPandas(trimmed(run), out))


_BYTES = "key long, doc_id long, start int, n int, bytes binary, repeated boolean"


def cut_spans(docs: DataFrame, wanted: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """Bytes of the wanted spans (doc_id, spans), keyed by minimizer; those of hot minimizers as single windows.

    A window of a hot minimizer is keyed by its hash and needs no bytes. Later copies that a task sees itself
    come as joined ranges, marked repeated.
    """
    def run(batches):
        for batch in batches:
            out = []
            hot_d, hot_s, hot_h = [], [], []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                raw = text.encode()
                for s in spans:
                    piece = raw[s["start"]:s["start"] + s["n"] + length - 1]
                    if s["hot"]:
                        grams = rolling_hash(np.frombuffer(piece, np.uint8), q)
                        at = np.arange(s["n"])
                        hot_h.append(_window_hash(grams, at, length, q))
                        hot_s.append(s["start"] + at)
                        hot_d.append(np.full(s["n"], doc_id, np.int64))
                    else:
                        out.append((s["mini"], doc_id, s["start"], s["n"], piece, False))
            if hot_d:
                d, s, h = np.concatenate(hot_d), np.concatenate(hot_s), np.concatenate(hot_h)
                later = _first_and_later(d, s, h)
                one = ~later
                out += zip(h[one].view(np.int64).tolist(), d[one].tolist(), s[one].tolist(),
                           [1] * int(one.sum()), [None] * int(one.sum()), [False] * int(one.sum()))
                rd, rs, rn = _ranges(d[later], s[later], np.ones(int(later.sum()), np.int64))
                spread = _mix(rd.astype(np.uint64) ^ _MULT * rs.astype(np.uint64)).view(np.int64)
                out += zip(spread.tolist(), rd.tolist(), rs.tolist(), rn.tolist(), [None] * len(rd), [True] * len(rd))
            yield pd.DataFrame(out, columns=["key", "doc_id", "start", "n", "bytes", "repeated"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "spans").mapInPandas(trimmed(run), _BYTES)


def repeated_windows(cut: DataFrame, partitions: int, length: int = LENGTH, q: int = Q) -> DataFrame:
    """Ranges of windows that also occur earlier: (doc_id, start, n)."""
    def refine(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["repeated"]]
        spans = rows[~rows["repeated"] & rows["bytes"].notna()]
        single = rows[~rows["repeated"] & rows["bytes"].isna()]
        d, s, n = [known["doc_id"].to_numpy()], [known["start"].to_numpy()], [known["n"].to_numpy()]
        if len(single):   # windows of hot minimizers: equal keys are equal windows
            x = [single[c].to_numpy() for c in ("doc_id", "start", "key")]
            later = _first_and_later(*x)
            d.append(x[0][later]), s.append(x[1][later]), n.append(np.ones(int(later.sum()), np.int64))
        if len(spans):
            count = spans["n"].to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(spans["bytes"]), np.uint8)
            sizes = count + length - 1
            base = np.cumsum(sizes) - sizes
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts = np.repeat(base, count) + within
            bucket = bucket_pointer_refine(data, starts, length, q)
            doc = np.repeat(spans["doc_id"].to_numpy(), count)
            pos = np.repeat(spans["start"].to_numpy().astype(np.int64), count) + within
            shared = bucket >= 0
            later = _first_and_later(doc[shared], pos[shared], bucket[shared])
            d.append(doc[shared][later]), s.append(pos[shared][later]), n.append(np.ones(int(later.sum()), np.int64))
        doc, start, n = _ranges(*(np.concatenate(x).astype(np.int64) for x in (d, s, n)))
        return pd.DataFrame({"doc_id": doc, "start": start.astype("int32"), "n": n.astype("int32")})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < 30_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            k = rows["key"].to_numpy()
            cut_at = int(np.searchsorted(k, k[-1]))   # the last key may go on in the next batch
            if cut_at:
                yield refine(rows.iloc[:cut_at])
                rows = rows.iloc[cut_at:]
            elif rows["bytes"].isna().all():          # one hot window only: its first row decides the others
                yield refine(rows)
                rows = rows.iloc[:1]
            held, size = [rows], len(rows)
        if held:
            yield refine(pd.concat(held, ignore_index=True))

    return (cut.repartition(partitions, "key").sortWithinPartitions("key", "doc_id", "start")
            .mapInPandas(trimmed(run), "doc_id long, start int, n int"))


def _with_number(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a distinct number a row in ``column``, in the order of doc_id (null first), then of the text's hashes.

    Distinct ids are the numbers themselves. Otherwise the rows are sorted over all tasks and written with their place.
    Rows that agree in id and text are dealt by their row number, so neither an id nor one of its texts gathers in a task.
    """
    facts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("n"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    below = (facts["low"] or 0) - 1                       # the number of a row without an id
    if (facts["n"] or 1) == 1 and not (facts["nulls"] and below < -(1 << 63)):
        return docs.withColumn(column, F.coalesce(F.col("doc_id").cast("long"), F.lit(max(below, -(1 << 63)))))
    text = F.coalesce("text", F.lit(""))
    keys = {unused(docs, f"_k{i}"): c for i, c in enumerate(
        (F.xxhash64(text), F.xxhash64(F.lit(1), text), F.monotonically_increasing_id()))}
    order = [F.col("doc_id").asc_nulls_first(), *[F.col(k) for k in keys]]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.withColumns(keys).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(*keys)
    return materialize(placed.withColumn(column, F.monotonically_increasing_id()), "numbered-rows")


def repeated_ranges(one: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """Ranges of repeated windows per document: (doc_id, ranges of (start, n)); doc_id must be unique."""
    spark = one.sparkSession
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(conf, -(-size // (16 << 20)))
    hot = hot_minimizers(one, length, q)
    found = materialize(resolve(find_spans(one, length, q), hot, partitions), "spans")
    wanted = found.where(~F.col("repeated")).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "n", "mini", "hot")).alias("spans"))   # a document's own spans
    windows = repeated_windows(cut_spans(one, wanted, length, q), partitions, length, q)
    ranges = found.where("repeated").select("doc_id", "start", "n").unionByName(windows)
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def _kept(raw: bytes, ranges, length: int) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    out, at, spans = [], 0, 0
    end = -1
    for s, n in sorted((r["start"], r["n"]) for r in ranges):
        if s > end:
            out.append(raw[at:s])
            spans += 1
        end = max(end, s + n + length - 1)
        at = end
    out.append(raw[at:])
    kept = b"".join(out)
    return kept, len(raw) - len(kept), spans


def _with_ranges(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """(rows of ``docs`` with the ranges to remove in a column of that name)."""
    number, found = unused(docs, "_number"), unused(docs, "_ranges")
    rows = _with_number(docs, number)
    ranges = repeated_ranges(rows.select(F.col(number).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), length)
    ranges = ranges.select(F.col("doc_id").alias(number), F.col("ranges").alias(found))
    return rows.join(ranges, number, "left").select(*docs.columns, found), found


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; texts under ``length`` bytes lose nothing. Rows that
    share a doc_id, or have none, are separate documents, one after another in the order of their texts' hashes.
    """
    ship_package(docs.sparkSession)
    rows, column = _with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)

    def run(batches):   # Arrow batches, as pandas would turn ids with nulls among them into floats
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist()):
                raw = (text or "").encode()
                kept, gone, spans = _kept(raw, ranges if ranges is not None else (), length)
                out.append((len(raw), gone, spans, hashlib.sha256(kept).hexdigest()))
            counts = [pa.array(x, pa.int64()) for x in zip(*[r[:3] for r in out])] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([r[3] for r in out], pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of ``docs`` with repeated strings cut out of text; columns stay, n_chars follows where it is a column.

    Bytes of a character cut in two are dropped with it. A text that loses
    everything becomes empty, and its row stays. Rows that share a doc_id, or
    have none, are separate documents, in the order that ``remove_repeats`` takes.
    """
    ship_package(docs.sparkSession)
    rows, found = _with_ranges(docs, length)
    columns, schema = docs.columns, docs.schema

    def run(batches):   # Arrow batches, as pandas would turn ids with nulls among them into floats
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist()):
                if ranges is not None and text:
                    text = _kept(text.encode(), ranges, length)[0].decode(errors="ignore")
                texts.append(text)
            out = {c: batch.column(c) for c in columns}
            out["text"] = pa.array(texts, out["text"].type)
            if "n_chars" in columns:
                out["n_chars"] = pa.array([None if t is None else len(t) for t in texts], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=columns)

    return rows.mapInArrow(trimmed(run), schema)
