"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked when the sets of their word 5-grams have a Jaccard
similarity of at least 0.8.

1. Documents with the same text are one class; only its first document goes on.
2. Each text gets MinHash values. Bands of four values are buckets; a pair at
   the threshold misses all 40 bands with probability 7e-10, a closer one less.
3. Inside a bucket, texts are compared block by block. MinHash values are
   compared a few at a time, and a pair is dropped once the posterior
   probability of reaching the threshold falls below the tolerance. A large
   bucket only sends on a forest that connects its surviving pairs, never the
   pairs, and doesn't compare texts that are connected already; connected
   components of these edges hold every pair that is left.
4. Inside a component all pairs are pruned the same way once, and the
   survivors are verified exactly by counting shared 5-grams. A component
   larger than a block is dealt out as pairs of blocks, so no task holds it.
5. Verified links are counted per text; their forests give the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.llm.common import null_ids, trimmed, unused, with_id
from viewscope.session import materialize, ship_package

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
STEP = 16               # MinHash values compared at a time
TOLERANCE = 1e-9        # posterior probability below which a pair is dropped
BLOCK = 512             # texts of a block
SMALL = 8               # texts of a bucket up to which all its pairs are compared in one go with other buckets
_CHUNK = 2_000_000      # cells of a shingle matrix held at once

_HASHING: list[tuple[np.ndarray, np.ndarray]] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of the whole text, words being cut at white space.

    A text with fewer words has one n-gram of all its words, one without words none.
    """
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def minhash(grams: np.ndarray) -> np.ndarray:
    """HASHES 32-bit MinHash values of a set of n-gram hashes."""
    if not _HASHING:
        n = np.arange(1, HASHES + 1, dtype=np.uint64)
        a = (_mix(n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        _HASHING.append((a, (_mix(n + np.uint64(1000)) >> np.uint64(32)).astype(np.uint32)))
    a, b = _HASHING[0]
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        v = x[i:i + 2048, None] * a[None, :] + b[None, :]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum(out, v.min(axis=0), out=out)
    return out


def least_matches(hashes: int = HASHES, step: int = STEP, threshold: float = THRESHOLD,
                  tolerance: float = TOLERANCE) -> list[int]:
    """For each number of values compared, the least matches that keep a pair.

    With a uniform prior the similarity after m of n matches is
    Beta(m + 1, n - m + 1); its tail above the threshold is a binomial sum.
    """
    out = []
    for n in range(step, hashes + 1, step):
        def tail(m, n=n):
            return sum(math.comb(n + 1, i) * threshold ** i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= tolerance))
    return out


def surviving_pairs(left: np.ndarray, right: np.ndarray | None, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature blocks (or i < j within one) that incremental comparison doesn't drop."""
    same = right is None
    right = left if same else right
    found_i, found_j = [], []
    for i in range(len(left)):
        j = np.arange(i + 1 if same else 0, len(right))
        match = np.zeros(len(j), np.int64)
        for k, m in enumerate(least):
            if not len(j):
                break
            part = slice(k * STEP, (k + 1) * STEP)
            match += (right[j, part] == left[i, part]).sum(axis=1)
            keep = match >= m
            j, match = j[keep], match[keep]
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def pruned_pairs(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of signatures that incremental comparison doesn't drop."""
    match = np.zeros(len(i), np.int64)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        match += (sig[i, part] == sig[j, part]).sum(axis=1)
        keep = match >= m
        i, j, match = i[keep], j[keep], match[keep]
    return i, j


def connected(sig: np.ndarray, hi: np.ndarray, lo: np.ndarray | None, least: list[int]) -> np.ndarray:
    """Label of each signature: equal for those that surviving pairs of ``hi`` x ``lo`` (or inside ``hi``) connect.

    A pair that is connected by earlier pairs isn't compared, as it can't change a label.
    """
    label = np.arange(len(sig))
    for n, i in enumerate(hi):
        j = hi[n + 1:] if lo is None else lo
        j = j[label[j] != label[i]]
        _, j = pruned_pairs(sig, np.full(len(j), i), j, least)
        if len(j):
            joined = np.append(label[j], label[i])
            label[np.isin(label, joined)] = joined.min()
    return label


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (larger, least) that connect what the edges a-b connect: one per node but the least of each part."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]


def _block_pairs(groups: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows of each key's units of work: a group of n blocks becomes every pair of its blocks.

    A row of block b goes to the units (b, 0..b) and (b..n-1, b): as many copies as the group has
    blocks, one where it fits a block.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(block)).cast("int"))
    dealt = groups.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("_n")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(
        F.greatest(o, F.col("_b")).alias("_hi"), F.least(o, F.col("_b")).alias("_lo")))
    return dealt.withColumn("_unit", F.explode(others)).select(
        *[c for c in groups.columns if c != size], "_b", F.col("_unit._hi").alias("_hi"), F.col("_unit._lo").alias("_lo"))


def _whole_units(batches, keys: list[str]):
    """Frames that hold whole units of work, from batches sorted by ``keys``."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = np.ones(len(rows), bool)
        for k in keys:
            last &= (rows[k] == rows[k].iloc[-1]).to_numpy()
        cut = len(rows) - int(last.sum())
        if cut:
            yield rows.iloc[:cut]
        held = rows.iloc[cut:]
    if held is not None and len(held):
        yield held


def _units(batches, keys: list[str]):
    """Frames of one unit of work each, from batches sorted by ``keys``."""
    for rows in _whole_units(batches, keys):
        yield from (g for _, g in rows.groupby(keys, sort=False))


def signatures(texts: DataFrame) -> DataFrame:
    """rep, sig (little-endian uint32 MinHash values) of every text that has words."""
    def run(batches):
        for batch in batches:
            got = [(r, g) for r, g in ((r, shingles(t)) for r, t in zip(batch["rep"], batch["text"])) if len(g)]
            yield pd.DataFrame({"rep": [r for r, _ in got], "sig": [minhash(g).astype("<u4").tobytes() for _, g in got]})

    return texts.mapInPandas(trimmed(run), "rep long, sig binary")


def bucket_members(sigs: DataFrame) -> DataFrame:
    """rep, bucket of every band that is shared by at least two texts."""
    def run(batches):
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch["sig"]), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(band, sig.shape[:2])
            for r in range(ROWS):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pd.DataFrame({"rep": np.repeat(batch["rep"].to_numpy(), BANDS), "bucket": h.ravel().view(np.int64)})

    return sigs.mapInPandas(trimmed(run), "rep long, bucket long")


def candidate_edges(sigs: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every pair that shares a bucket and isn't pruned."""
    members = materialize(bucket_members(sigs), "buckets")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    inside = members.join(shared, "bucket").join(sigs, "rep")
    units = _block_pairs(inside, "bucket", "size", 4 * BLOCK)
    least = least_matches()

    def run(batches):
        keys = ["bucket", "_hi", "_lo"]
        for rows in _whole_units(batches, keys):
            sig = np.frombuffer(b"".join(rows["sig"]), "<u4").reshape(-1, HASHES)
            rep, b, (bucket, hi, lo) = rows["rep"].to_numpy(), rows["_b"].to_numpy(), (rows[k].to_numpy() for k in keys)
            new = np.ones(len(rows), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(starts, append=len(rows))
            small = (sizes <= SMALL) & (hi[starts] == lo[starts])
            left, right = [], []
            for size in range(2, SMALL + 1):   # all pairs of the small buckets of one size together
                at = starts[small & (sizes == size), None]
                i, j = np.triu_indices(size, 1)
                i, j = pruned_pairs(sig, (at + i).ravel(), (at + j).ravel(), least)
                left.append(rep[i])
                right.append(rep[j])
            for x, n in zip(starts[~small], sizes[~small]):
                unit = slice(x, x + n)
                if hi[x] == lo[x]:
                    label = connected(sig[unit], np.arange(n), None, least)
                else:
                    label = connected(sig[unit], np.flatnonzero(b[unit] == hi[x]), np.flatnonzero(b[unit] == lo[x]), least)
                first = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(first, label, rep[unit])
                other = first[label] != rep[unit]
                left.append(rep[unit][other])
                right.append(first[label][other])
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()

    return (units.repartition("bucket", "_hi", "_lo").sortWithinPartitions("bucket", "_hi", "_lo")
            .mapInPandas(trimmed(run), "a long, b long"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether distinct ``edges`` (a, b), a > b, are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return nodes.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("low") == 0))).isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), the root being the least node of its component.

    Rounds of large-star and small-star, each written to the shared folder, until every component is a star. Stars
    are built by aggregates and joins, so a node of any degree is never gathered.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") != F.col("b")).distinct(), "edges")
    for _ in range(rounds):
        if _all_stars(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialize(least, "stars")   # read back, so the join below can split a node of many edges
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large, "edges")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.where(F.col("a") != F.col("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def exact_links(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray,
                threshold: float = THRESHOLD) -> np.ndarray:
    """Whether the sets left[i], right[j] have a Jaccard similarity of at least ``threshold``.

    Shared n-grams of all pairs of the blocks are counted at once as a product of 0/1 matrices over the n-grams that
    occur in both blocks, some columns at a time.
    """
    if not len(i):
        return np.zeros(0, bool)
    ui, uj = np.unique(i), np.unique(j)
    sizes = [np.array([len(x[k]) for k in u], np.int64) for x, u in ((left, ui), (right, uj))]
    flat = [np.concatenate([x[k] for k in u]) for x, u in ((left, ui), (right, uj))]
    owner = [np.repeat(np.arange(len(u)), s) for u, s in zip((ui, uj), sizes)]
    common = np.intersect1d(flat[0], flat[1])
    cols = []
    for side in (0, 1):
        at = np.searchsorted(common, flat[side])
        hit = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == flat[side]) if len(common) else np.zeros(
            len(flat[side]), bool)
        cols.append((owner[side][hit], at[hit]))
    shared = np.zeros((len(ui), len(uj)), np.float32)
    width = max(1, _CHUNK // (len(ui) + len(uj)))
    order = [np.argsort(c[1], kind="stable") for c in cols]
    cols = [(c[0][o], c[1][o]) for c, o in zip(cols, order)]
    for start in range(0, len(common), width):
        parts = []
        for (own, at), u in zip(cols, (ui, uj)):
            x, y = np.searchsorted(at, [start, start + width])
            m = np.zeros((len(u), min(width, len(common) - start)), np.float32)
            m[own[x:y], at[x:y] - start] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    a, b = np.searchsorted(ui, i), np.searchsorted(uj, j)
    both = shared[a, b].astype(np.int64)
    return both >= threshold * (sizes[0][a] + sizes[1][b] - both) - 1e-9


def verified(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact links inside the components ``groups`` (rep, root).

    Rows (rep, n, other): n links of rep found in a unit of work, and a forest edge rep-other (or null).
    """
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    inside = texts.join(groups.join(sizes, "root"), "rep").select("rep", "root", "size", "text", "copies")
    least = least_matches()

    def run(batches):
        for unit in _units(batches, ["root", "_hi", "_lo"]):
            rep, b, copies = (unit[c].to_numpy() for c in ("rep", "_b", "copies"))
            grams = [shingles(t) for t in unit["text"]]
            sig = np.array([minhash(g) for g in grams])
            same = unit["_hi"].iloc[0] == unit["_lo"].iloc[0]
            hi = np.flatnonzero(b == unit["_hi"].iloc[0])
            lo = hi if same else np.flatnonzero(b == unit["_lo"].iloc[0])
            i, j = surviving_pairs(sig[hi], None if same else sig[lo], least)
            good = exact_links([grams[k] for k in hi], [grams[k] for k in lo], i, j)
            x, y = hi[i[good]], lo[j[good]]
            n = np.bincount(x, minlength=len(rep)) + np.bincount(y, minlength=len(rep))
            docs = (np.bincount(x, copies[y], len(rep)) + np.bincount(y, copies[x], len(rep))).astype(np.int64)
            edges = dict(forest(rep[x], rep[y]))
            seen = n > 0
            yield pd.DataFrame({"rep": rep[seen], "n": n[seen], "docs": docs[seen],
                                "other": pd.array([edges.get(r) for r in rep[seen].tolist()], "Int64")})

    units = _block_pairs(inside, "root", "size", BLOCK)
    return (units.repartition("root", "_hi", "_lo").sortWithinPartitions("root", "_hi", "_lo")
            .mapInPandas(trimmed(run), "rep long, n long, docs long, other long"))


def text_classes(numbered: DataFrame) -> DataFrame:
    """row, doc_id, rep, first, copies of each of the rows (row, doc_id, text), written: the classes of equal texts.

    ``rep`` is the least row with the same text and names the class, as ids can be shared or missing; ``first`` is its
    least doc_id. The hash is joined back to the rows, not gathered, so a text of any number of copies is fine.
    """
    keyed = numbered.select("row", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_h"))
    keyed = materialize(keyed.select("row", "doc_id", F.unhex(F.substring("_h", 1, 32)).alias("_h")), "text-hashes")
    reps = materialize(keyed.groupBy("_h").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first"),
                                               F.count(F.lit(1)).alias("copies")), "text-classes")
    several = reps.where(F.col("copies") > 1)
    return materialize(keyed.join(several, "_h", "left").select(
        "row", "doc_id", F.coalesce("rep", "row").alias("rep"), F.coalesce("first", "doc_id").alias("first"),
        F.coalesce("copies", F.lit(1)).alias("copies")), "document-classes")


def judged_rows(numbered: DataFrame) -> DataFrame:
    """row, doc_id, class_id, n_links, n_linked_docs, group_id, root of each of the rows (row, doc_id, text).

    Row numbers must be distinct and fixed; ``root`` is the same for the rows of a group and no others.
    """
    ship_package(numbered.sparkSession)
    classes = text_classes(numbered)
    one = classes.where(F.col("row") == F.col("rep")).select("rep", "first", "copies")
    texts = numbered.select(F.col("row").alias("rep"), "text").join(one.select("rep", "copies"), "rep")
    sigs = materialize(signatures(texts), "signatures")
    groups = materialize(components(candidate_edges(sigs)).select(F.col("node").alias("rep"), "root"), "candidates")
    links = materialize(verified(texts, groups), "links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n_links"), F.sum("docs").alias("n_linked_docs"))
    roots = components(links.where(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b")))
    roots = materialize(roots.select(F.col("node").alias("rep"), "root").join(one.select("rep", "first"), "rep"), "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("group_id"))
    known = materialize(counts.join(roots.join(least, "root").select("rep", "root", "group_id"), "rep", "left"),
                        "linked-texts")
    return classes.join(known, "rep", "left").select(
        "row", "doc_id", F.col("first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"), F.coalesce("group_id", "first").alias("group_id"),
        F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, n_links, n_linked_docs, group_id.

    class_id is the least doc_id with the same text; n_links counts the other
    texts linked to it, n_linked_docs the documents that have those texts;
    group_id is the least doc_id of the connected group of linked texts. Null
    and empty texts form one class and link to no other. Repeated rows repeat;
    rows that share an id, or have none (the least of all ids), are judged each by its own text.
    """
    # written once: every later read must see the same numbers
    numbered = materialize(with_id(docs, "doc_id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
    return null_ids(judged_rows(numbered).drop("row", "root"), "doc_id", "class_id", "group_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group of linked texts, columns unchanged: the row of least doc_id, null the least.

    Of rows that share that id the first written one stays.
    """
    # written once: every later read must see the same numbers
    row = unused(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    judged = judged_rows(with_id(rows, "doc_id", "text", F.col(row).alias("row")))
    keep = judged.where(F.col("doc_id") == F.col("group_id")).groupBy("root").agg(F.min("row").alias(row))
    return rows.join(keep.select(row), row, "left_semi").select(*docs.columns)
