"""Sequence packing by best-fit decreasing.

Documents are tokenized where they are read. A document longer than a window
is first cut into full windows; each rest is an item. Items are dealt by hash
into shards of a few thousand, and every shard is packed on its own: items in
descending length go to the open window with the least sufficient room, found
in a segment tree indexed by remaining capacity. Shards bound the memory of a
task at any input size and cost less than one part-filled window each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.llm.common import null_ids, trimmed, with_id
from viewscope.llm.wordbpe import END_ID, default_path, encoder
from viewscope.session import materialize, ship_package

WINDOW = 2048
SHARD_ITEMS = 2500

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class CapacityTree:
    """Open windows counted by remaining capacity, in a segment tree over 0..window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window_id: int) -> None:
        self.open[room].append(window_id)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room >= ``length``."""
        count, node = self.count, length + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) of each item; ``lengths`` must be in descending order, 1..window."""
    tree, at, offset, n = CapacityTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length) if length < window else None
        if found is None:
            found = (window, n)
            n += 1
        room, w = found
        at.append(w)
        offset.append(window - room)
        if room > length:
            tree.add(room - length, w)
    return at, offset


def cut_pieces(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW,
               end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document: full windows, then the rest.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty
    text is the end id alone. Repeated rows give repeated pieces. A null
    doc_id comes out as ``NULL_ID``.
    """
    path = tokenizer_path or default_path()
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], enc.encode(batch["text"].tolist())):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start:4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    ship_package(docs.sparkSession)
    return with_id(docs, "doc_id", "text").mapInPandas(trimmed(cut), PIECES)


def pack_pieces(pieces: DataFrame, window: int = WINDOW, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Place pieces (length <= window) into sequences; adds sequence_id and offset.

    ``pieces`` must be a written table, for it is read twice and its rows are numbered where they lie: shards are dealt
    by that number, so the pieces of one id, or of one null id on a third of all rows, spread over all shards.
    A sequence id is (shard << 32) + the window's number in its shard. Offsets in a sequence run from 0 without a gap. Ties
    are broken by doc_id, start, checksum and number, so a rerun of a lost task places every piece as before.
    """
    shards = max(1, -(-pieces.count() // shard_items))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32", "_number"],
                                  ascending=[False, True, True, True, True], kind="stable")
        at, offset = best_fit_decreasing(group["length"].tolist(), window)
        first = int(group["_shard"].iloc[0]) << 32
        group["sequence_id"] = np.array(at, "int64") + first
        group["offset"] = offset
        return group.drop(columns=["_shard", "_number"])

    out = (pieces.withColumn("_number", F.monotonically_increasing_id())
           .withColumn("_shard", F.pmod(F.xxhash64("_number"), F.lit(shards))))
    return out.groupBy("_shard").applyInPandas(pack, PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece of every document with its place in a packed sequence; an empty table gives none."""
    return null_ids(pack_pieces(materialize(cut_pieces(docs, tokenizer_path, window), "pieces"), window))
