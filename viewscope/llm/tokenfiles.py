"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a range of documents in ascending doc_id order (a
range ends after a number of documents, within one id if need be). Ids are cut into blocks of 1,024; a block stores its minimum, the differences
packed at the bit width of their 90th percentile, and an exception list
(position, difference) for the rest. An index gives the start of every block,
and a table gives doc_id and token count of every document, so a range of ids
can be read without the blocks before it.

Layout, little-endian: header (magic, counts, block size) | blocks | block
starts (u64) | doc ids (i64) | token counts (u32).
Block: minimum u32, n u16, exceptions u16, width u8, packed u64 words,
positions u16, differences u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewscope.llm.common import null_ids, trimmed, with_id
from viewscope.llm.wordbpe import END_ID, default_path, encoder
from viewscope.session import materialize, scratch_path, ship_package

BLOCK = 1024
PERCENTILE = 0.9
FILE_TEXT_BYTES = 16 << 20
_HEADER = struct.Struct("<4sIQQQ")
_BLOCK = struct.Struct("<IHHB")
_MAGIC = b"PFOR"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, 64) values below 2**width to (rows, width) words."""
    lanes = np.ascontiguousarray(values.T).astype(np.uint64)
    words = np.zeros((width, values.shape[0]), np.uint64)
    for j in range(64):
        i, shift = divmod(j * width, 64)
        words[i] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            words[i + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T)
    out = np.zeros((64, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        i, shift = divmod(j * width, 64)
        v = lanes[i] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (lanes[i + 1] << np.uint64(64 - shift))
        out[j] = v & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a run of unsigned 32-bit ids."""
    n = len(ids)
    if not n:
        return []
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    cut = np.partition(diff, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    widths = np.array([int(c).bit_length() for c in cut])
    out: list[bytes] = [b""] * blocks
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        part = diff[rows]
        over = part >= np.uint64(1 << int(width))
        at = np.where(over, 0, part)
        words = _pack(at.reshape(-1, 64), int(width)).reshape(len(rows), -1) if width else None
        where, pos = np.nonzero(over)
        high, edges = part[where, pos].astype("<u4"), np.searchsorted(where, np.arange(len(rows) + 1))
        pos = pos.astype("<u2")
        for k, b in enumerate(rows):
            e = slice(edges[k], edges[k + 1])
            size = min(BLOCK, n - int(b) * BLOCK)
            body = words[k].astype("<u8").tobytes() if width else b""
            out[b] = (_BLOCK.pack(int(low[b]), size, e.stop - e.start, int(width)) + body
                      + pos[e].tobytes() + high[e].tobytes())
    return out


def decode_block(data: memoryview | bytes, at: int) -> np.ndarray:
    low, size, exceptions, width = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    n_words = BLOCK // 64 * width
    if width:
        words = np.frombuffer(data, "<u8", n_words, at).reshape(-1, width)
        diff = _unpack(words, width).reshape(-1)
    else:
        diff = np.zeros(BLOCK, np.uint64)
    at += 8 * n_words
    pos = np.frombuffer(data, "<u2", exceptions, at)
    diff[pos] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    return (diff[:size] + np.uint64(low)).astype("<u4")


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    starts = np.cumsum([_HEADER.size] + [len(b) for b in blocks[:-1]]) if blocks else np.empty(0)
    return b"".join([_HEADER.pack(_MAGIC, BLOCK, len(doc_ids), len(ids), len(blocks)), *blocks,
                     starts.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(),
                     counts.astype("<u4").tobytes()])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, token counts, ids) of a file."""
    magic, block, n_docs, n_ids, n_blocks = _HEADER.unpack_from(data)
    if magic != _MAGIC or block != BLOCK:
        raise ValueError("not a token file")
    tail = len(data) - 12 * n_docs - 8 * n_blocks
    starts = np.frombuffer(data, "<u8", n_blocks, tail)
    doc_ids = np.frombuffer(data, "<i8", n_docs, tail + 8 * n_blocks)
    counts = np.frombuffer(data, "<u4", n_docs, tail + 8 * n_blocks + 8 * n_docs)
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts.astype(np.int64)[:, None] + np.arange(_BLOCK.size)]
    low = head[:, :4].copy().view("<u4").ravel()
    exceptions, widths = head[:, 6:8].copy().view("<u2").ravel().astype(np.int64), head[:, 8].astype(np.int64)
    body = starts.astype(np.int64) + _BLOCK.size
    grid = np.zeros((n_blocks, BLOCK), np.uint64)
    for width in np.unique(widths):   # blocks of one width are unpacked together
        rows = np.flatnonzero(widths == width)
        if width:
            words = raw[body[rows][:, None] + np.arange(BLOCK // 8 * width)].view("<u8").reshape(-1, int(width))
            grid[rows] = _unpack(words, int(width)).reshape(len(rows), BLOCK)
    for b in np.flatnonzero(exceptions):
        at, n = int(body[b] + BLOCK // 8 * widths[b]), int(exceptions[b])
        grid[b, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    ids = (grid + low[:, None].astype(np.uint64)).astype("<u4").ravel()[:n_ids]   # only the last block is part-filled
    return doc_ids, counts, ids


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID,
                      file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write the ids of every document to files under ``path``; returns (file_no, file, n_docs, n_ids).

    ``docs`` needs doc_id and text. Files follow ascending doc_id (repeated
    ids by text hash); a null text is the end id alone, a null doc_id comes first. A file
    appears under its final name only when complete, so a rerun task replaces it with the same bytes.
    """
    vocabulary = tokenizer_path or default_path()
    spark = docs.sparkSession
    ship_package(spark)
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    files = max(1, -(-total // file_text_bytes))
    tail = np.array([end_id], "<u4").tobytes()
    place = path if "://" in path or not path.startswith("file:") else "file://" + path[5:]

    def write(batches):
        from pyspark import TaskContext

        enc, context = encoder(vocabulary), TaskContext.get()
        ids, doc_ids, counts = [], [], []
        for batch in batches:
            got = [x + tail for x in enc.encode(batch["text"].tolist())]
            ids.append(b"".join(got))
            counts.append(np.array([len(x) // 4 for x in got], "<u4"))
            doc_ids.append(batch["doc_id"].to_numpy("int64"))
        if not doc_ids:
            return
        store, folder = _store(place)
        store.create_dir(folder, recursive=True)
        name = f"part-{context.partitionId():06d}.ids"
        aside = f"{folder}/.{name}.{context.taskAttemptId()}"
        body = encode_file(np.concatenate(doc_ids), np.concatenate(counts), np.frombuffer(b"".join(ids), "<u4"))
        with store.open_output_stream(aside) as out:
            out.write(body)
        store.move(aside, f"{folder}/{name}")
        n = sum(map(len, counts))
        yield pd.DataFrame({"file_no": [context.partitionId()], "file": [f"{place}/{name}"], "n_docs": [n],
                            "n_ids": [sum(map(len, ids)) // 4]})

    # the row number only cuts runs of equal rows, so one id, or one id and text, may fill many files
    keyed = with_id(docs, "doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = (keyed.repartitionByRange(files, "doc_id", "_hash", "_row")
               .sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text"))
    return materialize(ordered.mapInPandas(trimmed(write), "file_no long, file string, n_docs long, n_ids long"),
                       "token-files")


def read_token_files(listing: DataFrame) -> DataFrame:
    """One row per document of the listed files: doc_id, start, n_tokens, ids_crc32."""
    def read(batches):
        for batch in batches:
            for no, file in zip(batch["file_no"], batch["file"]):
                store, name = _store(file)
                with store.open_input_file(name) as f:
                    doc_ids, counts, ids = decode_file(f.read())
                ends = np.cumsum(counts, dtype="int64")
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pd.DataFrame({"file_no": no, "doc_id": doc_ids, "_at": ends - counts,
                                    "n_tokens": counts.astype("int64"), "ids_crc32": crc})

    # the listing has one row per file; its running sum places the files one after another
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    firsts = listing.select("file_no", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_first"))
    files = max(1, listing.count())
    rows = (listing.select("file_no", "file").repartition(files, "file_no")
            .mapInPandas(trimmed(read), "file_no long, doc_id long, _at long, n_tokens long, ids_crc32 long"))
    return null_ids(rows.join(firsts, "file_no").select(
        "doc_id", (F.col("_first") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32"))


def token_files(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_token_files(write_token_files(docs, scratch_path(spark, "tokens"), tokenizer_path))
