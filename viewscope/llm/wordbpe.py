"""Word-level front of a ``tokenizers`` model, shared by packing and the token files.

The pre-tokenizer of the vocabulary drops white space and no pre-token spans
it, and its normalizer composes and lower-cases without looking across a blank, so the
ids of a text are the ids of its blank-separated chunks, one after another.
Each worker keeps the ids of chunks it has seen, in two bounded generations; the library's BPE
model encodes a new word of plain letters, the whole library every other new chunk.
A vocabulary whose normalizer or pre-tokenizer differs is used as it is, text by text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

END_ID = 1
_CACHE_CHUNKS = 250_000     # chunks of a generation, about 200 bytes each; the one before it is kept as well
_CACHE_CHUNK_BYTES = 32     # longer chunks are encoded each time
_SLAB_BYTES = 4 << 20       # texts encoded at once
# plain letters: ASCII and the composed letters U+00C0..U+00FF, which the normalizer only lower-cases
_LETTERS = rb"(?:[a-zA-Z]++|(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)++"
_PLAIN = re.compile(_LETTERS)
# first bytes of U+0300..U+037F: such marks compose with the letter before them, differently in either case
_MARKS = re.compile(rb"[\xcc\xcd]")

# fixed values: the normalizer and the split that the chunks rely on
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _splits_at_blanks(spec: dict) -> bool:
    normalizer, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers") or [{}]
    return ([n.get("type") for n in normalizer.get("normalizers", [])] == _NORMALIZERS
            and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and parts[0].get("pattern") == {"Regex": _SPLIT} and spec["model"].get("type") == "BPE")


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Chunks(dict):
    """Ids of chunks; a chunk not in this generation or the last is encoded."""

    def __init__(self, model):
        super().__init__()
        self._library, self._model, self._last = model, model.model, {}
        self._letters = _byte_letters()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self._last.get(chunk)
        if ids is None:
            text = chunk.decode()
            if _PLAIN.fullmatch(chunk):   # one pre-token that only has to be lower-cased
                text = text.lower()
                spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self._letters)
                ids = array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()
            else:
                ids = array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()
            if len(chunk) > _CACHE_CHUNK_BYTES:
                return ids
        if len(self) >= _CACHE_CHUNKS:    # frequent chunks come back from the last generation as they are met
            self._last = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


def _chunk_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of bytes that end with a blank: runs without blanks, cut once before the first ASCII
    punctuation but the apostrophe if only plain letters lie before it.
    """
    kind = _KINDS[raw]
    blank = np.flatnonzero(kind == _BLANK)
    first = np.append(0, blank[:-1] + 1)
    full = first < blank
    starts, ends = first[full], blank[full]
    after, before = np.append(raw[1:], 32), np.append(32, raw[:-1])
    letter = (kind == _ASCII) | ((raw == 0xC3) & _AFTER_C3[after]) | ((before == 0xC3) & _AFTER_C3[raw])
    others = np.flatnonzero(~letter)
    stop = others[np.searchsorted(others, starts)]           # a blank at the latest
    cut = stop[(stop > starts) & (kind[stop] == _PUNCTUATION)]
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


_BLANK, _ASCII, _PUNCTUATION = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x0A]] = _BLANK
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _ASCII
_KINDS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = _PUNCTUATION
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordEncoder:
    """Encodes whole texts; ``encode`` returns little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self._by_chunk = _splits_at_blanks(json.load(f))
        self._model = Tokenizer.from_file(path)
        self._known = _Chunks(self._model)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without an end id; a null text has none."""
        if not self._by_chunk:
            return [array("I", self._model.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            if b"<|" in raw:             # may spell a special token, whose case counts
                out[i] = b"".join(map(self._known.__getitem__, raw.split()))
                continue
            held.append((i, raw if _MARKS.search(raw) else raw.lower()))
            size += len(raw)
            if size >= _SLAB_BYTES:
                self._encode(held, out)
                held, size = [], 0
        if held:
            self._encode(held, out)
        return out

    def _encode(self, held: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Encodes some texts at once: each distinct chunk is looked up once, its ids are copied to its places."""
        joined = b"\n".join([raw for _, raw in held]) + b"\n"
        padded = joined + bytes(16)
        starts, ends = _chunk_edges(np.frombuffer(joined, np.uint8))
        if not len(starts):
            return
        # a chunk of up to 15 bytes is told by two words that end with its length; longer ones by their bytes
        words = np.ndarray((len(joined) + 8,), "<u8", padded, strides=(1,))
        length = ends - starts
        low = words[starts] & _MASKS[np.minimum(length, 8)]
        high = words[np.minimum(starts + 8, len(joined))] & _MASKS[np.clip(length - 8, 0, 7)]
        high |= np.minimum(length, 255).astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(length > 15)
        numbers: dict[bytes, int] = {}
        low[long] = [numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        high[long] = np.iinfo(np.uint64).max
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) + (high >> np.uint64(29)))
        _, at, which = np.unique(mixed, return_index=True, return_inverse=True)
        if ((low[at][which] != low) | (high[at][which] != high)).any():      # two chunks share a mixed word
            _, at, which = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        ids = [self._known[joined[a:b]] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        flat = np.frombuffer(b"".join(ids), "<u4")
        count = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        begin = np.cumsum(count) - count
        n = count[which]
        token_ends = np.cumsum(n)
        placed = flat[np.repeat(begin[which] - (token_ends - n), n) + np.arange(token_ends[-1])].tobytes()
        text_ends = np.cumsum([len(raw) + 1 for _, raw in held])
        edges = np.append(0, token_ends)[np.searchsorted(starts, text_ends)] * 4
        for (i, _), a, b in zip(held, [0, *edges[:-1].tolist()], edges.tolist()):
            out[i] = placed[a:b]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
