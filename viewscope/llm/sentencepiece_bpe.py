"""SentencePiece merge-type encoding by backtracking, and decoding.

A token sequence is the merge result of a text exactly if every token, and
every pair of adjacent tokens, is the merge result of its own characters. The
encoder therefore takes the longest vocabulary match at each position (all
matches come from one Aho-Corasick pass), checks it against the token before
by merging the two again, falls back to shorter matches, and backs out of a
position for which none fits, noting it in a bitfield of failed positions.

No piece of the vocabulary has the word mark after another character, so a
mark that follows another character begins an independent chunk; so does a
character that no piece contains. Each worker keeps the ids of the chunks it
has met. A vocabulary without that property is encoded text by text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from viewscope.llm.common import null_ids, trimmed, with_id
from viewscope.session import ship_package

MARK = "▁"
_CACHE_CHUNKS = 1_000_000
_CACHE_CHUNK_CHARS = 32
_PAIRS = 500_000
_TEXTS = 500   # texts whose new chunks are encoded together


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        self.plain = all(sp.normalize(x) == MARK + x.replace(" ", MARK) for x in ("a  b ", "Ａﬁé\n\t", "x"))
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: dict[int, bytes] = {}
        self.byte_ids: dict[int, int] = {}
        self.silent: set[int] = set()
        self.marked: set[int] = set()   # pieces that begin with the word mark
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_control(i):
                self.silent.add(i)
            elif sp.is_unknown(i):
                self.unk = i
                self.bytes_of[i] = " ⁇ ".encode()
            else:
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                if piece[0] == MARK:
                    self.marked.add(i)
        # a piece that merging its own characters doesn't give is never a token
        self.usable = {p for p in self.ids if self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for piece in self.usable:
            self.automaton.add_word(piece[::-1], len(piece))
        self.automaton.make_automaton()
        self.chunk = self._chunk_pattern()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}   # ids of a chunk, joined by commas
        self.shown = {str(i).encode(): b for i, b in self.bytes_of.items()}

    def _chunk_pattern(self) -> re.Pattern | None:
        """Cuts a text where two neighbouring characters stand together in no piece, so no merge crosses."""
        inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(pair[1] == MARK != pair[0] for pair in inside) or "\n" in set("".join(self.ids)):
            return None
        before_stop = "".join(c for c in "abcdefghijklmnopqrstuvwxyzäöüßéèêçñíó"
                              if c + "." not in inside and c + "," not in inside)
        word = f"{MARK}*[{before_stop}]+(?=[.,])|" if before_stop else ""
        return re.compile(f"{word}{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")

    # -- merging, the definition that pairs are checked against

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored adjacent pair, leftmost first, until none is a piece."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        score, queue = self.score, []
        for i in range(len(part) - 1):
            s = score.get(part[i] + part[i + 1])
            if s is not None:
                queue.append((-s, i, part[i], part[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i] if part[i] == left else len(part)
            if j >= len(part) or part[j] != right or part[i] is None:
                continue
            part[i], part[j] = left + right, None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(part):
                    s = score.get(part[a] + part[b])
                    if s is not None:
                        heapq.heappush(queue, (-s, a, part[a], part[b]))
        return [p for p in part if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the characters of two tokens gives these two tokens again."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > _PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    # -- backtracking

    def longest(self, text: str) -> list[int]:
        """Length of the longest piece at each position; 1 where a character is no piece."""
        n = len(text)
        met = np.fromiter(chain.from_iterable(self.automaton.iter(text[::-1])), np.int64).reshape(-1, 2)
        out = np.ones(n, np.int64)
        np.maximum.at(out, n - 1 - met[:, 0], met[:, 1])
        return out.tolist()

    def walk(self, text: str, longest: list[int]) -> list[str]:
        n, at, pieces, fits = len(text), 0, self.usable, self.fits
        take = longest[0]
        out: list[str] = []
        failed = 0
        while at < n:
            token = text[at:at + take]
            if not failed >> (at + take) & 1 and (not out or fits(out[-1], token)):
                out.append(token)
                at += take
                take = longest[at] if at < n else 0
                continue
            take -= 1
            while take > 1 and text[at:at + take] not in pieces:
                take -= 1
            while take == 0:   # no match fits here: note it, drop the token before and shorten that
                failed |= 1 << at
                take = len(out.pop())
                at -= take
                take -= 1
                while take > 1 and text[at:at + take] not in pieces:
                    take -= 1
        return out

    def tokens(self, text: str) -> list[str]:
        return self.walk(text, self.longest(text)) if text else []

    def many_tokens(self, chunks: list[str]) -> list[list[str]]:
        """Tokens of chunks, with one Aho-Corasick pass over all of them."""
        if not self.chunk:
            return [self.tokens(c) for c in chunks]
        longest, at, out = self.longest("\n".join(chunks)), 0, []   # no piece holds a line end
        for c in chunks:
            out.append(self.walk(c, longest[at:at + len(c)]) if c else [])
            at += len(c) + 1
        return out

    def token_ids(self, tokens: list[str]) -> list[int]:
        out = []
        for token in tokens:
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in token.encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        s = MARK + text.replace(" ", MARK) if self.plain else self.normalize(text)
        return self.chunk.findall(s) if self.chunk else [s]

    def encode(self, text: str | None) -> list[int]:
        return [i for t in self.many_tokens(self._chunks(text or "")) for i in self.token_ids(t)]

    # -- decoding

    @staticmethod
    def _text(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:   # every byte outside a valid character counts alone
            return re.sub("[\udc80-\udcff]", "�", raw.decode(errors="surrogateescape"))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; a control id shows nothing but ends a run of byte pieces."""
        runs: list[list[int]] = [[]]
        for i in ids:
            if i in self.silent:
                runs.append([])
            else:
                runs[-1].append(i)
        runs = [r for r in runs if r]
        raw = [b"".join([self.bytes_of[i] for i in r]) for r in runs]
        if runs and runs[0][0] in self.marked:   # the blank that encoding put before the text
            raw[0] = raw[0][1:]
        return "".join(map(self._text, raw))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: token count, SHA-256 of the joined ids, SHA-256 of the text decoded from them."""
        known, shown, out = self.known, self.shown, []
        if len(known) > _CACHE_CHUNKS:
            known.clear()
        split = [self._chunks(t or "") for t in texts]
        missing = sorted(set().union(*split).difference(known))
        learned = {c: ",".join(map(str, self.token_ids(t))).encode() for c, t in zip(missing, self.many_tokens(missing))}
        known.update((c, v) for c, v in learned.items() if len(c) <= _CACHE_CHUNK_CHARS)
        longer = {c: v for c, v in learned.items() if len(c) > _CACHE_CHUNK_CHARS}
        for chunks in split:
            joined = b",".join([longer[c] if c in longer else known[c] for c in chunks] if longer
                               else map(known.__getitem__, chunks))
            ids = joined.split(b",") if joined else []
            raw = b"".join([shown[i] for i in ids])
            decoded = self._text(raw[1:] if ids and int(ids[0]) in self.marked else raw)
            out.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker and model."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded text of every document; a null text counts as empty (no ids)."""
    path = model_path or default_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [c.decode(i) for i in ids]})

    ship_package(docs.sparkSession)
    return null_ids(with_id(docs, "doc_id", "text").mapInPandas(trimmed(run), "doc_id long, ids array<int>, decoded string"))


def encode_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document, from the same codec: n_tokens, ids_sha256, decoded_sha256.

    Each row stands alone: repeated rows repeat, an empty table gives none.
    """
    path = model_path or default_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = batch["text"].tolist()
            rows = [r for i in range(0, len(texts), _TEXTS) for r in c.digests(texts[i:i + _TEXTS])]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    ship_package(docs.sparkSession)
    return null_ids(with_id(docs, "doc_id", "text").mapInPandas(
        trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
