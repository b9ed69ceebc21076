"""Operators of viewscope.llm against the libraries they must equal, or against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from viewscope.llm import (
    collision_hash, jaccard_join, langid, mtree, packing, quality, sentencepiece_bpe, suffix_dedup, tokenfiles,
    url_rules, vector_blocks, wordbpe,
)

PARTS = list("abcdeéthé  \n\t▁▁<>s/\x00あ漢😀ßİΣ'.,!|") + [
    "the", "ing", " the", "  ", "</s>", "<0x0A>", "<|endoftext|>", "<|ENDOFTEXT|>", "'RE", "É", "é", "\x1c", "\x85",
    "\r\n"]
SF = "/root/testdata/sf0.001"


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(0, 40))) for _ in range(n)]


WORDS = "alpha beta gamma delta one two three four five six seven eight nine ten red green blue".split()


def odd_documents():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated and missing ids."""
    rnd = random.Random(3)
    base = " ".join(rnd.choices(WORDS, k=200))
    near = base.replace("alpha", "omega", 1)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 80))), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s0"), (102, near, "en", "s1"), (103, None, None, None),
             (104, "", "en", "s1"), (105, " ", "en", None), (106, "x" * 5000, "de", "s2"),
             (107, "é漢😀 " * 300, None, "s2"), (108, "12345 !!! ...", "en", "s2"),
             (109, " ".join(rnd.choices(WORDS, k=20_000)), "de", "s2"), (50, base + " tail", "de", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # clashing extra columns must not matter
    return spark.createDataFrame([r + (7, 8, "z") for r in odd_documents()],
                                 "doc_id long, text string, lang string, source string, start int, rep long, _key string")


def empty(docs):
    return docs.limit(0)


# ---------------------------------------------------------------- 1 packing, 6 token files


def test_best_fit_against_scan():
    rnd = random.Random(2)
    lengths = sorted((rnd.randint(1, 64) for _ in range(400)), reverse=True)
    at, offset = packing.best_fit_decreasing(lengths, 64)
    room = {}
    for length, w, o in zip(lengths, at, offset):
        fitting = [r for r in room.values() if r >= length]
        if w in room:
            assert room[w] == min(fitting) and o == 64 - room[w]
        else:
            assert o == 0 and (not fitting or length == 64)
            room[w] = 64
        room[w] -= length
    assert min(room.values()) >= 0


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer

    model, texts = Tokenizer.from_file(wordbpe.default_path()), random_texts(3000)
    for text, ids in zip(texts, wordbpe.WordEncoder(wordbpe.default_path()).encode(texts)):
        assert model.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), repr(text)


def test_word_encoder_equals_library_with_composing_marks():
    """Every ASCII letter before every mark U+0300..U+036F, alone and in words: letters compose before they are lower-cased."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(wordbpe.default_path())
    texts = [f"{c}{chr(m)}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ=<" for m in range(0x300, 0x370)]
    texts += [f"The {a}x{b}, {c}'S É{b}" for a, b, c in zip(texts[::7], texts[3::7], texts[5::7])] + ["K\u212b \u0340a", "\u00c5\u0301."]
    for text, ids in zip(texts, wordbpe.WordEncoder(wordbpe.default_path()).encode(texts)):
        assert model.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), ascii(text)


def test_word_encoder_generations_and_other_vocabularies(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(wordbpe, "_CACHE_CHUNKS", 50)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        model, enc = Tokenizer.from_file(path), wordbpe.WordEncoder(path)
        assert enc._by_chunk == (name == "word_bpe_49k.json")
        for _ in range(2):
            texts = random_texts(300, seed=8) + ["Éa ÀÖ ßÿ Þ", "don't WE'LL", "x" * 80]
            for text, ids in zip(texts, enc.encode(texts)):
                assert model.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), ascii(text)
        assert len(enc._known) <= 50


def expected_ids(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(wordbpe.default_path())
    return {r[0]: np.array(model.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows}


def test_packing_covers_every_id(spark, docs):
    ids = expected_ids(odd_documents())
    rows = packing.pack_documents(docs).collect()
    got = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        got[r.doc_id].append((r.start, r.length))
    for doc_id, x in ids.items():
        at = 0
        for start, length in sorted(got[doc_id]):
            assert start == at
            at += length
        assert at == len(x)
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    # no two part-filled windows of the shard fit together
    assert sum(map(len, ids.values())) > 0.9 * 2048 * (len(used) - 1)
    assert packing.pack_documents(empty(docs)).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [7] * 2048, list(range(3000)), [4_000_000_000, 0, 1, 2] * 700,
                                 list(np.random.default_rng(1).integers(0, 49408, 5000))])
def test_blocks_round_trip(ids):
    x = np.array(ids, "<u4")
    doc, counts, back = tokenfiles.decode_file(tokenfiles.encode_file(np.array([3]), np.array([len(x)]), x))
    assert doc.tolist() == [3] and counts.tolist() == [len(x)] and (back == x).all()


def test_token_files(spark, docs):
    ids = expected_ids(odd_documents())
    rows = sorted(tokenfiles.token_files(docs).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    assert len(rows) == len(ids)
    assert tokenfiles.token_files(empty(docs)).count() == 0
    none = spark.createDataFrame([(None, "a b"), (4, None), (4, "c")], "doc_id long, text string")
    assert [r.doc_id for r in sorted(tokenfiles.token_files(none).collect(), key=lambda r: r.start)] == [None, 4, 4]


def test_packing_and_files_of_null_and_repeated_ids(spark):
    """More than half of all rows share a null id, others repeat id and text; every piece is placed once."""
    rows = [(None, f"null {i % 40} " * (i % 90)) for i in range(900)] + [(7, "same text"), (7, "same text"), (7, "other"), (8, None)] * 20
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want, distinct = collections.Counter(), sorted({t or "" for _, t in rows})
    encoded = dict(zip(distinct, expected_ids(list(enumerate(distinct))).values()))
    for doc_id, text in rows:
        ids = encoded[text or ""]
        want.update((doc_id, s, zlib.crc32(ids[s:s + 2048].tobytes())) for s in range(0, len(ids), 2048))
    pieces = packing.materialize(packing.cut_pieces(table), "pieces")
    placed = packing.null_ids(packing.pack_pieces(pieces, shard_items=100)).collect()
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in placed) == want
    assert len({r.sequence_id >> 32 for r in placed if r.doc_id is None}) > 5      # dealt over the shards
    files = tokenfiles.write_token_files(table, packing.materialize.__globals__["scratch_path"](spark, "t"), file_text_bytes=2000)
    assert files.count() > 5 and max(r.n_docs for r in files.collect()) < 400
    back = sorted(tokenfiles.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None] * 900 + [7] * 60 + [8] * 20
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back])[:-1].tolist()


# ---------------------------------------------------------------- 4 SentencePiece


def test_pieces_equal_library():
    import sentencepiece

    path = sentencepiece_bpe.default_path()
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.PieceCodec(path)
    texts = random_texts(3000) + ["", " ", "  a", "漢" * 300, "a" * 2000]
    for text, (n, ids, decoded) in zip(texts, codec.digests(texts)):
        want = sp.encode(text)
        assert codec.encode(text) == want, repr(text)
        back = sp.decode(want)
        assert codec.decode(want) == back
        assert n == len(want) and ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert decoded == hashlib.sha256(back.encode()).hexdigest()
    rnd = random.Random(5)
    for _ in range(2000):   # any ids, also broken bytes and control ids
        ids = [rnd.choice([rnd.randrange(259), rnd.randrange(32000)]) for _ in range(rnd.randint(0, 8))]
        assert codec.decode(ids) == sp.decode(ids)


def test_pieces_of_odd_documents(docs):
    rows = {r.doc_id: r for r in sentencepiece_bpe.encode_digests(docs).collect()}
    assert len(rows) == len(odd_documents()) and rows[103].n_tokens == rows[104].n_tokens == 0
    assert sentencepiece_bpe.encode_digests(empty(docs)).count() == 0


# ---------------------------------------------------------------- 5 suffix dedup


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                gone[p:p + length] = b"\x01" * length
            seen.add(raw[p:p + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_refine_orders_equal_strings():
    rnd = np.random.default_rng(4)
    data = rnd.integers(97, 99, 400).astype(np.uint8)
    data = np.concatenate([data, data[50:250], np.full(150, 97, np.uint8)])
    starts = np.arange(len(data) - 40 + 1)
    bucket = suffix_dedup.bucket_pointer_refine(data, starts, 40, 8)
    groups = collections.defaultdict(set)
    for s in starts:
        groups[data[s:s + 40].tobytes()].add(int(s))
    for members in groups.values():
        found = {int(bucket[s]) for s in members}
        assert len(found) == 1 and (found == {-1}) == (len(members) == 1)
        if len(members) > 1:
            assert {int(s) for s in starts[bucket == found.pop()]} == members


def test_repeats_against_brute_force(docs, monkeypatch):
    rows = [(r[0], r[1]) for r in sorted(odd_documents(), key=lambda r: r[0])]
    want = brute_repeats(rows)
    for switch in ("plain", "hot", "long runs"):
        if switch == "hot":           # every minimizer is treated as hot
            monkeypatch.setattr(suffix_dedup, "_SAMPLE", 1)
            monkeypatch.setattr(suffix_dedup, "HOT_SPANS", 1)
        if switch == "long runs":     # runs of a minimizer are cut wherever they can be
            monkeypatch.undo()
            monkeypatch.setattr(suffix_dedup, "_HELD_ROWS", 0)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
               for r in suffix_dedup.remove_repeats(docs).collect()}
        assert got == want
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def in_order(frame):
    """(doc_id, text) in the order in which rows count: id, null first, then the hashes of the text."""
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    return [(r.doc_id, r.text) for r in frame.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(text),
                                                      F.xxhash64(F.lit(1), text)).collect()]


@pytest.mark.parametrize("low", [3, -(1 << 63)])
def test_repeats_with_shared_missing_and_extreme_ids(spark, low):
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(90, 400))) for _ in range(12)]
    texts += [texts[0][50:] + texts[1], texts[2], texts[3][:150] + "é" * 60 + texts[3][150:], None, ""]
    ids = [low, None, (1 << 62) + 5, (1 << 63) - 1, 7]
    rows = [(rnd.choice(ids), rnd.choice(texts)) for _ in range(60)] + [(None, texts[0])] * 40
    frame = spark.createDataFrame([r + (5, 6) for r in rows], "doc_id long, text string, _number int, _ranges int").repartition(4)
    ordered = in_order(frame)
    want = brute_repeats([(i, t) for i, (_, t) in enumerate(ordered)])
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                              for r in suffix_dedup.remove_repeats(frame).collect())
    assert got == collections.Counter((i, *want[n]) for n, (i, _) in enumerate(ordered))
    # the stage cuts the same bytes, and keeps columns named like its own
    cut = suffix_dedup.dedup_texts(frame)
    assert cut.columns == frame.columns and cut.agg({"_number": "min", "_ranges": "max"}).first()[:] == (6, 5)[::-1]
    whole = [len((r.text or "").encode()) for r in cut.collect()]
    assert sum(whole) <= sum(n - gone for n, gone, _, _ in want.values())
    # no id is shared: ids are the numbers
    one = spark.createDataFrame(list({i: (i, t) for i, t in rows if i is not None}.values()), "doc_id long, text string")
    want = brute_repeats(in_order(one))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(one).collect()} == want


def test_texts_cut_with_shared_and_missing_ids(spark):
    rnd = random.Random(7)
    a, b, c = ("".join(rnd.choices("abcdefgh ", k=300)) for _ in range(3))
    big = (1 << 60) + 1
    rows = [(None, a), (None, c), (1, b), (1, b), (1, "z" + a), (2, None), (3, c), (big, a + "é")]
    frame = spark.createDataFrame([r + (None,) for r in rows], "doc_id long, text string, n_chars int")
    got = [(r.doc_id, r.text, r.n_chars) for r in suffix_dedup.dedup_texts(frame).collect()]
    want = [(None, a), (None, c), (1, b), (1, ""), (1, "z"), (2, None), (3, ""), (big, "é")]
    assert collections.Counter(got) == collections.Counter((i, t, None if t is None else len(t)) for i, t in want)
    alone = frame.where("doc_id > 1")   # no id is shared: ids are the numbers
    assert {(r.doc_id, r.text) for r in suffix_dedup.dedup_texts(alone).collect()} == {(2, None), (3, c), (big, a + "é")}


# ---------------------------------------------------------------- 9 Jaccard join


def brute_links(rows):
    first, rep = {}, {}
    for doc_id, text in rows:
        rep[doc_id] = first.setdefault(text or "", doc_id)
    sets = {}
    for doc_id, text in rows:
        if rep[doc_id] == doc_id:
            w = (text or "").split()
            k = min(5, len(w))
            sets[doc_id] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = {d: d for d in sets}
    for _ in sets:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    n = collections.Counter(x for pair in links for x in pair)
    return {d: (rep[d], n[rep[d]], group[rep[d]]) for d in rep}


def near_rows():
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    rows = [(r[0], r[1]) for r in odd_documents() if r[0] != 109]
    for i in range(30):   # a chain of edits: near its neighbours, far from its ends
        base[rnd.randrange(150)] = f"n{i}"
        rows.append((200 + i, " ".join(base)))
    return rows


def test_links_against_brute_force(spark, monkeypatch):
    rows = near_rows()
    want = brute_links(sorted(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 8):   # also with groups larger than a block
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard_join.near_duplicates(frame).collect()}
        assert got == want
    kept = {r.doc_id for r in jaccard_join.keep_one(frame).collect()}
    assert kept == {v[2] for v in want.values()}
    assert jaccard_join.near_duplicates(frame.limit(0)).count() == 0


def shared_id_rows():
    """Texts a < b < c of no relation, near copies of each, ids null and repeated."""
    rnd = random.Random(14)
    a, b, c = sorted(" ".join(rnd.choices(WORDS, k=150)) for _ in range(3))
    near = lambda t, n: t + f" tail{n}"
    return [(None, a), (None, b), (7, b), (8, near(b, 1)), (5, c), (5, a), (6, near(c, 1)), (9, near(a, 1)), (5, c),
            (None, near(c, 2)), (None, None), (5, ""), (10, "alone in here")]


def test_links_with_shared_and_missing_ids(spark):
    rows = shared_id_rows()
    # the same rows with ids of their own, in the order that ids have, nulls first
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    links = brute_links([(n, rows[i][1]) for n, i in enumerate(order)])
    own = [rows[i][0] for i in order]
    size = collections.Counter(v[0] for v in links.values())
    texts = {n: rows[i][1] or "" for n, i in enumerate(order)}
    sets = {n: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for n, t in texts.items()}
    docs = {n: sum(size[m] for m in size if m != links[n][0] and sets[m] and sets[n]
                   and len(sets[n] & sets[m]) >= 0.8 * len(sets[n] | sets[m])) for n in links}
    want = sorted(((own[n], own[c], k, docs[n], own[g]) for n, (c, k, g) in links.items()), key=str)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):   # the result mustn't depend on where rows lie
        got = [tuple(r) for r in jaccard_join.near_duplicates(frame.repartition(parts)).collect()]
        assert sorted(got, key=str) == want


def test_one_row_stays_of_shared_and_missing_ids(spark):
    rows = shared_id_rows()
    a, b, c = sorted(t for _, t in rows[:2] + rows[4:5])
    got = [(r.doc_id, r.text or "") for r in jaccard_join.keep_one(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (None, c + " tail2"), (None, ""),
                                           (10, "alone in here")], key=str)
    same = spark.createDataFrame([(4, a), (4, a), (4, b), (4, a + " tail")], "doc_id long, text string")
    assert sorted(r.text.split(" tail")[0] for r in jaccard_join.keep_one(same).collect()) == [a, b]


def test_connected_equals_components_of_all_surviving_pairs():
    rng = np.random.default_rng(3)
    least = jaccard_join.least_matches()
    base = rng.integers(0, 1 << 32, (6, jaccard_join.HASHES), dtype=np.uint32)
    sig = base[rng.integers(0, 6, 90)].copy()
    for row in sig:   # copies differ in up to half of their values, so links are not transitive
        at = rng.choice(len(row), rng.integers(0, len(row) // 2), replace=False)
        row[at] = rng.integers(0, 1 << 32, len(at), dtype=np.uint32)
    hi, lo = np.arange(40), np.arange(40, 90)
    for left, right in ((np.arange(90), None), (hi, lo)):
        label = jaccard_join.connected(sig, left, right, least)
        i, j = jaccard_join.surviving_pairs(sig[left], None if right is None else sig[right], least)
        want = np.arange(90)
        for x, y in zip(left[i], (left if right is None else right)[j]):
            want[np.isin(want, [want[x], want[y]])] = min(want[x], want[y])
        assert label.tolist() == want.tolist()
        assert len(set(want.tolist())) > 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (31, 30), (200, 201)]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(32)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_matches()
    n = np.arange(jaccard_join.STEP, jaccard_join.HASHES + 1, jaccard_join.STEP)
    rng = np.random.default_rng(1)
    runs = rng.random((20_000, jaccard_join.HASHES)) < 0.8
    matches = runs.cumsum(axis=1)[:, n - 1]
    assert (matches >= np.array(least)).all(axis=1).mean() > 0.9999


# ---------------------------------------------------------------- 2 and 8 vector searches


def vectors(spark):
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((6, 16))
    x = centers[rng.integers(0, 6, 700)] + 0.3 * rng.standard_normal((700, 16))
    x[100:160] = x[100]          # many copies: ties
    rows = [(int(i), [float(np.float32(c)) for c in v], 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1100, [0.0] * 16, 1), (1200, [float("nan")] * 16, 1), (1300, [1.0], 1),
             (None, rows[0][1], 1), (1400, [None] + [1.0] * 15, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def test_inner_products_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 200)
    rows, frame = vectors(spark)
    good = [(i, np.floor(64 * np.array(v))) for i, v, _ in rows if i is not None and (i < 700 or i == 1100)]
    got = collections.defaultdict(list)
    for r in mtree.top_inner_products(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, x in good:
        if q % 20 == 0:
            want = sorted(((-int(x @ y), i) for i, y in good if i != q))[:20]
            assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {q for q, _ in good if q % 20 == 0}
    assert mtree.top_inner_products(frame.limit(0)).count() == 0


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 200)
    rows, frame = vectors(spark)
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and i < 700]
    got = collections.defaultdict(list)
    for r in collision_hash.nearest_vectors(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, x in good:
        if q % 100 == 0:
            want = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:10]
            assert len(got[q]) == 10
            assert all(abs(s - np.sqrt(((x - good[i][1]) ** 2).sum())) < 1e-9 for i, s in got[q])
            hits += len({i for _, i in want} & {i for i, _ in got[q]})
    assert hits >= 0.9 * 10 * len(got) and set(got) == {0, 100, 200, 300, 400, 500, 600}
    assert collision_hash.nearest_vectors(frame.limit(0)).count() == 0


def test_copies_of_a_lone_query(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(5)
    one = rng.standard_normal(64).tolist()
    ids = [100] + [i for i in range(101, 500) if i % 100]
    rows = [(i, one if i % 2 == 0 else rng.standard_normal(64).tolist()) for i in ids]
    got = collision_hash.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [i for i in ids[1:] if i % 2 == 0][:10]
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(100, i, 0.0) for i in want]


# ---------------------------------------------------------------- 3 quality, 7 language


def test_quality_on_labelled_documents(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge_quality(d, labels).join(labels.withColumnRenamed("quality", "label"), "doc_id").collect()
    assert np.mean([r.keep == (r.label == 1) for r in judged]) > 0.9


def test_quality_held_out_accuracy(spark):
    """Labels of a third of the documents are kept from the fit, the evidence and the site weight."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null")
    out = langid.held_out(labels["doc_id"])
    kept_out = labels.where(out).selectExpr("doc_id", "quality AS label")
    judged = quality.judge_quality(d, labels.where(~out)).join(kept_out, "doc_id").collect()
    assert len(judged) > 100 and np.mean([r.keep == (r.label == 1) for r in judged]) > 0.9


def test_own_evidence_stays_out_of_the_site_rate(spark):
    rows = [(i, "good words here", "a", "x") for i in range(30)] + [(100, "good words here", "lone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for label in (0, 1):
        labels = spark.createDataFrame([(100, label)] + [(i, i % 2) for i in range(30)], "doc_id long, quality int")
        lone = quality.judge_quality(docs, labels).where("doc_id = 100").first()
        total = (15 + label) / 31
        assert abs(lone.host_rate - total) < 1e-9 and abs(lone.path_rate - total) < 1e-9


def test_site_weight_is_the_likeliest(spark):
    rows = [(float(i % 2), 0.5, 1.0 if i % 2 else -1.0) for i in range(40)]
    fit = lambda r: quality.site_weight(spark.createDataFrame(r, "label double, p double, shift double"))
    assert fit(rows) == quality.WEIGHTS[-1] and fit([(1 - y, p, s) for y, p, s in rows]) == 0.0
    assert fit([(None, 0.5, 1.0)]) == quality.SITE_WEIGHT


def test_site_posteriors_shrink_sparse_sites(spark):
    rows = [(i, "big", "a", 0.9) for i in range(400)] + [(500 + i, "bad", "a", 0.1) for i in range(400)]
    rows += [(1000, "tiny", "a", 0.1)]
    sites, prior = quality.site_posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double"))
    rate = {r.host: r.path_rate for r in sites.collect()}
    assert rate["bad"] < rate["tiny"] < rate["big"] and abs(rate["bad"] - 0.1) < 0.05
    assert abs(rate["tiny"] - prior) < abs(0.1 - prior)


def test_quality_of_odd_documents(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    assert len(rows) == len(odd_documents()) and not rows[103].keep and not rows[104].keep
    none = quality.judge_quality(docs, labels.limit(0)).collect()
    assert all(r.keep == (r.doc_id not in (103, 104, 105)) for r in none)
    assert quality.judge_quality(empty(docs), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_rows_kept_with_shared_and_missing_ids(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")   # without a model only empty texts go
    rows = [(None, "some words"), (None, ""), (None, None), (1, " "), (1, "more words"), (1, "more words"), (2, "x")]
    frame = spark.createDataFrame([r + ("s", "en") for r in rows], "doc_id long, text string, source string, lang string")
    got = [(r.doc_id, r.text) for r in quality.keep_good(frame, labels).collect()]
    assert collections.Counter(got) == collections.Counter(r for r in rows if r[1] and r[1].strip())


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict_languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language_of_odd_documents(docs):
    rows = {r.doc_id: r for r in langid.predict_languages(docs).collect()}
    assert len(rows) == len(odd_documents())
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].rejected for i in (103, 104, 105, 108))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.predict_languages(empty(docs)).count() == 0


# ---------------------------------------------------------------- 10 URL rules


def test_urls_and_stated_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://x.org": ("x.org", "", None, None),
        "https://x.org/": ("x.org", "/", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://example.org/en/1#a/b": ("example.org", "/en/1", "example.org/en/1", "block"),
        "http://b.com/fr/9": ("b.com", "/fr/9", "com/fr/", "allow"),
        "http://com/de/": ("com", "/de/", "com/de/", "block"),
        "b.com/fr/": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "://q?z=1": ("q", "", None, None),
    }
    rows = [(i, u) for i, u in enumerate(cases)]
    got = {r.page_id: r for r in url_rules.judge_urls(
        spark.createDataFrame([r + ("k",) for r in rows], "page_id long, url string, host string")).collect()}
    for i, u in rows:
        host, path, rule, verdict = cases[u]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(none).count() == 0


def test_mined_rules_against_brute_force(spark):
    from itertools import combinations

    rnd = random.Random(12)
    data = [(sorted(rnd.sample("abcdef", rnd.randint(1, 4))), rnd.choice(["allow", "block", "block"])) for _ in range(200)]
    frame = spark.createDataFrame(data, "tokens array<string>, label string")
    got = {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), r.support)
           for r in url_rules.mine_rules(frame, 0.05, 0.6, 3)[0].collect()}
    total, joint = collections.Counter(), collections.Counter()
    for tokens, label in data:
        for k in (1, 2, 3):
            for c in combinations(tokens, k):
                total[c] += 1
                joint[c, label] += 1
    rules = {k: (joint[k] / total[k[0]], joint[k]) for k in joint if joint[k] >= 10 and joint[k] / total[k[0]] >= 0.6}
    want = {k: (round(c, 9), s) for k, (c, s) in rules.items()
            if not any(rules.get((tuple(t for t in k[0] if t != x), k[1]), (0, 0))[0] >= c for x in k[0])}
    assert got == want


def test_rules_of_four_tokens(spark):
    from itertools import combinations

    # all four tokens mean block, any three of them as often allow
    data = [(list("abcd"), "block")] * 20
    data += [(list(c), "allow") for c in combinations("abcd", 3) for _ in range(20)]
    rules = url_rules.mine_rules(spark.createDataFrame(data, "tokens array<string>, label string"), 0.05, 0.8)[0].collect()
    assert [(r.tokens, r.confidence, r.support) for r in rules if r.verdict == "block"] == [(list("abcd"), 1.0, 20)]


def brute_rules(data, least, sure):
    """Minimal rules of every size over token sets, with the tokens of a class replaced by the least of them."""
    from itertools import combinations

    where = collections.defaultdict(list)
    for i, (tokens, _) in enumerate(data):
        for t in set(tokens):
            where[t].append(i)
    rep = {t: min(u for u in where if where[u] == where[t]) for t in where if len(where[t]) >= least}
    total, joint = collections.Counter(), collections.Counter()
    for tokens, label in data:
        own = sorted({rep[t] for t in tokens if t in rep})
        for k in range(1, len(own) + 1):
            for c in combinations(own, k):
                total[c] += 1
                joint[c, label] += 1
    rules = {k: joint[k] / total[k[0]] for k in joint if joint[k] >= least and joint[k] / total[k[0]] >= sure}
    return {k: (round(c, 9), joint[k]) for k, c in rules.items()
            if not any(rules.get((tuple(t for t in k[0] if t != x), k[1]), 0) >= c for x in k[0])}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minimal_rules_with_classes_and_sure_tokens(spark, seed):
    rnd = random.Random(seed)
    data = []
    for _ in range(160):
        tokens = set(rnd.sample("abcdefg", rnd.randint(1, 5)))
        if "a" in tokens:
            tokens |= {"aa", "aaa"}                     # always together
        label = "block" if "g" in tokens else rnd.choice(["allow", "allow", "block"])     # one token is sure
        data.append((sorted(tokens), label))
    frame = spark.createDataFrame(data, "tokens array<string>, label string").repartition(3)
    got = {(tuple(sorted(r.tokens)), r.verdict): (round(r.confidence, 9), r.support)
           for r in url_rules.mine_rules(frame, 0.04, 0.7)[0].collect()}
    assert got == brute_rules(data, 7, 0.7)


def test_long_paths_shared_by_many_pages_do_not_explode(spark):
    """Forty segments on twelve pages of either label: one token for the miner; any of the segments meets a rule."""
    import time

    path = "/".join(f"seg{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(40))
    rows = [(i, f"http://a.{'com' if i % 2 else 'net'}/{'de' if i % 2 else 'q'}/{path}/{'u' * i}") for i in range(12)]
    rows += [(100 + i, f"http://b.com/{'fr' if i % 3 else 'de'}/{path}") for i in range(12)]
    rows += [(200, f"http://c.org.uk/{path}"), (201, "http://c.uk/x/sega"), (202, "http://d.uk/none"), (203, "http://long.uk/" + "y/" * 5000)]
    started = time.time()
    got = {r.page_id: r for r in url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.time() - started < 120 and len(got) == len(rows)
    assert got[202].verdict == got[203].verdict == "allow" and got[202].rule_tokens is None
    tokens = lambda u: url_rules.url_tokens(*map(lambda c: c, (u, url_rules.host_of(u), url_rules.path_of(u))))
    from pyspark.sql import functions as F
    parsed = spark.createDataFrame(rows, "page_id long, url string").select("page_id", tokens(F.col("url")).alias("t"), *[
        c.alias(n) for c, n in zip(url_rules.stated_rule(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))), ("rule", "label"))])
    data = [(r.t, r.label) for r in parsed.collect() if r.label is not None]
    want = {k[0] for k in brute_rules(data, url_rules.MIN_COUNT, url_rules.MIN_CONFIDENCE)}
    used = {tuple(sorted(r.rule_tokens)) for r in got.values() if r.rule_tokens}
    assert used <= {tuple(sorted(w)) for w in want}


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    read = spark.read.parquet(f"{SF}/documents.parquet")
    docs, sizes = read, [read.count()]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == read.columns
        docs = spark.createDataFrame(out.collect(), read.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    kept = {r.doc_id for r in docs.collect()}
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept
    # a stage's own tables go when the next stage begins
    left = [p for paths in cp._LEFT.values() for p in paths]
    assert left and all("pieces" in p for p in left)


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as cp

    read = spark.read.parquet(f"{SF}/documents.parquet")
    docs = read.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
