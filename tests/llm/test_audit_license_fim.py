"""Filter audit, license scan and fill-in-the-middle against brute force."""

import collections
import hashlib
import itertools
import random
import re

import pytest

from viewscope.llm import fill_middle, filter_audit, license_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EXTRA = (7, 8, "z", 9)      # clashing columns must not matter
COLUMNS = "doc_id long, text string, lang string, row int, _text int, part string, n int"


def odd_texts(rnd):
    words = "alpha beta Gamma DELTA one Two é漢 😀x #tag 5% mit MIT license License, apache general public".split()
    gaps = [" ", "  ", "\n", "\t ", " \x0b", "\x0c", "\x85", " "]
    texts = ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 160))) for _ in range(40)]
    return texts + ["", " ", " \n\t", "a", " a", "a ", "\x1c", "A" * 50, "<P>", "x<S", "<", "<M> y",
                    " ".join(f"w{i}" for i in range(30_000)), "z" * 200_000, "\x00 a\x00b"]


def odd_rows():
    """Nulls in every column, empty and very long texts, copies, repeated rows and ids, in three languages."""
    rnd = random.Random(5)
    texts = odd_texts(rnd)
    rows = [(i * 3, t, rnd.choice(["en", "de", "", None])) for i, t in enumerate(texts)]
    rows += [(rnd.randint(0, 400), rnd.choice(texts[:20]), "en") for _ in range(150)]
    rows += [(None, texts[0], "en"), (None, None, None), (7, None, "de"), (8, None, "de"), (8, None, "de"),
             ((1 << 63) - 1, texts[1], "de"), (-(1 << 63), texts[1], "en")]
    rows += [(5000 + i, texts[3], "en") for i in range(300)]      # more than half of the rows
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + EXTRA for r in odd_rows()], COLUMNS).repartition(5)


def fails(text):
    words = WORD.findall(text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute_audit(rows, labels):
    texts = [(r[0], r[1] or "", r[2] or "") for r in rows]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    masks = [(p, "".join(c for c, f in zip("ABCDE", [*fails(t), i is not None and i > least[t]]) if f), i)
             for i, t, p in texts]
    out, removed_by = {}, collections.Counter()
    for part in {p for p, _, _ in masks}:
        own = [(m, i) for p, m, i in masks if p == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [(m, i) for m, i in own if f in m and not before & set(m)]
                removed_by[part, f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    sum(not set(m) & {*before, f} for m, _ in own), len(gone),
                    sum(f in m and bool(before & set(m)) for m, _ in own), sum(m == f for m, _ in own),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 400, 3)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (3, None, None),
                                                                    (5001, 1, None)]


def test_audit_equals_brute_force(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit_filters(odd, labels).collect()}
    assert got == brute_audit(odd_rows(), LABELS)


@pytest.mark.parametrize("segments, bits", [(1, 6), (3, 8), (40, 10)])
def test_audit_masks_with_any_sketch(odd, segments, bits):
    """A full sketch clears nothing, several segments clear most: the masks are the same."""
    def masks(**size):
        return collections.Counter(map(tuple, filter_audit.mask_rows(odd, **size).collect()))

    want = masks()
    assert masks(segments=segments, bits=bits) == want
    assert sum(want.values()) == len(odd_rows())


def test_sketch_clears_only_unique_texts(spark):
    rows = spark.createDataFrame([(f"t{i % 900}",) for i in range(1000)], "text string").repartition(4)
    hashed = rows.select("text", *filter_audit._hashes(rows["text"]))
    sketch = filter_audit.counting_sketch(hashed, 2, 12)
    seen = {(r.text): r._possible for r in filter_audit._with_repeated(hashed, sketch, 2, 12).collect()}
    assert all(seen[f"t{i}"] for i in range(100))          # held twice
    assert sum(seen.values()) < 250                        # most others are cleared


def test_audit_of_nothing(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(odd.limit(0), labels).count() == 0
    # without labels nothing good or toxic is lost
    few = odd.filter("doc_id < 60")
    assert filter_audit.audit_filters(few, labels).agg({"good_lost": "sum", "toxic_lost": "max"}).first()[:] == (0, 0)


# ---------------------------------------------------------------- license scan

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def license_words(text):
    return LICENSE_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute_base(text):
    words = license_words(text)
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def brute_score(text):
    """Best cover of each template by the votes of nearby diagonals, from the whole match matrix."""
    words, labels, score = license_words(text), set(), 0.0
    pairs = list(zip(words, words[1:]))
    for t in license_scan.TEMPLATES:
        w = license_words(t.text)
        grams = list(zip(w, w[1:]))
        where = collections.defaultdict(set)
        for q, g in enumerate(grams):
            for p, h in enumerate(pairs):
                if g == h:
                    where[p - q].add(q)
        for d in where:
            near = {d} if t.base else set(range(d - license_scan.SLACK, d + license_scan.SLACK + 1))
            cover = len(set().union(*(where[x] for x in near if x in where)))
            if 100 * cover >= (100 if t.base else license_scan.MIN_COVER_PERCENT) * len(grams):
                labels.add(t.label)
                score = max(score, cover / len(grams))
    return ",".join(sorted(labels)), score


NOTICES = [
    "mit license", "The MIT\nLicense; mit license mit license", "MIT-License", "mitlicense", "mit licenses", "émit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and the associated "
    "documentation files", "permission is hereby granted to any person", "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY 4.0", "you can freely redistribute it and/or modify it under the terms of the GNU General Public License",
    "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the "
    "following conditions are met", "general public general public license", "of the of the of the of the terms of the",
    "This is free and unencumbered software released into the public domain " * 3,
]


def test_licenses_equal_brute_force(spark):
    rows = odd_rows()[:60] + [(9000 + i, t, "en") for i, t in enumerate(NOTICES)] + [(9000, NOTICES[0], "en"), (None, None, "en")]
    rows = [r for r in rows if len(r[1] or "") < 100_000] + [(1, "word " * 30_000 + "mit license", "de")]
    got = license_scan.scan_licenses(spark.createDataFrame([r + EXTRA for r in rows], COLUMNS).repartition(3)).collect()
    want = []
    for i, t, _ in rows:
        words, n, first, last, base = brute_base(t or "")
        # the long text repeats one word that no template holds, so its matches lie at its end
        labels, score = brute_score((t or "")[-200:] if len(t or "") > 100_000 else t or "")
        want.append((i, words, n, first, last, base, labels, score))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_copy_with_changes_is_found_and_scattered_words_are_not(spark):
    notice = license_words(license_scan.TEMPLATES[6].text)
    changed = notice[:6] + ["some", "more"] + notice[6:]
    scattered = [w for word in notice for w in [word, "x", "y"]]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(scattered)), (3, " ".join(reversed(notice)))],
                                 "doc_id long, text string")
    spans = license_scan.license_spans(license_scan.diagonal_votes(docs)).collect()
    assert {(s.doc_id, s.label) for s in spans} == {(1, "bsd")}
    best = max(spans, key=lambda s: s.cover)
    assert (best.first_word, best.last_word) == (0, len(changed) - 1)


def test_license_scan_options(spark):
    own = (license_scan.Template("x", "one two three", True), license_scan.Template("y", "four five six seven"))
    docs = spark.createDataFrame([(1, "zero one two three. four five six seven")], "doc_id long, text string")
    r = license_scan.scan_licenses(docs, own, k=3).first()
    assert (r.n_base, r.first_word, r.labels, r.score) == (1, 1, "x,y", 1.0)
    with pytest.raises(ValueError):
        license_scan.template_rows(own, 5)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- fill in the middle


def brute_middle(doc_id, text):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_brute_force(odd):
    want = collections.Counter((i, *brute_middle(i, t or "")) for i, t, _ in odd_rows())
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert collections.Counter(map(tuple, fill_middle.fill_in_middle(odd).collect())) == want
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_middle_is_restored(spark, odd):
    rows = fill_middle.fill_in_middle(odd, plain_percent=100, spm_percent=40)
    back = rows.select("doc_id", fill_middle.restored_text(rows["form"], rows["output"]))
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((i, t or "") for i, t, _ in odd_rows())
    r = fill_middle.fill_in_middle_digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert r.n == 0 and r.form == "plain" and r.output_sha256 == r.restored_sha256 == hashlib.sha256(b"").hexdigest()


def test_slices_cover_rows():
    import numpy as np

    sizes = np.array([0, 5 << 20, 5 << 20, 20 << 20, 1, 0])
    assert list(fill_middle._slices(sizes)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(fill_middle._slices(np.array([], int))) == []
