import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from pagewright.llm import fingerprints, license_scan, quality_rules

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    text = text or ""
    w = SPACE.findall(text)
    triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if triples[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 1), (7, 1), (10, 1), (13, 1), (67, 0), (70, 0), (70, 0), (None, 1), (4, None)], "doc_id long, quality int")


def test_base_rules(docs, labels):
    got = quality_rules.apply(docs, labels).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(text)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_score_against_counts(docs, labels):
    """The score by hand, from Spark's hash of each n-gram."""
    rows = quality_rules.prepared(docs, "text").select("doc_id", "__grams").collect()
    trusted = {1, 4, 7, 10, 13}
    own, every = collections.Counter(), collections.Counter()
    for r in rows:
        every.update(r["__grams"])
        if r["doc_id"] in trusted:
            own.update(r["__grams"])
    share = sum(own.values()) / sum(every.values())
    ratio = {b: math.log((own[b] + 1) / (n * share + 1)) for b, n in every.items()}
    want = {r["doc_id"]: sum(ratio[b] for b in r["__grams"]) / len(r["__grams"]) if r["__grams"] else 0.0 for r in rows}
    for r in quality_rules.apply(docs, labels).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-5)


def test_rules_keep_clean_rows_and_their_columns(docs, labels):
    kept = quality_rules.passed(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 4, 7, 10, 13} <= ids and not ids & {3 * i + 1 for i in (18, 19, 20, 21)}


def test_rules_without_labels_or_rows(docs, none, labels):
    assert quality_rules.apply(none, labels).count() == 0
    got = quality_rules.apply(docs, labels.limit(0)).collect()
    assert all(r["score"] == 0 and r["kept"] != r["base_failed"] for r in got)


def test_scan_against_brute_force(docs, none):
    low = str.maketrans(license_scan.CAPITALS, license_scan.SMALL)
    templates = [(label, set(WORD.findall(t.translate(low)))) for label, t in license_scan.TEMPLATES]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = 0
    for r in license_scan.scan(docs).collect():
        t = (text[r["doc_id"]] or "").translate(low)
        w, at, labels, more, share = WORD.findall(t), [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES.items():
            q = phrase.split()
            hits = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
            at += hits
            labels |= {label} if hits else set()
        for k in range(0, max(1, len(w) - license_scan.BLOCK + license_scan.STEP), license_scan.STEP):
            for label, own in templates:
                part = len(set(w[k : k + license_scan.BLOCK]) & own) / len(own)
                if part >= license_scan.CONTAINED - 1e-12:
                    more.add(label)
                    share = max(share, part)
        want = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if at else pytest.approx(share))
        assert tuple(r)[1:] == want
        found += bool(labels | more)
    assert found >= 4
    assert license_scan.scan(none).count() == 0


def test_scan_finds_every_block_at_the_threshold(spark):
    """Template words are left out one by one, and other words put between."""
    rows = []
    for _, t in license_scan.TEMPLATES:
        w = WORD.findall(t.lower())
        rows += [" filler\n".join(w[:k] + w[k + 1 :]) for k in range(len(w))] + [" ".join(w[: len(w) // 2])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    templates = [(label, set(WORD.findall(t.lower()))) for label, t in license_scan.TEMPLATES]
    for r in license_scan.scan(df).collect():
        own = set(WORD.findall(rows[r["doc_id"]]))
        want = {label for label, t in templates if len(own & t) / len(t) >= license_scan.CONTAINED - 1e-12}
        assert want <= set(r["labels"].split(",")) | {""} and set(r["labels"].split(",")) - {""} <= want | set(license_scan.PHRASES.values())


def test_scan_of_wrapped_notices_null_keys_and_repeated_rows(spark):
    notice = "word " * 50 + license_scan.TEMPLATES[2][1].replace("any person", "any\nperson").replace("software and", "software\nand") + " word" * 80
    rows = [(None, "Released under the MIT License"), (None, None), (1, notice), (1, notice), (2, "x")]
    got = sorted(((r["doc_id"], r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, "mit", 1.0), (1, "mit", 1.0), (2, "", 0.0), (None, "", 0.0), (None, "mit", 1.0)]


def test_rules_of_null_keys_and_repeated_rows(repeated, labels):
    got = [r["n_words"] for r in quality_rules.apply(repeated, labels).collect()]
    assert sorted(got) == sorted(base(r["text"])[0] for r in repeated.collect())


def shingles(text):
    w = SPACE.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, none, repeated):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, (key, text) in enumerate(rows):
        after, r, half = rows[(i + 1) % len(rows)][1], got[key], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, next_one = shingles(text), shingles(edited), shingles(after)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == 12 * min(len(own), fingerprints.K)
        for estimate, a, b in ((r["near_edited"], own, other), (r["near_next"], own, next_one)):
            assert abs(estimate - jaccard(a, b)) <= (1e-9 if len(a | b) < fingerprints.K else 0.2)
        assert abs(r["distinct_shingles"] / max(1, len(own)) - (len(own) > 0)) < 0.35
    assert got[1]["fingerprint"] == got[22]["fingerprint"] != got[4]["fingerprint"]
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(repeated).count() == 7


def test_sketch_is_the_least_hashes(spark):
    """Bottom-k by hand, from Spark's hash of every distinct shingle."""
    text = " ".join(f"w{i % 700}" for i in range(900))
    h = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(text.split())], "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]
    two = lambda pairs: [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long").orderBy("i").select(F.xxhash64("a", "b")).collect()]
    a = two(zip(h, h[1:], strict=False))
    b = two(zip(a, a[2:], strict=False))
    whole = two(zip(b, h[4:], strict=False))
    want = sorted({(x & (1 << 64) - 1) >> 16 for x in whole})[: fingerprints.K]
    assert fingerprints.with_sketch(spark.createDataFrame([(text,)], "text string"), "text", "sketch").first()["sketch"] == want


def test_keys_far_apart(spark):
    """Negative keys, and keys so far apart that each is a block of its own."""
    keys = [-(1 << 61), -5, 0, 3, 1 << 20, 1 << 40, (1 << 61) + 7]
    rows = [(k, f"text of {k} " * (3 + i)) for i, k in enumerate(keys)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()}
    for i, (k, t) in enumerate(rows):
        half = len(t) // 2
        assert got[k] == hashlib.sha256((t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]).encode()).hexdigest()


def test_sketches_merge(spark):
    a, b = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(450, 1400))
    df = fingerprints.with_sketch(spark.createDataFrame([(1, a), (1, b), (2, a), (3, None)], "k int, text string"), "text", "sketch")
    merged = {r["k"]: r["sketch"] for r in fingerprints.merge(df, ["k"]).collect()}
    parts = df.where("k = 1").collect()
    assert merged[1] == sorted(set(parts[0]["sketch"]) | set(parts[1]["sketch"]))[: fingerprints.K]
    assert merged[2] == df.where("k = 2").first()["sketch"] and merged[3] == []
    two = df.where("k = 2").select(F.col("sketch").alias("x")).join(df.where("k = 1").select(F.col("sketch").alias("y")).orderBy("y").limit(2))
    for r in two.select(fingerprints.containment("x", "y").alias("c")).collect():
        assert 0 <= r["c"] <= 1
