import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from samples import frame, prose

from pagewright.llm import near_copies, repeats
from pagewright.operators.graph import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_classes(rows, similar=0.8):
    up = {k: k for k, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)

    sets = []
    for k, t in rows:
        w = SPACE.findall(t or "")
        sets.append((k, t or "", {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    for i, (a, s, x) in enumerate(sets):
        for b, t, y in sets[:i]:
            if s == t or x and y and len(x & y) / len(x | y) >= similar:
                join(a, b)
    return {k: find(k) for k in up}


def test_classes_against_brute_force(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["class_id"] for r in near_copies.classes(docs).collect()} == brute_classes(rows)
    assert near_copies.classes(none).count() == 0


def test_classes_of_repeated_rows(repeated):
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_copies.classes(repeated).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "2"), ("2", "2"), ("4", "4"), ("5", "5"), ("None", "4")]


def test_large_group_in_parts(spark, monkeypatch):
    """Copies that each differ from one text alone, in more chunks than one."""
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    rng = random.Random(3)
    base = prose(rng, 150).split(" ")
    texts = [" ".join(base)] + [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(2, 130, 3)] + [prose(rng, 100) for _ in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_copies.classes(frame(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_pairs_of_a_split_component(spark, monkeypatch):
    """Separate pairs that common boilerplate links into one component of many parts."""
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    rng = random.Random(7)
    same, texts = prose(rng, 90), []
    for k in range(60):
        own = prose(rng, 55).split()
        texts += [" ".join([same, *own]), " ".join([same, *own[:30], f"y{k}", *own[31:]])]
    want = brute_classes(list(enumerate(texts)))
    assert len(set(want.values())) == 60
    got = {r["doc_id"]: r["class_id"] for r in near_copies.classes(frame(spark, texts)).collect()}
    assert got == want


def test_chain_of_many_parts(spark, monkeypatch):
    """Neighbours alike, all others not, in a component of many parts and bands of many chunks; the class is one."""
    monkeypatch.setattr(near_copies, "CHUNK", 16)
    words = [f"w{k}" for k in range(140 + 12 * 90)]
    texts = [" ".join(words[12 * k : 12 * k + 140]) for k in range(90)]
    random.Random(1).shuffle(texts)
    want = brute_classes(list(enumerate(texts)))
    assert set(want.values()) == {0}
    assert {r["doc_id"]: r["class_id"] for r in near_copies.classes(frame(spark, texts)).collect()} == want


def test_refuted_pairs_of_a_large_band(spark, monkeypatch):
    """Nodes of one band in several classes, alike to a degree below the threshold, ask until nothing is left."""
    monkeypatch.setattr(near_copies, "CHUNK", 4)
    monkeypatch.setattr(near_copies, "ASK", ((True, 1), (False, 2), (False, None)))
    rng = random.Random(11)
    same = prose(rng, 100).split()
    texts = []
    for k in range(30):
        own = prose(rng, 22).split()
        texts += [" ".join(same + own), " ".join(same + own[:-1] + [f"z{k}"])]
    want = brute_classes(list(enumerate(texts)))
    assert len(set(want.values())) > 20
    assert {r["doc_id"]: r["class_id"] for r in near_copies.classes(frame(spark, texts)).collect()} == want


def test_rows_without_key(spark):
    """A unique text without a key has no class id; a copy of a text with a key has its class."""
    rng = random.Random(12)
    a, b = prose(rng, 80), prose(rng, 80)
    got = [(r["doc_id"], r["class_id"]) for r in near_copies.classes(frame(spark, [a, a, b, b], [None, 5, None, None])).collect()]
    assert sorted(got, key=str) == [(5, 5), (None, 5), (None, None), (None, None)]


def test_copies_that_differ_in_a_repeated_line(spark):
    """Shingles that only one text of a pair has occur 200 times there, and count once."""
    rng, texts = random.Random(9), []
    for k in range(12):
        same = [f"s{k}x{i}" for i in rng.sample(range(1000), 124)]
        texts += [" ".join(same + [f"{side}{k}x{i}" for i in range(10)] * 200) for side in "ab"]
    want = brute_classes(list(enumerate(texts)))
    assert len(set(want.values())) == 12
    got = {r["doc_id"]: r["class_id"] for r in near_copies.classes(frame(spark, texts)).collect()}
    assert got == want


def test_followers_keep_their_links():
    """B agrees with the follower A by 0.7, and with A's leader by 0.3 only."""
    s = np.arange(3 * near_copies.PLACES, dtype=np.uint32).reshape(3, -1)
    s[1, :39] = s[0, :39]
    s[2, 20:64] = s[1, 20:64]
    links = near_copies.lead(np.arange(3), s)
    assert {frozenset(x) for x in links} == {frozenset((0, 1)), frozenset((1, 2))}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    n, places = 300, 4096
    element = rng.integers(1, 1 << 47, n).astype(np.uint64)
    x, y = rng.random(n) + 0.1, rng.random(n) + 0.1
    s = near_copies.signatures(np.repeat([0, 1], n), np.concatenate([element, element]), np.concatenate([x, y]), 2, places)
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(n))
    assert abs((s[0] == s[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / places)
    assert (near_copies.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 2) == 0).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(30)] + [(200, 200), (305, 301), (301, 303)] + [(rng.randrange(400, 440), rng.randrange(400, 440)) for _ in range(25)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for link in links for x in link}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: r for x, r in up.items() if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, width=200, kept=False):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = {}
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        out[k] = rest.decode("utf-8", "ignore") if kept else (len(b), int(gone.sum()), int((gone[:-1] & ~np.roll(gone, 1)[:-1]).sum()), hashlib.sha256(rest).hexdigest())
    return out


def test_repeats_against_brute_force(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.stripped(docs).collect()}
    want = brute_repeats(rows)
    assert got == want and sum(x[1] > 0 for x in want.values()) > 8
    assert repeats.stripped(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_repeats_of_few_letters(spark, seed):
    """Periods, overlaps and matches of just under and over the threshold."""
    rng = random.Random(seed)
    line = "".join(rng.choice("abé ") for _ in range(600))
    texts = ["ab" * 150, "abc" * 130, line, line[100:299], line[50:260] + "z" + line[300:520], "q" + line[:199], line[:198] + "é" * 250, "é" * 260, "\U0001f600" * 51, "\U0001f600" * 49, "ab" * 99]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(900))) for _ in range(12)]
    df = frame(spark, texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.stripped(df).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_long_text_in_parts(monkeypatch):
    """Parts that overlap by a window pick the grams that the whole picks."""
    data = np.random.default_rng(0).integers(0, 3, 60_000).astype(np.uint8)
    whole = dict(zip(*repeats.anchors(data, np.array([0, len(data)])), strict=True))
    step, parts = 7000, {}
    for s in range(0, len(data) - repeats.WIDTH + 1, step):
        e = min(len(data), s + step + repeats.WIDTH - 1)
        place, h = repeats.anchors(data[s:e], np.array([0, e - s]))
        parts |= dict(zip(place + s, h, strict=True))
    assert parts == whole


def removed(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.stripped(df).collect()}


def test_repeated_rows_and_columns(repeated):
    out = repeats.passed(repeated)
    assert out.columns == repeated.columns
    got = sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in repeats.stripped(repeated).collect())
    assert got == [("1", True), ("1", True), ("2", False), ("2", False), ("4", True), ("5", False), ("None", True)]


def test_columns_with_names_of_results(spark):
    df = frame(spark, ["a" * 150, "b" * 300, None]).withColumnsRenamed({"score": "kept_text", "kept": "n_removed", "n": "k", "text_2": "rid"})
    out = repeats.passed(df)
    assert out.columns == df.columns and {r["doc_id"]: (r["text"], r["n_chars"], r["kept_text"]) for r in out.collect()} == {0: ("a" * 150, 150, "s"), 1: ("", 0, "s"), 2: ("", 0, "s")}


@pytest.mark.parametrize("flush", [1 << 20, 7])
def test_groups_dealt_to_full_depth(spark, monkeypatch, flush):
    """One passage in every text, with a group bound of three contexts and flushes of all and of few rows."""
    monkeypatch.setattr(repeats, "FLUSH", flush)
    monkeypatch.setattr(repeats, "ROWS", min(flush, repeats.ROWS))
    rng = random.Random(4)
    passage = prose(rng, 60)
    values = [prose(rng, rng.randrange(1, 40)) + passage[rng.randrange(3) * 20 :] + prose(rng, rng.randrange(1, 40)) for _ in range(24)] + [passage, passage[:250], passage[100:320] + "x"]
    df = frame(spark, values).repartition(3)
    rows = df.select("doc_id", "text")
    own = repeats.repeated
    monkeypatch.setattr(repeats, "repeated", lambda found: own(found, 3))
    assert removed(rows) == brute_repeats(list(enumerate(values)))


@pytest.mark.parametrize("seed", range(3))
def test_reached_against_brute_force(seed):
    """Contexts of few letters, cut at row ends, in groups of many."""
    rng = np.random.default_rng(seed)
    n = 60
    around = np.tile(rng.integers(97, 99, repeats.SPAN).astype(np.uint8), (n, 1))
    for row in around:
        row[rng.integers(0, repeats.SIDE, rng.integers(0, 3))] = 120
        row[rng.integers(repeats.SIDE + repeats.GRAM, repeats.SPAN, rng.integers(0, 3))] = 121
    before, after = rng.choice([100, 100, 60, 45], n), rng.choice([100, 100, 70, 55], n)
    group = rng.integers(0, 2, n)
    most, rest = repeats.reached(group, before, after, around)
    for i in range(n):
        found = [d for d in range(101) if before[i] >= d and after[i] >= 100 - d and any(j != i and group[j] == group[i] and before[j] >= d and after[j] >= 100 - d and (around[i, 100 - d : 300 - d] == around[j, 100 - d : 300 - d]).all() for j in range(n))]
        assert (most[i], rest[i]) == ((max(found), 100 - min(found)) if found else (-1, -1)), i


def test_digits_with_one_hash(monkeypatch):
    monkeypatch.setattr(repeats, "digest", lambda digits, seed=0: np.zeros(len(digits), np.uint64))
    digits = np.array([[1, 2], [3, 4], [1, 2], [3, 5]], np.uint8)
    got = repeats.refined(np.array([0, 0, 0, 0]), digits)
    assert got[0] == got[2] and len(set(got.tolist())) == 3


def test_many_repeated_rows(spark):
    """A thousand rows of one text, and one passage in every text."""
    rng = random.Random(8)
    passage = prose(rng, 80)
    values = [passage] * 1000 + [f"{k} {passage} {k * k}" for k in range(300)]
    df = frame(spark, values, [7] * 1000 + list(range(10, 310)))
    got = removed(df)
    assert got == brute_repeats([(7, passage)] * 1000 + [(10 + k, x) for k, x in enumerate(values[1000:])])
    assert repeats.stripped(df).count() == 1300
