import random
import zlib

import numpy as np
import pytest
import tokenizers
from samples import frame, prose, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import bpe, classifier, html_text, language, packing
from pagewright.llm.queries import RANKS, VOCABULARY

REFERENCE = tokenizers.Tokenizer.from_file(VOCABULARY)


def wanted(text):
    return np.array(REFERENCE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n\t 　'sé1²<|endoftext|>", max_size=60))
def test_ids_are_the_library_s(text):
    for t in (bpe.tokenizer(VOCABULARY), bpe.tokenizer(VOCABULARY, RANKS)):
        ids = t.encode(text)
        assert ids == wanted(text)
        assert t.decode(ids) == REFERENCE.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_long_words_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    t = bpe.Tokenizer(VOCABULARY)
    rng = random.Random(1)
    for text in ["".join(rng.choice("abcdefgh") for _ in range(3000)), *filter(None, texts())]:
        assert t.encode(text) == wanted(text)


def test_round_trip_query(docs, none):
    import hashlib

    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.round_trip(docs, VOCABULARY).collect():
        t = text[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(wanted(t)) // 4, hashlib.sha256(wanted(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.round_trip(none, VOCABULARY).count() == 0


def test_packing(docs, none, repeated):
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = packing.pack_documents(docs, VOCABULARY, RANKS).collect()
    bins, parts = {}, {}
    for r in rows:
        ids = wanted(text[r["doc_id"]]) + b"\2\0\0\0"
        assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], len(ids) // 4))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert parts.keys() == text.keys()
    for x in parts.values():
        x.sort()
        assert [p[0] for p in x] == list(range(len(x))) and [p[1] for p in x] == [sum(q[2] for q in x[:k]) for k in range(len(x))]
        assert sum(p[2] for p in x) == x[0][3] and (len(x) == 1 or all(p[2] == 1024 for p in x[1:]) and x[0][3] > 1024)
    assert packing.pack_documents(none, VOCABULARY, RANKS).count() == 0
    assert packing.pack_documents(repeated, VOCABULARY, RANKS).count() >= 7


def test_equal_rows_are_dealt_to_all_shards(spark):
    rows = spark.createDataFrame([(None, 0, 700)] * 400, "doc_id long, piece int, length long").repartition(4)
    got = packing.pack(packing.materialise(rows), shard=50).collect()
    shards = [r["sequence_id"] >> 40 for r in got]
    assert len(set(shards)) == 8 and max(map(shards.count, set(shards))) < 120 and len({r["sequence_id"] for r in got}) == 400


@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_packer_is_best_fit_over_few_bins(lengths, most):
    p, open_bins = packing.Packer(64, most), {}
    for n in lengths:
        fits = [f for f in open_bins.values() if f >= n]
        where, offset = p.place(n)
        if fits:
            assert open_bins[where] == min(fits) and offset == 64 - min(fits)
            open_bins[where] -= n
        else:
            assert offset == 0 and where not in open_bins
            if n < 64 and len(open_bins) == most:
                closed = min(open_bins.values())
                gone = [b for b, f in open_bins.items() if f == closed]
                still = {x for s in p.at for x in s}
                open_bins = {b: f for b, f in open_bins.items() if b in still}
                assert len(gone) >= 1
            open_bins[where] = 64 - n
        open_bins = {b: f for b, f in open_bins.items() if f}
        assert p.open == len(open_bins) <= most


LANGS = {"wo": "en", "zü": "de", "ña": "es"}


def test_language(spark, none):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([3, 30, 200]), k := rng.choice(list(LANGS))), LANGS[k], "s") for i in range(240)]
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 !? \U0001f600", "en", "s"), (1003, prose(rng, 20, "zü").upper(), None, "s"), (1003, prose(rng, 20, "zü"), None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    own = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == own[r["doc_id"]] for r in held) >= 0.95 * len(held) > 20
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1000, 1001, 1002))
    assert all(r["lang_pred"] == "de" for r in got if r["doc_id"] == 1003)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(none).count() == 0
    kept = language.passed(df, language.train(df))
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    untaught = language.identify(df.withColumn("lang", df.lang.substr(1, 0)).where("lang is null"))
    assert {r["lang_pred"] for r in untaught.collect()} <= {"und"}


def test_language_counts_by_hand():
    """A score is the sum of the table's rows for the text's n-grams."""
    import pyarrow as pa

    table = np.random.default_rng(0).random((language.BUCKETS + 1, 3)).astype(np.float32)
    table[language.BUCKETS] = 0
    column = pa.array(["Abc, dé!", None, "9", "xyz" * 50])
    best, *_ = language.decide(column, (["a", "b", "c"], table))
    for k, t in enumerate(["Abc, dé!", "", "9", "xyz" * 50]):
        code = np.array([32] * 2 + [ord(c) if c.isalpha() else 32 for c in t.lower()] + [32] * 4, np.uint32)
        total = sum(table[language.buckets(code, n)][: len(t) + 2].sum(axis=0, dtype=float) for n in language.ORDERS)
        assert best[k] == (total.argmax() if any(c.isalpha() for c in t) else -1)


def test_language_of_a_long_text(monkeypatch):
    """A text alone in its slice, read in parts, scores as it does among others."""
    import pyarrow as pa

    table = np.random.default_rng(0).random((language.BUCKETS + 1, 3)).astype(np.float32)
    table[language.BUCKETS] = 0
    text = prose(random.Random(2), 400, "zü")
    model = ["a", "b", "c"], -table / 50
    among = language.decide(pa.array([text, "x"]), model)
    monkeypatch.setattr(language, "PART", 64)
    alone = language.decide(pa.array([text]), model)
    assert alone[0][0] == among[0][0] and alone[1][0] == pytest.approx(among[1][0], rel=1e-4)


def test_language_counts_against_a_plain_count(spark):
    """The table by a plain loop over n-grams, from the buckets of each."""
    import collections

    rng = random.Random(3)
    rows = [(i, prose(rng, 20, k), LANGS[k]) for i, k in enumerate(list(LANGS) * 4)]
    names, table = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {x: collections.Counter() for x in names}
    for _, t, lang in rows:
        code = np.array([32] * 2 + [ord(c) if c.isalpha() else 32 for c in t.lower()] + [32] * 2, np.uint32)
        for n in language.ORDERS:
            for k in range(len(code) - n + 1):
                if any(code[k : k + n] != 32):
                    want[lang][int(language.buckets(code[k : k + n], n)[0])] += 1
    for j, x in enumerate(names):
        n = np.full(language.BUCKETS, language.SMOOTH)
        n[list(want[x])] += list(want[x].values())
        assert np.allclose(table[:-1, j], np.log(n / n.sum()), atol=1e-5)


def test_texts_in_no_known_language_go(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 400, k), LANGS[k]) for i, k in enumerate(list(LANGS) * 60)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    noise = "".join(rng.choice("bcdfghjkpqvwxyz ") for _ in range(2000))
    code = "for i in range(10): x[i] = foo(bar, baz) ** 2; if not x: return None " * 9
    others = [prose(rng, 80, "zü"), prose(rng, 60, "wo"), noise, code, "Съешь же ещё этих мягких булок " * 9, "12 34"]
    kept = language.passed(frame(spark, others), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


def test_classifier(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        t = prose(rng, rng.choice([20, 120]))
        rows.append((i, t if good else rng.choice([" ".join(w.upper() + "!!" for w in t.split()), " ".join(w + " " + w for w in t.split())]), "x"))
        labels.append((i, int(good)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1001, "", "x")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    got = classifier.classify(df, lab).collect()
    own = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in own]
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == own[r["doc_id"]] for r in held) >= 0.95 * len(held) > 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert classifier.classify(none, lab).count() == 0
    assert {r["score"] for r in classifier.classify(df, lab.limit(0)).collect()} == {0.5}


def test_classifier_learns_from_a_bounded_sample(spark):
    df = frame(spark, ["a b"] * 40)
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert classifier.sample(df, lab, most=7).count() == 7
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in classifier.sample(df, lab).collect())


def test_classifier_s_sample_is_bounded_in_bytes(spark, monkeypatch):
    df = frame(spark, [f"a{k} b{k}" for k in range(40)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    told = []
    monkeypatch.setattr(classifier, "train", lambda rows: told.append(len(rows)) or np.zeros(classifier.BUCKETS + 1))
    classifier.fit(df, lab)
    monkeypatch.setattr(classifier, "FEATURES", 200)
    classifier.fit(df, lab)
    assert told[0] > 20 and 0 < told[1] < 10


def by_hand(text, bits):
    """Features of a text as the docstring has them, by plain loops; None for what has no word."""
    import re

    from pagewright.llm.hashing import U, mix, words

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    data = np.frombuffer(text.encode(), np.uint8)
    h = words(data, np.array([0, len(data)]))[2] if len(data) else []
    shapes = []
    for k, x in enumerate(w):
        n_up, n_low = sum("A" <= c <= "Z" for c in x), sum("a" <= c <= "z" for c in x)
        n_sym, n_dig = sum(c in "#*$%&|<>!?@=_~^{}[]\\/+" for c in x), sum("0" <= c <= "9" for c in x)
        same = (1 if k > 0 and w[k - 1] == x else 0) | (2 if k > 1 and w[k - 2] == x else 0)
        shapes.append((n_up > 1 and n_low == 0) + 2 * min(n_sym, 3) + 8 * (n_dig > 0) + 16 * (len(x.encode()) > 30) + 32 * same)
    shape = mix(np.array(shapes, U) + U(1 << 40)) if shapes else np.zeros(0, U)
    pair = lambda v: mix(np.array([int(a) * 0xD6E8FEB86659FD93 + int(b) & (1 << 64) - 1 for a, b in zip(v, v[1:], strict=False)], U)) if len(v) > 1 else np.zeros(0, U)
    counts = {}
    for x in np.concatenate([np.asarray(h, U), pair(h), shape, pair(shape)]):
        counts[int(x) >> (64 - bits)] = counts.get(int(x) >> (64 - bits), 0) + 1
    return counts


def test_classifier_features_and_scores_by_hand(spark):
    rng = random.Random(1)
    values = [t for t in texts() if t and len(t) < 3000]
    w = np.random.default_rng(0).normal(size=classifier.BUCKETS + 1)
    got = {r["doc_id"]: r["score"] for r in classifier.score(frame(spark, values), w).collect()}
    for i, t in enumerate(values):
        f = by_hand(t, 18)
        norm = sum(f.values()) ** 0.5
        total = w[-1] + (sum(w[b] * n**0.5 for b, n in f.items()) / norm if f else 0)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    rng.shuffle(values)


def test_leader_s_weights_by_hand():
    """One feature and the bias, two examples: the closed form step by step."""
    z, n = [0.0, 0.0], [0.0, 0.0]
    a, b, l1, l2 = classifier.ALPHA, classifier.BETA, classifier.L1, classifier.L2
    weight = lambda z, n: 0.0 if abs(z) <= l1 else -(z - (l1 if z > 0 else -l1)) / ((b + n**0.5) / a + l2)
    for _ in range(classifier.PASSES):
        for value, label in ((1.0, 1), (0.5, 0)):
            x = [value, 1.0]
            w = [weight(*s) for s in zip(z, n, strict=True)]
            p = 1 / (1 + np.exp(-sum(i * j for i, j in zip(w, x, strict=True))))
            for k in (0, 1):
                g = (p - label) * x[k]
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / a * w[k]
                n[k] += g * g
    got = classifier.train([(np.array([7]), np.array([1.0]), 1), (np.array([7]), np.array([0.5]), 0)])
    assert got[7] == pytest.approx(weight(z[0], n[0])) and got[-1] == pytest.approx(weight(z[1], n[1]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this page, so please agree to that.</div>%s
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/c">Something else</a></li></ul></aside>
<form><label>Your mail</label><input name="q"><button>Send</button></form>
<section id="comments"><article><p>First! What a long and thoughtful comment on the article this one is.</p></article></section>
<footer><p>&copy; 2020 Site &middot; all of the words that footers have</p></footer></body></html>"""
BODY = "<h1>The &amp; title</h1>\n<p>One <b>bold</b>\n  word &lt;here&gt;.<br>Next line</p><!-- x --><p>Short.<p>With a <a href='x>y'>link</a> inside of it.\n\n<p></p>"
TEXT = "The & title\n\nOne bold word <here>. Next line\n\nShort.\n\nWith a link inside of it."


def test_pages(spark):
    pages = [PAGE % f"<article>{BODY}</article>", PAGE % f"<main><div>{BODY}</div></main>", None, "", "<p>", "<script>x", "no tags at all, but a sentence of some twenty words or so, which is what main text in general is like, too"]
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[0]["text"] == got[1]["text"] == TEXT and got[0]["url"] == "u0"
    assert [got[i]["text"] for i in (2, 3, 4, 5)] == [""] * 4 and got[6]["text"] == pages[6]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0


@given(st.text("<>/!-apdiv \"'=&;clsnumbrthe", max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_markup_is_read(page):
    assert "<article" not in html_text.main_text(page, html_text.grow(html_text.LABELLED))


def plain_page(rng):
    """A page of plain blocks, without article, regions or names: the text, and lists of links and short notes about it."""
    link = lambda: f'<div><a href="/x">{prose(rng, rng.randrange(1, 4))}</a></div>'
    body = [" ".join(prose(rng, rng.randrange(30, 90)).split()) for _ in range(rng.randrange(2, 6))]
    head, foot = [link() for _ in range(rng.randrange(3, 8))], [link() for _ in range(rng.randrange(3, 8))]
    return "<body>" + "\n".join([*head, *(f"<div>{x}</div>" for x in body), *foot]) + "</body>", "\n\n".join(body)


def test_words_and_links_of_neighbours_decide_on_plain_pages():
    """Without its columns of words and link densities the tree does worse."""
    rng = random.Random(5)
    pages = [plain_page(rng) for _ in range(60)]

    def right(tree):
        return sum(html_text.main_text(page, tree) == text for page, text in pages)

    blind = html_text.grow([(*r[:3], 0, 0.0, 0, 0.0, 0, 0.0, r[-1]) for r in html_text.LABELLED])
    assert right(html_text.grow(html_text.LABELLED)) >= 55 and right(blind) == 0


@pytest.mark.parametrize("piece", ["<div>x", "<aside><article>x", "<div>x</ul>", '<a b="', "<p c='x\"", "</", "<!", "<section class=menu><p>x"])
def test_broken_markup_takes_time_in_proportion(piece):
    import time

    html_text.blocks(piece * 1000)
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_text.blocks(piece * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.1), took


def test_tree_fits_its_table():
    tree = html_text.grow(html_text.LABELLED)
    assert all(html_text.decide(tree, r) == r[-1] for r in html_text.LABELLED)


def test_pipeline_keeps_columns(spark, tmp_path, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*own).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (4, 1), (7, 1), (10, 1), (13, 1), (46, 1), (55, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        rows = spark.read.parquet(str(tmp_path / f"stage{k}"))
        sizes.append(rows.count())
        assert k == 4 or rows.columns == own, sizes
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] > 4, sizes
    assert rows.select("doc_id").distinct().count() == sizes[3]
    ids = {r["doc_id"] for r in rows.collect()}
    assert {1, 4, 7, 13} <= ids and not ids & {22, 25, 28}
    assert pipeline.run(spark, str(tmp_path)).count() == rows.count()


def test_pipeline_against_plain_python(spark, tmp_path, docs):
    """All rows of run(): the first two stages' keys from their operators, the other three in plain Python."""
    from test_copies import brute_classes, brute_repeats

    from pagewright.llm import quality_rules

    pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (4, 1), (7, 1), (10, 1), (13, 1), (46, 1), (55, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = quality_rules.passed(rows, spark.read.parquet(str(tmp_path / "labels.parquet")))
    known = language.passed(good, language.train(good.where(~language.held_out())))
    text = {r["doc_id"]: r["text"] for r in known.collect()}
    classes = brute_classes(sorted(text.items()))
    text = {k: text[k] for k in text if classes[k] == k}
    gone = brute_repeats(list(text.items()), kept=True)
    want = set()
    for k, t in gone.items():
        ids = wanted(t) + b"\2\0\0\0"
        n, at, piece = len(ids) // 4, 0, 0
        while at < n:
            size = n - at if n <= 1024 else (n % 1024 or 1024) if at == 0 else 1024
            want.add((k, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
            at, piece = at + size, piece + 1
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) > 5 and set(got) == want
    assert any(t != text[k] for k, t in gone.items())
