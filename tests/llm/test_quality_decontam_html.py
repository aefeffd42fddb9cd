"""Importance weights, proximity matches and main texts against definitions."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helio.llm import decontam, html_extract, quality

SF = "/root/testdata/sf0.01"


# ---- quality ---------------------------------------------------------------------------

def plain_grams(text):
    """Buckets of a text's n-grams, token by token: words and runs of 1 to 3 shapes."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+",
                        text.encode())
    content, shape, before = [], [], None
    for t in tokens:
        (c,), (s,), _ = quality.tokens(pa.array([t.decode()], pa.string()))
        same = int(t == before)
        if re.match(rb"[0-9A-Za-z\x80-\xff]", t):
            upper, digit = len(re.findall(rb"[A-Z]", t)), bool(re.search(rb"[0-9]", t))
            size = sum(len(t) > x for x in (1, 2, 4, 8, 16, 32))
            code = 1 + min(upper, 2) + 3 * size + 24 * digit + 48 * same
            s = quality.mix64(np.array([code], dtype=np.uint64))[0]
        else:
            s = np.uint64(int(c) ^ same)
        content.append(int(c))
        shape.append(int(s))
        before = t
    out = [c % quality.BUCKETS for c in content]
    for n in (1, 2, 3):
        for i in range(len(shape) - n + 1):
            acc = 0
            for m in range(1, n + 1):
                x = (acc * 31 + shape[i + m - 1] + m) % 2 ** 64
                acc = int(quality.mix64(np.array([x], dtype=np.uint64))[0])
            out.append(acc % quality.BUCKETS)
    return out


def plain_weights(texts, target):
    """Log weights by definition: two bags of n-grams, smoothed, and a sum per text."""
    raw, good, grams = Counter(), Counter(), [plain_grams(t) for t in texts]
    for i, g in enumerate(grams):
        raw.update(g)
        if i in target:
            good.update(g)
    b, n, m = quality.BUCKETS, sum(raw.values()), sum(good.values())

    def ratio(k):
        p_raw = (raw[k] + 1) / (n + b)
        return math.log((good[k] + b * p_raw) / (m + b)) - math.log(p_raw)
    return [sum(map(ratio, g)) for g in grams] if m else [0.0] * len(texts)


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    rng = random.Random(1)
    out = [(d.text or "")[:3000].strip("�") for d in docs]
    return out + ["", "One", "é é é É!! ?? 12 12a", " ".join(rng.choices(["Aa", "b", "c1", "--"], k=500))]


def test_weights_by_brute_force(spark, texts):
    """Counts, models and weights of every text, all n-grams and not only the first 100."""
    target = {i for i in range(len(texts)) if i % 3 == 0}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    got = {r.doc_id: r.log_weight for r in quality.resampled(df, ids, k=10).collect()}
    want = plain_weights(texts, target)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert max(abs(w) for w in want) > 100


def test_top_k_and_expected_size(spark, texts):
    target = {i for i in range(len(texts)) if i % 3 == 0}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    rows = quality.resampled(df, ids).collect()
    expected = round(sum(math.exp(min(r.log_weight + quality.DOUBT, 0)) for r in rows))
    assert sum(r.kept for r in rows) == expected
    for k in (0, 1, 7, len(texts), 10 ** 6):
        kept = [r for r in quality.resampled(df, ids, k=k).collect() if r.kept]
        best = sorted((r.gumbel_key for r in rows), reverse=True)[:k]
        assert sorted((r.gumbel_key for r in kept), reverse=True) == pytest.approx(best)
    assert {r.log_weight for r in quality.resampled(df, ids.limit(0)).collect()} == {0.0}


def test_held_out_labels(spark):
    """Trained on four fifths of the good labels, the sample leaves out the bad texts and
    keeps the good ones of the last fifth."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    ids = spark.createDataFrame([(i,) for i, q in labels.items() if q == 1 and i not in held],
                                "doc_id long")
    kept = {r.doc_id: r.kept for r in quality.resampled(docs, ids).collect()}
    good = [kept[i] for i in held if labels[i] == 1]
    bad = [kept[i] for i, q in labels.items() if q == 0]
    assert len(good) > 40 and len(bad) > 20
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.03


# ---- proximity -------------------------------------------------------------------------

def words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").lower())


def brute_proximity(docs, items, size, slop):
    out = {}
    for i, text in docs:
        w, hit, named = words(text), set(), set()
        for item, body in items:
            v = words(body)
            width = min(size, len(v))
            for p in range(len(v) - width + 1) if v else ():
                window = v[p:p + width]
                for s in range(len(w) - width + 1):
                    if all(any(0 <= s + o + d < len(w) and w[s + o + d] == t
                               for d in range(-slop, slop + 1)) for o, t in enumerate(window)):
                        hit.update(range(s, s + width))
                        named.add(item)
        out[i] = (len(w), len(hit), sorted(named))
    return out


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_by_brute_force(spark, slop):
    rng = random.Random(slop)
    docs = [(0, "a x b y c"), (1, None), (2, ""), (3, "c b a"), (4, "b a"), (5, "q"),
            (6, "a b c " * 50)]
    docs += [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for i in range(7, 60)]
    items = [(0, "a b c"), (1, "d e"), (2, "h"), (3, ""), (4, None), (5, "a a b a c d e"),
             (6, "zzz a")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_proximity(docs, items, 3, slop)
    for block in (200_000, 2):  # one block, and several one after the other
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontam.contamination(
            d, b, size=3, slop=slop, block_windows=block).collect()}
        assert got == want
    if slop == 1:
        assert 0 in want[0][2]  # every term of "a b c" is one place off


def test_nothing_to_compare(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contamination(d.limit(0), b).collect() == []
    got = decontam.contamination(d, b.limit(0)).collect()
    assert {(r.doc_id, r.n_words, r.n_hit) for r in got} == {(1, 3, 0), (2, 0, 0)}


# ---- main text -------------------------------------------------------------------------

ARTICLE = "<p>" + "The article goes on, as articles do, for a line or two. " * 4 + "</p>"


@pytest.mark.parametrize("piece,text", [
    ("<p title='a hidden gem'>One, two, and three.</p>", "One, two, and three."),
    ("<p data-x='see the hidden = value'>Four, five, six.</p>", "Four, five, six."),
    ("<p>An <span aria-hidden='true'>odd</span> thing, is it not.</p>", "An odd thing, is it not."),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, we say.</p>", "So x=1, we say."),
    ("<p>Press <label for=a>this</label>, and wait.</p>", "Press this, and wait."),
    ("<p class='alert'>An alert was given, at nine. They ran, as they could, and hid.</p>",
     "An alert was given, at nine. They ran, as they could, and hid."),
    ("<p>He owns a <span class='share'>20 % share</span> of it, and more.</p>",
     "He owns a 20 % share of it, and more."),
    ("<p class=notice>Cookies</p>", ""), ("<p><span class='share'>Share</span></p>", ""),
    ("<p hidden>Gone, and not seen.</p>", ""), ("<p HIDDEN=''>Gone, not seen.</p>", ""),
    ("<p style='color:red; Display : none'>Gone, and not seen.</p>", ""),
    ("<div class='comments'><p>I think, as a reader, that it is so. Is it, or not?</p></div>", ""),
])
def test_attributes_and_inline_elements(piece, text):
    page = f"<html><body><div>{ARTICLE}{piece}{ARTICLE}</div></body></html>"
    once = " ".join(re.sub("<[^>]*>", " ", ARTICLE).split())
    assert html_extract.main_text(page) == " ".join(x for x in (once, text, once) if x)


@pytest.mark.parametrize("page,chars", [
    ("<div>" * 20_000 + "Text, deep down." + "</div>" * 20_000, 16),
    ("<div>a, b." * 20_000, 6 * 20_000 - 1),
    ("<b>a, b." * 20_000 + "<p>x" * 20_000 + "</i>" * 20_000, None),
    ("<div id=share-x>a, b." * 20_000, 6 * 20_000 - 1),
    ("<b><i>a</b>" * 20_000, 20_000), ("<ul><li>a, b." * 10_000, None),
    ("<p><span class=share>a" * 10_000, None)])
def test_deep_and_long_pages_take_time_in_proportion(page, chars):
    began = time.process_time()
    text = html_extract.main_text(page)
    assert time.process_time() - began < 3  # about 0.5 s; pairs of paths would take hours
    assert chars is None or len(text) == chars


def test_path_scores_equal_all_pairs():
    """The trie's sums equal the smoothing over all pairs of paths up to three steps apart."""
    rng = random.Random(2)
    paths = html_extract.Paths()
    for _ in range(60):
        node = 0
        for _ in range(rng.randint(1, 7)):
            node = paths.child(node, rng.choice("ab"))
    n = len(paths.parent)
    counts = np.array([rng.choice([0, 0, 1, 3]) for _ in range(n)], dtype=float)
    lengths = counts * [rng.randint(0, 300) for _ in range(n)]
    marks = counts * [rng.randint(0, 5) for _ in range(n)]

    def up(i):
        out = [i]
        while out[-1]:
            out.append(paths.parent[out[-1]])
        return out[::-1]
    got = html_extract.path_scores(paths, lengths, marks, counts)
    for a in range(n):
        if not counts[a]:
            assert got[a] == 0
            continue
        sums = np.zeros(3)
        for b in range(n):
            pa_, pb = up(a), up(b)
            same = sum(x == y for x, y in zip(pa_, pb))
            steps = max(len(pa_), len(pb)) - same
            if counts[b] and steps <= html_extract.REACH:
                sums += math.exp(-steps ** 2 / 2) * np.array([lengths[b], 1 + marks[b], counts[b]])
        assert got[a] == pytest.approx(math.sqrt(sums[0] * sums[1]) / sums[2], rel=1e-9)
