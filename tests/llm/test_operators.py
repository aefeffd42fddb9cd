"""The ten operators against brute force, on small hand-made and given tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
import corpus_pipeline
from helio.llm import (components, decontam, embed_dedup, html_extract, line_dedup, mixing,
                       ngram_join, quality, queries, stages, textscan, token_planes, toxicity,
                       url_filter)
from helio.plans.check import duck_connect, table_digest
from helio.session import scratch_path

SF = "/root/testdata/sf0.001"
SF_BIG = "/root/testdata/sf0.01"
CLASH = "size long, n long, score double, kept string, h1 long, doc long, taken long, _lost long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def docs_frame(spark, rows):
    """rows of (doc_id, text, source), with extra columns that clash with our names."""
    full = [(i, t, "en", s, len(t or ""), 1, 2, 3.0, "x", 5, 6, 7, 8) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\\x20\\x09-\\x0D]+", low)


def alnum(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and near copies."""
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=60)) for _ in range(6)]
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, base[0], "a"),
            (None, None, None), (4, "one two", "b"), (5, "ONE two", "b"), (6, "é\x0b É one", "c"),
            (7, " ".join(rng.choices(vocab, k=200_000)), "b"), (8, base[0], "a"),
            (8, base[0], "a"), (9, base[0].upper(), "b"), (10, "x" * 300_000, "c")]
    n = 11
    for b in base:
        for edits in (0, 1, 1, 2, 4, 9):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10 ** 6)
            rows.append((n, "\n".join([" ".join(w), "The same long line in many documents",
                                       "  the SAME long line in many documents\r", "tail"]),
                         rng.choice("abc")))
            n += 1
    return rows


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute_near(rows, k, t):
    sets = defaultdict(set)
    for i, text in rows:
        if i is not None:
            sets[i].add(shingles(text, k))
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    links = []
    for x in range(len(flat)):
        for y in range(x):
            (a, s), (b, u) = flat[x], flat[y]
            both = len(s & u)
            if a != b and 100 * both >= t * (len(s) + len(u) - both):
                links.append((a, b))
    return brute_components(list(sets), links)


@pytest.mark.parametrize("k,t", [(4, 85), (5, 80), (2, 50)])
def test_near_documents_on_odd_rows(spark, odd, k, t):
    got = ngram_join.near_documents(docs_frame(spark, odd), k=k, t=t).collect()
    want = brute_near([(i, x) for i, x, _ in odd], k, t)
    assert len(got) == len(odd)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]), r
    sizes = Counter((i, len(shingles(x, k))) for i, x, _ in odd)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes


def test_near_documents_on_given_rows(spark):
    docs = spark.read.parquet(f"{SF_BIG}/documents.parquet").limit(600)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_near(rows, 4, 85)
    got = ngram_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert len(set(want.values())) < len(want)


def test_chain_of_copies_is_one_component(spark):
    """A chain in which only neighbours link must not be cut by the two rounds."""
    w = ["t%d" % i for i in range(300)]
    rows = [(i, " ".join(w[i * 4:i * 4 + 120])) for i in range(40)]
    want = brute_near(rows, 4, 85)
    got = ngram_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert set(want.values()) == {0}


def brute_links(rows, k, t):
    """Links of every (id, set): other pairs of id and set that are equal or similar."""
    nodes = sorted({(i, shingles(x, k)) for i, x in rows if i is not None and words(x)},
                   key=lambda n: n[0])
    n = Counter()
    for x, (_, s) in enumerate(nodes):
        for y in range(x):
            u = nodes[y][1]
            both = len(s & u)
            if 100 * both >= t * (len(s) + len(u) - both):
                n[nodes[x]] += 1
                n[nodes[y]] += 1
    return n


@pytest.mark.parametrize("shingles_a_block", [1 << 16, 200])
def test_every_link_is_counted(spark, odd, shingles_a_block, monkeypatch):
    """Also inside a component, where the rounds for components leave most pairs out."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles_a_block)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    w = ["t%d" % i for i in range(400)]
    rows = [(i, x) for i, x, _ in odd]
    rows += [(100 + i, " ".join(w[i * 4:i * 4 + 120])) for i in range(20)]
    rows += [(200 + i, " ".join(w[200:300] + ["end%d" % i])) for i in range(30)]
    rows += [(230, rows[-1][1]), (230, rows[-2][1]), (230, rows[-2][1]), (None, rows[-1][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_documents(frame, 4, 85).collect()
    links = brute_links(rows, 4, 85)
    want = Counter((i, len(shingles(x, 4)), 0 if i is None else links[i, shingles(x, 4)])
                   for i, x in rows)
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == want
    assert max(links.values()) > 25


def test_long_lists_are_cut(spark, monkeypatch):
    """No group of a round holds a list that many near copies share, and no link is lost."""
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 8)
    w = ["t%d" % i for i in range(260)]
    rows = [(i, " ".join(w[:60] + ["end%d" % i] + w[60:100])) for i in range(60)]
    rows += [(100 + i, " ".join(w[:90] + ["x%d" % (i // 3), "y%d" % i] + w[100 + i:112 + i]))
             for i in range(40)]
    rows += [(200 + i, " ".join(w[i * 4:i * 4 + 120])) for i in range(20)]
    groups = []
    for name in ("cut_lists", "meetings"):
        def seen(df, call=getattr(ngram_join, name), keys=1 + (name == "meetings")):
            out = call(df)
            groups.append(out.groupBy(*out.columns[:1 + keys]).count().agg(
                F.max("count"), F.count(F.lit(1)), F.countDistinct("shingle")).first())
            return out
        monkeypatch.setattr(ngram_join, name, seen)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_documents(frame, 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_near(rows, 4, 85)
    assert all(most <= 5 * 8 and n > shingles for most, n, shingles in groups), groups


def test_one_per_group(spark, odd):
    docs = docs_frame(spark, odd)
    got = ngram_join.one_per_group(docs)
    assert got.columns == docs.columns
    want = brute_near([(i, x) for i, x, _ in odd], 5, 80)
    ids = Counter(r.doc_id for r in got.collect())
    expect = Counter({i: 1 for i in want if want[i] == i})
    expect[None] = 2
    assert ids == expect


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    links += [(2000, i) for i in range(2001, 2200)]
    rng.shuffle(links)
    want = brute_components({x for l in links for x in l}, links)
    got = components.components(
        spark.createDataFrame(links + [(None, 3)], "a long, b long").repartition(7))
    got = {r.id: r.component for r in got.collect()}
    for n, c in want.items():
        assert got.get(n, n) == c
    empty = components.components(spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0


def test_mix(spark, odd):
    docs = docs_frame(spark, odd).select("doc_id", "source",
                                         mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(odd)
    assert Counter((r.doc_id, r.size) for r in got) == Counter(
        (i, len(words(t))) for i, t, _ in odd)
    by, size, target = Counter(), Counter(), {}
    for r in got:
        by[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in by:
        assert abs(by[s] - target[s]) <= 0.5 and target[s] <= 2 * size[s]
    again = mixing.mix(docs).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mixed_documents(spark, odd):
    docs = docs_frame(spark, odd)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert max(Counter((r.doc_id, r.text, r.source) for r in rows).values()) <= 4
    assert {r.source for r in rows} <= {"a", "b", "c", None}
    assert Counter(r.source for r in rows)["a"] > 0


def test_word_scan_matches_regex():
    texts = ["Hello  World", None, "", "É\x0bé x", "a,b-c  9É", "tail "]
    for kind, brute in (("space", words), ("alnum", alnum)):
        h, first, starts, ends = textscan.word_hashes(pa.array(texts), kind)
        data, _ = textscan.utf8_buffer(pa.array(texts))
        low = textscan.lower_table(True)[data].tobytes()
        got = [[low[starts[j]:ends[j]].decode() for j in range(first[i], first[i + 1])]
               for i in range(len(texts))]
        assert got == [brute(t) for t in texts]
        flat = [w for ws in got for w in ws]
        assert len({(a, b) for a, b in zip(flat, h.tolist())}) == len(set(flat))


def brute_hits(text, items, size=10):
    w, hit, found = alnum(text), set(), set()
    for item, t in items:
        u = alnum(t)
        n = min(size, len(u))
        grams = {tuple(u[i:i + n]) for i in range(len(u) - n + 1)} if u else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), found


def test_decontamination(spark, odd):
    long = alnum(odd[6 + 1][1])
    items = [(1, " ".join(words(odd[-1][1])[5:25])), (2, "One, two"), (3, None), (4, ""),
             (5, " ".join(odd[8][1].split()[100:130])), (None, "the same long line"),
             (1, "many documents"), (6, "not there at all")]
    assert long is not None
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    docs = docs_frame(spark, odd)
    for block in (200_000, 7):
        got = decontam.contamination(docs, bench, block_windows=block).collect()
        seen = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got)
        want = Counter()
        for i, text, _ in odd:
            n, hit, found = brute_hits(text, items)
            want[(i, n, hit, tuple(sorted(x for x in found if x is not None)))] += 1
        assert seen == want
    none = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(odd) and not any(r.n_hit for r in none)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"),
                                  (3, "gamma alpha q q q beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    hit = lambda slop: {r.doc_id for r in decontam.contamination(
        docs, bench, slop=slop).collect() if r.n_hit}
    assert hit(0) == {2}
    assert hit(1) == {1, 2}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    rows = []
    for i in range(300):
        v = centers[i % 6] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2, 0.35])
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 8, 0), (303, rows[0][1], None),
             (304, [float("nan")] + [1.0] * 7, 0), (305, [None] + [1.0] * 7, 0),
             (306, rows[0][1][:4], 0), (307, [2 * x for x in rows[0][1]], 0), (None, rows[0][1], 0)]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema).withColumn("n", F.lit(1)).withColumn(
        "cell", F.lit("x"))
    old = embed_dedup.CELL, embed_dedup.TILE_X, embed_dedup.TILE_Y
    ok = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows
          if i is not None and v is not None and lab is not None and None not in v
          and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for x, a in enumerate(ok) for b in ok[:x]
             if a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93]
    n = Counter(x for l in links for x in l)
    want = brute_components([r[0] for r in rows if r[0] is not None], links)
    try:
        for cell, tx, ty in ((2048, 2048, 8192), (20, 8, 16)):
            embed_dedup.CELL, embed_dedup.TILE_X, embed_dedup.TILE_Y = cell, tx, ty
            got = embed_dedup.near_vectors(df, 0.93).collect()
            assert len(got) == len(rows)
            for r in got:
                if r.vec_id is None:
                    assert r.n_links == 0 and r.component_id is None
                    continue
                assert r.n_links == n[r.vec_id], r
                assert r.component_id == want[r.vec_id] and r.kept == (want[r.vec_id] == r.vec_id)
    finally:
        embed_dedup.CELL, embed_dedup.TILE_X, embed_dedup.TILE_Y = old
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_pivots_grow_with_the_label(spark, monkeypatch):
    """More cells than MANY, in several blocks: the same links, and few of all pairs."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 12))
    rows = [(i, [float(x) for x in centers[i % 40] + rng.normal(size=12) * 0.1], 0)
            for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole, cut = {}, {}
    a = {tuple(r) for r in embed_dedup.near_vectors(df, 0.93, report=whole).collect()}
    for name, value in (("CELL", 8), ("MANY", 20), ("BLOCK", 100)):
        monkeypatch.setattr(embed_dedup, name, value)
    b = {tuple(r) for r in embed_dedup.near_vectors(df, 0.93, report=cut).collect()}
    assert a == b and len({r[3] for r in a}) < 100
    assert whole == {"classes": 1200, "copies": 0, "pairs": 1200 ** 2}
    assert cut["classes"] == 1200 and cut["pairs"] < 0.5 * 1200 ** 2


def test_line_dedup(spark, odd):
    got = line_dedup.apply_bitmaps(docs_frame(spark, odd),
                                   line_dedup.line_bitmaps(docs_frame(spark, odd))).collect()
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(
        {c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    low = -2 ** 63
    for i, t, _ in odd:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(low if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = Counter()
    for i, t, _ in odd:
        lines = (t or "").split("\n")
        keep = [x for x in lines if gone.get(key(x), i) == (low if i is None else i)
                or key(x) not in gone]
        want[(i, len(lines), len(lines) - len(keep), "\n".join(keep))] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == want
    empty = docs_frame(spark, odd).limit(0)
    assert line_dedup.apply_bitmaps(empty, line_dedup.line_bitmaps(empty)).count() == 0


@pytest.mark.parametrize("kind,block", [("byte", 65536), ("bit", 1000), ("byte", 7)])
def test_token_planes(spark, odd, kind, block):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = [r for r in odd if block > 100 or len(r[1] or "") < 1000]
    rows += [(100 + i, x, "a") for i, x in enumerate(
        ["a  b \n c", "x   y", "it 's don't \t q", "<|endoftext|> hi", "  lead", "a ", " a",
         "\u65e5\u672c \u8a9e\u3000\u306e", "b\u00a0 c\u3000 d", "\x85 a \x1c b\x7f c"])]
    docs = docs_frame(spark, rows)
    out = token_planes.write_planes(docs, scratch_path(spark, "test-planes"),
                                    queries.tokenizer_path(), block_ids=block, kind=kind)
    ids = {}
    for i, x, _ in rows:
        ids.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [0])
    got = token_planes.read_index(spark, out).orderBy("start").collect()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        same = [x for x in ids[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(
            np.array(x, dtype="<u4").tobytes()) == r.ids_crc32]
        assert same, r
        ids[r.doc_id].remove(same[0])
    assert not any(ids.values())
    stream = [x for r in token_planes.read_ids(spark, out).orderBy("part", "block").collect()
              for x in r.ids]
    assert len(stream) == at


def test_token_planes_bounds_batches(spark, monkeypatch):
    """Token files are written from small batches, and their blocks are read one at a time."""
    def largest(path, end_id, block_ids, kind):
        def write(batches):
            n = max((b.num_rows for b in batches), default=0)
            yield pa.RecordBatch.from_pylist([{"n_ids": n}], schema=token_planes._TYPES)
        return write

    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    before = {k: spark.conf.get(k, None) for k in stages.BATCH}
    monkeypatch.setattr(token_planes, "_block_writer", largest)
    real = type(docs).repartitionByRange  # one partition, so that a batch could hold all rows
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda df, *by: real(df, 1, *by))
    out = token_planes.write_planes(docs, scratch_path(spark, "test-planes"), "unused")
    sizes = [r.n_ids for r in spark.read.parquet(out).collect()]
    assert 0 < max(sizes) <= int(stages.BATCH["spark.sql.execution.arrow.maxRecordsPerBatch"])
    assert before == {k: spark.conf.get(k, None) for k in stages.BATCH}
    rows = pa.RecordBatch.from_pylist([{"part": i} for i in range(3)], schema=token_planes._TYPES)
    assert [r["part"] for r in token_planes._blocks(iter([rows, rows]))] == [0, 1, 2, 0, 1, 2]


def test_token_planes_empty(spark, odd):
    out = token_planes.write_planes(docs_frame(spark, odd).limit(0),
                                    scratch_path(spark, "test-planes"), queries.tokenizer_path())
    assert token_planes.read_index(spark, out).count() == 0


def test_token_planes_keeps_frequent_chunks(monkeypatch):
    """A full cache drops rare chunks only, and gives the tokenizer's ids at any size."""
    rng = random.Random(7)
    often = [f"the{c}" for c in "abcdefgh"]
    slices = [[" ".join(rng.sample(often, 8) + ["n" + rng.choice("abc") * k for k in range(i, i + 9)])
               for _ in range(2)] for i in range(1, 90, 9)]
    signs = ["\u00e9", "\u00fc\u00df", "\u3000", "\u00a0", "\x85", "\u65e5\u672c", "<|endoftext|>",
             "don't", "'s", "!!", "a.", "1a", "12", "\n", " ", "  ", "\t", "x", "\u2009", "\U0001F600", "`{", "Z["]
    slices += [["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(40)] + [None, ""]
               for _ in range(10)]
    passed = []
    real = token_planes.Encoder.learn
    monkeypatch.setattr(token_planes.Encoder, "learn",
                        lambda self, chunks: passed.extend(chunks) or real(self, chunks))
    for room in (1, 5, 60, 600_000):
        monkeypatch.setattr(token_planes, "CACHE_ENTRIES", room)
        encoder = token_planes.Encoder(queries.tokenizer_path())
        passed.clear()
        for n, texts in enumerate(slices):
            ids, counts = encoder.encode(pa.array(texts, pa.string()), 0)
            want = [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids + [0]
                    for x in texts]
            assert counts.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
            if n == 9 and room >= 60:
                assert max(Counter(c for c in passed if c.startswith(b" the")).values()) == 1


def test_token_planes_equal_hashes(monkeypatch):
    """Chunks that share a hash are told apart by their bytes."""
    monkeypatch.setattr(token_planes, "mix64", lambda x: np.zeros_like(x))
    encoder = token_planes.Encoder(queries.tokenizer_path())
    for text in ("alpha", "gamma", "be", "alpha"):
        ids, _ = encoder.encode(pa.array([text]), 0)
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_crc_join():
    rng = random.Random(1)
    for n in (0, 1, 7, 1000):
        a, b = rng.randbytes(n), rng.randbytes(3 * n)
        assert token_planes.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_quality(spark):
    docs = spark.read.parquet(f"{SF_BIG}/documents.parquet")
    labels = spark.read.parquet(f"{SF_BIG}/labels.parquet")
    good = labels.filter("quality = 1").select("doc_id")
    got = quality.resampled(docs, good)
    rates = {r.quality: r.kept for r in got.join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[0] < 0.02 and rates[1] > 0.99
    rows = got.collect()
    k = sum(r.kept for r in rows)
    cut = sorted((r.gumbel_key for r in rows), reverse=True)[k - 1]
    assert all(r.kept == (r.gumbel_key >= cut) for r in rows)
    ten = [r for r in quality.resampled(docs, good, k=10).collect() if r.kept]
    assert len(ten) == 10
    kept = quality.sampled_documents(docs, good)
    assert kept.columns == docs.columns and kept.count() == k


def test_quality_odd_rows(spark, odd):
    docs = docs_frame(spark, odd)
    none = spark.createDataFrame([], "doc_id long")
    assert quality.sampled_documents(docs, none).count() == len(odd)
    some = spark.createDataFrame([(8,), (None,), (99,)], "doc_id long")
    assert quality.resampled(docs, some).count() == len(odd)
    assert quality.sampled_documents(docs.limit(0), some).count() == 0


def test_kth_largest(spark):
    values = [0.5, 0.5, 0.5, -3.0, 1e9, 2.0, 2.0, -1e-300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values)):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_finds_sentences_and_odd_rows(spark, odd):
    rows = [(i, f"Good word{i} here. Nice day! {'You vile thing.' if i % 2 else 'All fine.'}", "a")
            for i in range(1, 200)]
    docs = docs_frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows] + [(None, 1), (3, None)],
                                   "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.scored(docs, model).collect()
    for r in got:
        assert (r.score >= 0.5) == (r.doc_id % 2 == 1)
        if r.doc_id % 2:
            assert [s.text for s in r.sentences] == ["You vile thing"]
    other = {(r.doc_id, r.score) for r in toxicity.scored(docs_frame(spark, odd), model).collect()}
    assert (1, 0.0) in other and (2, 0.0) in other and all(0 <= s <= 1 for _, s in other)
    assert toxicity.train(docs, labels.filter("toxic = 1"), F.lit(True)) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_urls(spark):
    urls = [None, "", "no-scheme/org/", "http://Example.ORG/es/1", "https://a.example.org/en/12?x#y",
            "http://example.org/en/2", "http://org", "http://org/", "http://xorg/", "http://a.com/fr/",
            "http://b.com/de/x", "http://a.com/fr", "ftp://casino-win.net?q=1&r=2", "a://b://c/d",
            "http://example.org/en/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] * 2,
                                  "page_id long, url string, host string").withColumn(
        "label", F.lit(7.0))
    got = {r.page_id: r for r in url_filter.judged(pages, queries.RULES, trees=2).collect()}
    rules = {3: "example.org/es/", 4: "example.org/en/1", 5: "org/", 7: "org/", 9: "com/fr/",
             10: "com/de/", 14: "example.org/en/1"}
    for i, r in got.items():
        assert r.rule == rules.get(i), r
        if r.rule:
            assert r.verdict == dict((b, a) for a, b in queries.RULES)[r.rule]
        assert r.verdict in ("allow", "block")
    assert (got[4].host, got[4].path) == ("a.example.org", "/en/12")
    assert (got[12].host, got[12].path) == ("casino-win.net", "")
    assert (got[13].host, got[13].path) == ("b:", "//c/d")
    assert all((got[i].host, got[i].path) == ("", "") for i in (0, 1, 2))
    assert url_filter.judged(pages.limit(0), queries.RULES).count() == 0


def test_url_verdicts_of_the_trees(spark):
    got = url_filter.judged(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"),
                            queries.RULES).filter("rule IS NULL")
    seeded = F.col("host").rlike("|".join(url_filter.SEED_WORDS))
    rates = {r.s: r.b for r in got.groupBy(seeded.alias("s")).agg(
        F.avg((F.col("verdict") == "block").cast("int")).alias("b")).collect()}
    assert rates[False] < 0.05 and rates[True] > 0.5


def test_bad_hosts_without_seed_word_are_blocked(spark):
    """URLs without rule or seed word are not taught as allowed."""
    got = url_filter.judged(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"),
                            queries.RULES).filter("rule IS NULL")
    bad = F.col("host").rlike("ads-track|cheap-pills|" + "|".join(url_filter.SEED_WORDS))
    unseeded = F.col("host").rlike("ads-track|cheap-pills")
    rates = {(r.b, r.u): r.share for r in got.groupBy(bad.alias("b"), unseeded.alias("u")).agg(
        F.avg((F.col("verdict") == "block").cast("int")).alias("share")).collect()}
    assert rates[True, True] > 0.5 and rates[True, False] > 0.5 and rates[False, False] < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a>b}</style>
<script>var x="</p><p>code";</script></head><body class="notice-page"><nav><ul><li><a href="/x">Menu item, one.</a>
</ul></nav><div class="cookie-notice">We use cookies. A lot, and gladly.</div><!-- <p>gone</p> -->
<header><h2>Site, name.</h2></header><div id="wrap"><div class="text"><h1>Big &amp; small</h1>
<p>First <b>bo</b>ld, sentence&nbsp;one.<br>Next line, here.<p>Second
  paragraph, with &lt;tags&gt; and <a title="a>b" href=x>a link</a>.<ul><li>One, item.<li>Two, items.</ul>
<form>Name, please. <input value="x"></form><p>No.</p></div><aside>See, also: this, that.</aside></div>
<div id="comments"><p>A reader, says: nice text, really, very nice indeed.</p></div>
<footer>&copy; me, 2020.</footer>"""


def test_html(spark):
    want = ("Big & small First bold, sentence one. Next line, here. Second paragraph, with <tags> "
            "and a link. One, item. Two, items. No.")
    assert html_extract.main_text(PAGE) == want
    assert html_extract.main_text("<p>plain, text") == "plain, text"
    assert html_extract.main_text("just text") == "just text"
    assert html_extract.main_text("<nav>only, menu.</nav>") == ""
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"),
                                   (None, "u", "", "t"), (3, "u", "<p>" + "long, " * 200_000, "t")],
                                  "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_extract.extracted(pages).collect()]
    assert Counter(got) == Counter([(1, want), (1, want), (2, ""), (None, ""),
                                    (3, " ".join(["long,"] * 200_000))])
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_html_of_given_pages(spark):
    """The given pages have one <article>: everything in it, and nothing else."""
    import html as H
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in pages:
        body = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        body = re.sub("</?(b|i|em|strong|a)>", "", body)
        text = " ".join(H.unescape(re.sub("<[^>]*>", " ", body)).split())
        assert html_extract.main_text(r.html) == text, r.page_id


@pytest.mark.parametrize("size", [1, 6])
def test_html_beside_teaser_articles(size):
    """An <article> that is only a teaser does not push out the text beside it."""
    teaser = "A teaser, short and sweet, for another page. " * size
    body = ["Paragraph %d of the text, which goes on, and on, for a while." % i for i in range(30)]
    page = ("<html><body><div class='text'><h1>The head</h1>" + "".join(
        f"<p>{b}</p>" for b in body) + "</div><div>" + f"<article><p>{teaser}</p></article>" * 2
        + "</div></body></html>")
    text = html_extract.main_text(page)
    assert all(b in text for b in body)


@pytest.mark.parametrize("outer", ["article", "div"])
def test_html_keeps_text_with_cue_words_in_names(outer):
    """A cue word in an id, or in part of a class, does not remove text of the article."""
    parts = ['<p>The first part, which is long enough, says a lot. And it says more, too.</p>',
             '<section id="discussion"><p>We discuss, at some length, what was found.</p></section>',
             '<h2 id="related-work">Related work</h2>',
             '<p>Others, before us, found the same. They wrote it down, as we do.</p>',
             '<div class="share-prices"><p>The prices of shares rose, and fell, again.</p></div>',
             '<p id="search-methods">We searched, by hand, in all of the tables.</p>']
    noise = ['<div class="share"><p>Share this, please, with friends.</p></div>',
             '<div id="share-links"><a href="/a">Post it, now</a> <a href="/b">Mail it</a></div>',
             '<div class="ad"><p>Buy this, now, or never.</p></div>']
    want = " ".join(" ".join(re.sub("<[^>]*>", " ", x).split()) for x in parts)
    inner = "".join(p + noise[i % 3] for i, p in enumerate(parts))
    page = (f"<html><body><nav>Menu</nav><{outer}>{inner}</{outer}>"
            '<div id="comments"><p>A reader says, well, not so much.</p></div></body></html>')
    assert html_extract.main_text(page) == want
    wrapped = page.replace("<body>", "<body><div class='has-sidebar'>").replace(
        "</body>", "</div></body>")
    assert want in html_extract.main_text(wrapped)


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, key):
    df = queries.QUERIES[key](spark, SF)
    got = table_digest(df.columns, [tuple(r) for r in df.collect()])
    rel = duck_connect(SF).sql(queries.ORACLE_SQL[key])
    assert got == table_digest(rel.columns, rel.fetchall())


def test_every_query_is_registered():
    assert set(queries.QUERIES) <= set(E.queries())
    assert set(queries.ORACLE_SQL) <= set(E.oracle_sql())
    for n in range(1, 14):
        assert [k for k in E.queries() if re.match(f"op{n}_", k)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_BIG}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_BIG}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_BIG}/benchmark.parquet").collect()]
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = os.path.join(scratch_path(spark, "test-stage"), "out")
        stage(spark, now, SF_BIG).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
        kept.append([(r.doc_id, r.text) for r in now.collect()])
    assert not [i for i, _ in kept[0] if labels.get(i) == 0]
    groups = brute_near(kept[0], 5, 80)
    assert sorted(i for i, _ in kept[1]) == sorted(i for i, c in groups.items() if i == c)
    clean = {i for i, t in kept[1] if not brute_hits(t, items)[1]}
    assert {i for i, _ in kept[2]} == clean and len(clean) < len(kept[1])
    assert {i for i, _ in kept[3]} <= clean
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF_BIG).collect()
    assert Counter(r.doc_id for r in last) == Counter(i for i, _ in kept[3])
