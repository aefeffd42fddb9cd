"""Spelling variants, the Merkle manifest and the WARC index against brute force."""

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from helio.llm import manifest, spelling, warc
from helio.plans.check import duck_connect, table_digest
from helio.session import scratch_path

SF = "/root/testdata/sf0.001"
CLASH = "n long, word string, key string, pos long, grp string, block long, leaf string, path string"
EXTRA = (1, "w", "k", 2, "g", 3, "l", "p")


@pytest.mark.parametrize("name", [
    "op11_spelling_variants", "op12_merkle_manifest", "op13_warc_index"])
def test_query_equals_sql(spark, name):
    df = E.queries()[name](spark, SF)
    rel = duck_connect(SF).sql(E.oracle_sql()[name])
    assert table_digest(df.columns, [tuple(r) for r in df.collect()]) == table_digest(
        rel.columns, rel.fetchall())


# ---- spelling -------------------------------------------------------------------------

def edits_one(a, b):
    """Exactly one inserted, deleted or replaced code point, by definition."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if edits_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


def got_variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(3)
    letters = "aeinrstéÿ×"
    counts = {}
    for _ in range(25):
        word, n = "".join(rng.choices(letters, k=rng.randint(6, 9))), 5 ** rng.randint(1, 4)
        for _ in range(12):
            counts[word] = max(counts.get(word, 0), n)
            p, kind = rng.randrange(len(word)), rng.randrange(4)
            word = {0: word[:p] + word[p + 1:], 1: word[:p] + rng.choice(letters) + word[p:],
                    2: word[:p] + rng.choice(letters) + word[p + 1:],
                    3: "".join(rng.sample(word, len(word)))}[kind]  # an anagram
            n = max(5, n // rng.choice([1, 4, 5, 6]))
    counts["x" * 5000], counts["x" * 5001], counts["x" * 4999 + "y"] = 30, 6, 5
    return counts


@pytest.mark.parametrize("letters", [spelling.BLOCK_LETTERS, 40])
def test_variants_by_brute_force(spark, misspelt, letters, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", letters)
    monkeypatch.setattr(spelling, "TILE", 7 if letters == 40 else spelling.TILE)
    rows = [(w,) for w, n in misspelt.items() for _ in range(n)]
    kept = {w: n for w, n in misspelt.items() if len(w) >= 6 and n >= 5}
    got = got_variants(spelling.variants(spark.createDataFrame(rows, "word string")))
    assert got == brute_variants(kept)
    assert max(Counter(v[4] for v in got.values()).values()) > 2  # chains and groups exist


def test_no_pair_of_blocks_is_lost(spark, misspelt):
    """Blocks apart by their bounds hold no near words."""
    words = [w for w in misspelt if len(w) < 20]
    for x in (words[:40],):
        for y in (words[20:],):
            for a in x:
                for b in y:
                    if edits_one(a, b):
                        ca, cb = (spelling.letter_rows([w])[1][0] for w in (a, b))
                        assert ((ca - cb) ** 2).sum() <= 2


def test_damaged_words_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (None, "Kopfhörer kopfhÖrer"), (3, "abcdef-ABCDEF ghijk"),
            (3, "abcdef-ABCDEF ghijk"), (4, "Z" * 100_000), (5, "ÀÿéÉ×÷ naïve")]
    rows += [(i, "letters Letterss été") for i in range(10, 700)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, {CLASH}")
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    words = spelling.damaged_words(df)
    got = {r.word: r.n for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}
    assert {w: n for w, n in got.items() if len(w) >= 6} == {
        w: n for w, n in want.items() if len(w) >= 6}
    assert any(len(w) == 6 and w not in ("abcdef", "àÿéÉ×÷") for w in got)  # some are damaged
    kept = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert got_variants(spelling.variants(words)) == brute_variants(kept)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = spelling.variants(spelling.damaged_words(empty))
    assert out.collect() == []
    assert set(out.columns) == {"word", "n", "n_near", "form", "form_n", "root"}


# ---- manifest -------------------------------------------------------------------------

def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (
        doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def tree(level):
    """(root, the siblings of every leaf) level by level, by definition."""
    paths, below = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        pairs = [range(i, min(i + 2, len(level))) for i in range(0, len(level), 2)]
        for pair in pairs:
            for i in pair:
                for x in below[i]:
                    paths[x].append("".join(level[j] for j in pair if j != i))
        level, below = ([H("".join(level[i] for i in pair)) for pair in pairs],
                        [[x for i in pair for x in below[i]] for pair in pairs])
    return level[0] if level else None, paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    root, above = tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        for r, own in zip(groups[g], trees[g][1]):
            bad = (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
                   and r[4] is not None)
            out.append((r[0], leaf(r), trees[g][0], root, H("".join(own + up)), not bad))
    return out


def documents(rng, n):
    return [(rng.choice([None, i, i, i, i, 3]), rng.choice([None, "", "é\n" * i, "x%d" % i]),
             rng.choice([None, "", "en", "é", "z"] + ["hot"] * 6), rng.choice([None, "s"]),
             rng.choice([None, 5, i])) for i in range(n)]


def manifest_rows(spark, rows):
    df = spark.createDataFrame(
        [(*r, *EXTRA) for r in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.document_manifest(df, bad).collect()


@pytest.mark.parametrize("block,n", [(4, 1), (4, 200), (2, 37), (4096, 60), (16, 257)])
def test_manifest_by_brute_force(spark, monkeypatch, block, n):
    """Blocks of 2 and 4 leaves need several tiers of appends."""
    monkeypatch.setattr(manifest, "BLOCK", block)
    rows = documents(random.Random(n), n)
    rows += [rows[0]] * 3 + [(77, "long " * 100_000, "z", None, 500_000)]
    got = manifest_rows(spark, rows)
    key = repr
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified)
                   for r in got], key=key) == sorted(brute_manifest(rows), key=key)
    for r in got:
        assert r.verified == (r.folded_root == r.root)


def test_appender_keeps_witnesses_current():
    """After every append, each witness folds its leaf to the root of its open subtree."""
    state, leaves = manifest.Appender(), [H(str(i)) for i in range(23)]
    for n, value in enumerate(leaves, 1):
        state.append(value)
        assert [t[0] for t in state.open] == [i for i in range(5, -1, -1) if n >> i & 1]
        at = 0
        for height, root, witnesses in state.open:
            for witness in witnesses:
                node = leaves[at]
                for side, other in witness:
                    node = H(other + node if side == "L" else node + other)
                assert node == root and len(witness) == height
                at += 1
    assert state.close()[0] == tree(leaves)[0]


def test_manifest_of_nothing(spark):
    assert manifest_rows(spark, []) == []


# ---- warc -----------------------------------------------------------------------------

def brute_records(rows, least=0):
    groups = {}
    for i, (page_id, url, html) in enumerate(rows):
        body = (html or "").encode()
        key = body if len(body) >= least else (body, i)
        groups.setdefault(key, []).append((page_id is not None, page_id or 0, i, page_id, body))
    out = []
    for group in groups.values():
        top = max(group)
        for g in group:
            name = base64.b32encode(hashlib.sha1(g[4]).digest()).decode()
            out.append((g[3], len(g[4]), name, *(("response", None) if g is top else (
                "revisit", top[3]))))
    return Counter(out)


@pytest.fixture(scope="module")
def odd_pages():
    rng = random.Random(2)
    rows = []
    for i in range(300):
        url = rng.choice([None, "", "http://", "nohost", "http://x.org/é", "http://x.org/%d" % i,
                          "https://u@WWW.Ex%d.com:80/a b?q\n=1#f" % (i % 5)])
        rows.append((rng.choice([None, i, i, i, i, -i, 7]), url, rng.choice(
            [None, "", "hot", "hot", "hot", "<p>é%d" % i, "x" * i, "\r\n\r\nWARC/1.1\r\n"])))
    rows += [(7, "http://same", "hot")] * 5 + [(10 ** 9, "http://same", "hot")] * 6
    return rows + [(5, "http://big.org", "y" * 3_000_000)]


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows],
                                 f"page_id long, url string, html string, {CLASH}")


@pytest.mark.parametrize("least", [0, 4])
def test_archives_by_brute_force(spark, odd_pages, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    got = warc.archived(pages_frame(spark, odd_pages), least=least).collect()
    assert Counter(map(tuple, got)) == brute_records(odd_pages, least)


def test_archives_of_nothing(spark):
    assert warc.archived(pages_frame(spark, [])).collect() == []


def test_files_index_and_single_lookups(spark, odd_pages, monkeypatch):
    """Files are valid WARC, a lookup reads one capture, and a missing key finds nothing."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 8)
    folder = scratch_path(spark, "warc-test")
    pages = pages_frame(spark, odd_pages)
    entries = warc.write_archives(pages, f"{folder}/archive")
    fs, base = warc.store(f"{folder}/archive")
    listed = entries.collect()
    for name in {r.file for r in listed}:
        data = gzip.decompress(fs.open_input_file(f"{base}/{name}").read())
        kinds = Counter()
        while data:  # walk the records by their own lengths
            head = data.partition(b"\r\n\r\n")[0].decode()
            size = int(re.search(r"\r\nContent-Length: (\d+)", head).group(1))
            kinds[re.search(r"WARC-Type: (\w+)", head).group(1)] += 1
            assert data[len(head.encode()) + 4 + size:][:4] == b"\r\n\r\n"
            data = data[len(head.encode()) + size + 8:]
        assert kinds.pop("warcinfo") == 1
        assert kinds == Counter(r.record_type for r in listed if r.file == name)

    shards = warc.build_index(entries, f"{folder}/index")
    assert shards.agg(F.sum("captures")).first()[0] == len(odd_pages)
    one = spark.createDataFrame([("http://big.org", 5), ("http://absent.org/", 1)],
                                "url string, page_id long")
    wanted = one.select(warc.sort_key(F.col("url"), F.col("page_id")).alias("key"))
    found = warc.lookup(spark, f"{folder}/index", shards, wanted)
    assert [r.page_id for r in found.collect()] == [5]
    (row,) = warc.read_records(f"{folder}/archive", found).collect()
    assert (row.payload_bytes, row.record_type) == (3_000_000, "response")

    # the index is in order, within and across shards, and its directory is sparse
    fs, base = warc.store(f"{folder}/index")
    last = ""
    for s in sorted(shards.collect()):
        shard = warc.Shard(fs, f"{base}/{s.file}", s.at, s.size)
        assert len(shard.directory) == -(-s.captures // 8) and shard.first[0] == s.first
        for number in range(len(shard.directory)):
            shard._load(number)
            assert shard.keys == sorted(shard.keys) and last <= shard.keys[0]
            last = shard.keys[-1]
            assert all(len(json.loads(x.split(" ", 2)[2])) == 6 for x in shard.lines)


def test_damaged_payload_is_found(spark):
    folder = scratch_path(spark, "warc-damaged")
    entries = warc.write_archives(pages_frame(spark, [(1, "http://a.b/c", "some text")]), folder)
    row = entries.first()
    fs, base = warc.store(folder)
    data = bytearray(fs.open_input_file(f"{base}/{row.file}").read())
    record = zlib.decompress(bytes(data[row.offset:row.offset + row.size]), 31)
    forged = warc.packed(record.replace(b"some text", b"same text"))
    with fs.open_output_stream(f"{base}/{row.file}", compression=None) as out:
        out.write(bytes(data[:row.offset]) + forged)
    broken = entries.withColumn("size", F.lit(len(forged)).cast("long"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(folder, broken).collect()


def test_keys_sort_by_reversed_host_and_page(spark):
    rows = [("http://b.a.com/x", 2), ("http://a.com/y", -3), ("http://a.com/y", 10),
            ("HTTPS://User@A.com:8080/y", 9), (None, None), ("http://a.com", None)]
    df = spark.createDataFrame(rows, "url string, page_id long")
    keys = [r[0] for r in df.select(warc.sort_key(F.col("url"), F.col("page_id"))).collect()]
    assert [k.split(" ")[0] for k in keys] == [
        "com,a,b)/x", "com,a)/y", "com,a)/y", "com,a)/y", ")", "com,a)"]
    assert keys[1] < keys[3] < keys[2]
    assert all(k.count(" ") == 1 for k in keys)
