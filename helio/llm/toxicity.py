"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic score of its
features (words, and the first four and five bytes of words, so that unseen forms of a
known stem count), the document's is their noisy-or, 1 - prod(1 - p).  Only document
labels are known, so the sentence weights are trained by gradient steps on the
document likelihood; the offending sentences are those with a high p.

Training uses at most ``sample`` labelled documents, half of each label where there
are enough, chosen by hash (documented bound); its features are the ``FEATURES`` with
the largest z-score (``MIN_Z`` at least) for toxic against clean documents of that sample.
Weights are kept at 0 or above: a sentence is toxic for what it holds, never excused.  Scoring reads
every text whole, by tasks.

Defined results: null and empty texts have no sentences and score 0; a null id is
scored but never learned from; a very long text is scored whole, in a slice of its own;
equal z scores are ordered by hash when features are chosen; a document labelled twice takes the larger label;
null labels are passed over; without labels of both kinds every score is 0; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio.llm.stages import documents, written
from helio.llm.textscan import mix64, text_slices, utf8_buffer, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 8000
FEATURES = 4096
MIN_Z = 3.0
_STOPS = (0x0A, 0x21, 0x2E, 0x3F)  # newline ! . ?


def features(texts: pa.Array):
    """(hash, sentence, text, bounds): features with the sentence they stand in (numbered
    through the batch), each sentence's text, and its byte range (first to last word)."""
    hashes, first, starts, ends = word_hashes(texts, "alnum")
    data, _ = utf8_buffer(texts)
    if not len(hashes):
        none = np.zeros(0, dtype=np.int64)
        return hashes, none, none, np.zeros((0, 2), dtype=np.int64)
    stops = np.cumsum(np.isin(data, np.array(_STOPS, dtype=np.uint8)))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = stops[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (before[1:] != before[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    out, owner = [hashes], [sentence]
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    for n in (4, 5):
        long = np.flatnonzero(ends - starts >= n)
        packed = np.full(len(long), n, dtype=np.uint64)
        for i in range(n):
            packed = (packed << np.uint64(8)) | lower[starts[long] + i].astype(np.uint64)
        out.append(mix64(packed))
        owner.append(sentence[long])
    return (np.concatenate(out), np.concatenate(owner), text[begin],
            np.stack([starts[begin], ends[last]], axis=1))


class Vocabulary:
    """Maps feature hashes to weights; a bit table skips most unknown ones."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, index): the known hashes' places, and their index."""
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], at[hit]


def log_none(score: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(score))."""
    return -np.logaddexp(0.0, score)


def _labelled(docs: DataFrame, labels: DataFrame, usable, sample: int) -> DataFrame:
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
             .dropna().filter(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    some = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(sample // 2) for y in (0, 1)]
    # at most ``sample`` ids are broadcast
    return docs.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE,
          steps: int = 600, penalty: float = 1e-5):
    """(Vocabulary, base): weights of the noisy-or model, or None without both labels."""
    chosen = written(_labelled(documents(docs), labels, usable, sample)
                     .select("doc_id", "toxic", "text"), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None

    def count(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                toxic = np.asarray(piece.column(1)).astype(np.int64)
                hashes, sentence, text, _ = features(piece.column(2))
                pairs = np.unique(np.stack([hashes, text[sentence].astype(np.uint64)]), axis=1)
                names, at = np.unique(pairs[0], return_inverse=True)
                bad = toxic[pairs[1].astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)),
                     pa.array(np.bincount(at, minlength=len(names))),
                     pa.array(np.bincount(at, weights=bad, minlength=len(names))
                              .astype(np.int64))], names=["f", "n", "bad"])

    n0, n1 = sizes[0], sizes[1]
    share = F.col("n") / (n0 + n1)
    gap = F.col("bad") / n1 - (F.col("n") - F.col("bad")) / n0
    z = gap / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-9)
    best = (chosen.mapInArrow(count, "f long, n long, bad long").groupBy("f")
            .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter("n >= 5")
            .withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "f").limit(FEATURES).select("f").toArrow())
    names = np.sort(np.asarray(best.column("f")).view(np.uint64))
    words = Vocabulary(names, np.zeros(len(names)))

    def bags(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                hashes, sentence, text, _ = features(piece.column(2))
                which, index = words.find(hashes)
                hits = np.unique(np.stack([sentence[which], index]), axis=1)
                per_text = np.bincount(text, minlength=piece.num_rows)
                first = np.concatenate(([0], np.cumsum(per_text)))
                owner = text[hits[0]] if len(text) else hits[0]
                cut = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(1).cast(pa.int64()), pa.array(per_text),
                     pa.array([hits[0][a:b] - first[i] for i, (a, b) in
                               enumerate(zip(cut[:-1], cut[1:]))], pa.list_(pa.int64())),
                     pa.array([hits[1][a:b] for a, b in zip(cut[:-1], cut[1:])],
                              pa.list_(pa.int64()))],
                    names=["toxic", "sentences", "at", "feature"])

    got = chosen.mapInArrow(bags, "toxic long, sentences long, at array<long>, "
                            "feature array<long>").toArrow()
    weights, base = fit_noisy_or(
        np.asarray(got.column("toxic")), np.asarray(got.column("sentences")),
        [np.asarray(x.values) for x in got.column("at")],
        [np.asarray(x.values) for x in got.column("feature")], len(names), steps, penalty)
    return Vocabulary(names, weights), base


def fit_noisy_or(y, sentences, at, feature, n_features: int, steps: int, penalty: float):
    """Adam on the noisy-or likelihood with an L1 ``penalty`` and weights of at least 0;
    sentences without features share one score."""
    size = np.array([len(a) for a in at])
    doc = np.repeat(np.arange(len(y)), size)
    flat = np.concatenate(at) if len(at) else np.zeros(0, np.int64)
    feat = np.concatenate(feature) if len(feature) else np.zeros(0, np.int64)
    key, sent = np.unique(doc * (int(sentences.max(initial=0)) + 1) + flat, return_inverse=True)
    owner = np.zeros(len(key), dtype=np.int64)
    owner[sent] = doc
    plain = sentences - np.bincount(owner, minlength=len(y))
    theta = np.zeros(n_features + 1)
    theta[-1] = -8.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, base = theta[:-1], theta[-1]
        score = base + np.bincount(sent, weights=w[feat], minlength=len(key))
        none = np.bincount(owner, weights=log_none(score), minlength=len(y))
        none += plain * log_none(base)
        # d loss / d score of a sentence is p (1 - y / P(document))
        p_doc = np.maximum(-np.expm1(none), 1e-12)
        pull = np.where(y == 1, 1.0 - 1.0 / p_doc, 1.0)
        p = 1.0 / (1.0 + np.exp(-np.clip(score, -50, 50)))
        g = p * pull[owner]
        p_base = 1.0 / (1.0 + np.exp(-base))
        grad = np.append(np.bincount(feat, weights=g[sent], minlength=n_features),
                         g.sum() + (plain * p_base * pull).sum()) / len(y)
        grad[:-1] += penalty
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9 ** step)) / (
            np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0.0)
        theta[-1] = min(theta[-1], -2.0)
    return theta[:-1], float(theta[-1])


def scored(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text",
           offending: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences): ``sentences`` are the offending ones, as (no, p, text)."""
    schema = "doc_id long, score double, sentences array<struct<no:int,p:double,text:string>>"
    texts = documents(docs, id_col, text_col)
    if model is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"), F.array().cast(
            "array<struct<no:int,p:double,text:string>>").alias("sentences"))
    # arrays only: a broadcast value is unpickled where this module may be missing
    shared = docs.sparkSession.sparkContext.broadcast(
        (model[0].hashes, model[0].values, model[1]))
    kind = pa.list_(pa.struct([("no", pa.int32()), ("p", pa.float64()), ("text", pa.string())]))

    def score(batches):
        hashes, values, base = shared.value
        words = Vocabulary(hashes, values)
        for batch in batches:
            for piece in text_slices(batch, "text"):
                hashes, sentence, text, bounds = features(piece.column(1))
                which, index = words.find(hashes)
                hits = np.unique(np.stack([sentence[which], index]), axis=1)
                own = base + np.bincount(hits[0], weights=words.values[hits[1]],
                                         minlength=len(text))
                none = np.bincount(text, weights=log_none(own), minlength=piece.num_rows)
                bad: list = [[] for _ in range(piece.num_rows)]
                p = 1.0 / (1.0 + np.exp(-np.clip(own, -700, 700)))
                first = np.searchsorted(text, np.arange(piece.num_rows))
                data, _ = utf8_buffer(piece.column(1))
                for s in np.flatnonzero(p >= offending).tolist():
                    raw = data[bounds[s][0]:bounds[s][1]].tobytes()
                    bad[text[s]].append({"no": int(s - first[text[s]]), "p": float(p[s]),
                                         "text": raw.decode("utf-8")})
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(-np.expm1(none)), pa.array(bad, kind)],
                    names=["doc_id", "score", "sentences"])
    return texts.mapInArrow(score, schema)


def held_out(doc_id):
    """crc32 of the id as text is divisible by 5 (a null id: like empty text)."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, sentences): trained on the labelled rows not held out."""
    model = train(docs, labels, ~held_out(F.col("doc_id")), sample)
    return scored(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
