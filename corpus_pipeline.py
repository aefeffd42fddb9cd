"""The corpus pipeline: five stages over ``documents``, one operator each.

Every stage takes all that its predecessor kept and returns a DataFrame that is written
as Parquet and read again as the next one's documents.  All but the last return the
columns of ``documents``; the last returns one row per document from the token files.

Defined results, for every stage: rows with a null id, source, lang or n_chars are documents
like others; null and empty texts pass the near-copy and benchmark stages, are as likely
as other undecided texts in the first, are taken 0 times by the mix and would be the end
id alone in the token files; texts of any length are read whole; repeated rows stay or go
together, but for near copies, of which one stays (the smallest id; of rows that share it,
one); an empty table passes every stage as an empty table; columns beside those of
``documents`` pass the filters with their names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.llm import decontam, mixing, ngram_join, quality, token_planes
from helio.llm.queries import tokenizer_path
from helio.llm.stages import without, written
from helio.session import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the texts labelled good keeps."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return quality.sampled_documents(docs, good.select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard 0.8)."""
    return ngram_join.one_per_group(docs, k=5, t=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item.  A match depends on
    the text alone, so documents are found again by the hash of their text."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    lost = (decontam.contamination(docs.select(key.alias("doc_id"), "text"), bench, size=10)
            .filter("n_hit > 0").select("doc_id"))
    return without(docs, key, lost)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights; a document comes once per epoch."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in bit-plane files; doc_id, start, n_tokens, ids_crc32 read from them."""
    out = token_planes.write_planes(docs, scratch_path(spark, "llm-planes"), tokenizer_path())
    return token_planes.read_index(spark, out)


STAGES = [("quality classifier", keep_quality), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", decontaminate), ("mixing sources", mix_sources),
          ("token-ID binary output", tokenize)]

#: Model weights and hash-random sampling are not expressible in SQL; the stages are
#: tested one by one against brute force in ``tests/llm``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
