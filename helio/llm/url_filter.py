"""URL filter: rules, and gradient-boosted trees for the URLs that no rule judges.

Labelled URLs are those that a rule judges, those whose host holds a seed word
(blocked), and reliable negatives.  A URL without rule or seed word is open, not allowed:
trees that tell seeds from open URLs, both with equal weight, score each open URL from
the hosts of the other fold, and only those nearer to the open ones (below 0.5) are
reliable negatives; the others are left out of the training.  The trees (``pyspark.ml``) see lexical features only: lengths, depth,
digit ratio, entropy, parameter counts, and suffix statistics, the smoothed share of
blocked URLs among the rule-labelled ones with the same last, or last two, host labels.
They are fitted on at most ``sample`` URLs, a quarter each of allowed and blocked by rule,
seeds and open ones, chosen by hash (documented bound) and weighted to the share of their
kind; the statistics cover all.  Everything runs in DataFrame functions.

Defined results: a null URL, or one without ``://``, has an empty host and path, meets
no rule and is judged by the trees; repeated rows get the same verdict; if the labelled
URLs are all of one kind, so are the other verdicts; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio.llm.stages import written

SAMPLE = 20_000
SEED_WORDS = ("adult", "bets", "casino", "malware", "phish", "poker", "porn", "spam")
FEATURES = ["url_len", "host_len", "path_len", "depth", "subdomains", "digits", "host_digits",
            "entropy", "params", "query_len", "fragment", "hyphens", "last_rate", "last_n",
            "two_rate", "two_n"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule (host/path) as text, or null.  ``rules`` are pairs of
    'allow' or 'block' and host/path; a rule's host takes in its subdomains."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character of a text's character distribution."""
    n = F.length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")),
                        lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.when(
        p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(pages: DataFrame, rules, seeds: Sequence[str]) -> DataFrame:
    """page_id, url, host, path, rule, by_rule (1 blocked, 0 allowed), kind (allow or block
    by rule, seed, open) and features."""
    blocked = [r for v, r in rules if v == "block"]
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    base = base.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    seeded = F.lit(False)
    for word in seeds:
        seeded = seeded | F.contains("host", F.lit(word))
    by_rule = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocked).cast("double"))
    labels = F.split("host", r"\.")
    n = F.greatest(F.length("url"), F.lit(1))
    query = F.regexp_extract("url", r"\?([^#]*)", 1)

    def size(c: Column) -> Column:
        return F.length(c).cast("double")

    def count(c, mark: str) -> Column:
        return (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))).cast("double")

    def digits(c) -> Column:
        return F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double")

    return base.withColumns({
        "by_rule": by_rule,
        "kind": F.when(by_rule == 1, "block").when(by_rule == 0, "allow").when(
            seeded, "seed").otherwise("open"),
        "last": F.element_at(labels, -1),
        "two": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "url_len": size(F.col("url")), "host_len": size(F.col("host")),
        "path_len": size(F.col("path")), "depth": count(F.col("path"), "/"),
        "subdomains": count(F.col("host"), "."), "digits": digits("url") / n,
        "host_digits": digits("host") / F.greatest(F.length("host"), F.lit(1)),
        "entropy": entropy(F.col("url")),
        "params": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0.0),
        "query_len": size(query), "fragment": F.contains("url", F.lit("#")).cast("double"),
        "hyphens": count(F.col("host"), "-")})


def suffix_statistics(rows: DataFrame, key: str, prior: float, weight: float = 20.0):
    """Per suffix: smoothed blocked share and log count of the rule-labelled URLs."""
    return rows.filter("by_rule IS NOT NULL").groupBy(key).agg(
        ((F.sum("by_rule") + prior * weight) / (F.count(F.lit(1)) + weight))
        .alias(f"{key}_rate"), F.log1p(F.count(F.lit(1)).cast("double")).alias(f"{key}_n"))


def fitted(rows: DataFrame, trees: int, depth: int):
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                         maxIter=trees, maxDepth=depth, seed=7).fit(
        rows.coalesce(2).select("label", "weight", "features"))


def blocked_share() -> Column:
    from pyspark.ml.functions import vector_to_array
    return F.element_at(vector_to_array("probability"), 2)


def reliable(some: DataFrame, trees: int) -> DataFrame:
    """The open URLs of the sample that look more like open URLs than like seeds to trees
    that have not seen their host."""
    n = {r["kind"]: r["count"] for r in some.groupBy("kind").count().collect()}
    opened = some.filter("kind = 'open'")
    if "seed" not in n or "open" not in n:
        return opened.limit(0)
    rows = some.filter("kind IN ('seed', 'open')").withColumns({
        "label": (F.col("kind") == "seed").cast("double"),
        "weight": F.when(F.col("kind") == "seed", 1.0).otherwise(n["seed"] / n["open"])})
    out = None
    for fold in (0, 1):
        others = rows.filter(F.col("fold") != fold)
        if others.select("label").distinct().count() < 2:
            others = rows
        part = fitted(others, trees, 2).transform(opened.filter(F.col("fold") == fold)).filter(
            blocked_share() < 0.5).select(*some.columns)
        out = part if out is None else out.unionByName(part)
    return out


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]],
           seeds: Sequence[str] = SEED_WORDS, sample: int = SAMPLE, trees: int = 20,
           depth: int = 4) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, block_probability) of every page; the
    probability is null where a rule decides."""
    rows = lexical(pages, rules, seeds)
    n = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    by_rules = n.get("block", 0) + n.get("allow", 0)
    prior = n.get("block", 0) / by_rules if by_rules else 0.5
    with_stats = rows
    for key in ("last", "two"):
        stats = suffix_statistics(rows, key, prior).withColumnRenamed(key, f"_{key}")
        with_stats = (with_stats.join(stats, F.col(key) == F.col(f"_{key}"), "left")
                      .fillna({f"{key}_rate": prior, f"{key}_n": 0.0}).drop(f"_{key}"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    order = Window.partitionBy("kind").orderBy("_order")
    some = written(with_stats.select(
        "kind", F.xxhash64("url", "page_id").alias("_order"),
        F.pmod(F.xxhash64("host"), F.lit(2)).alias("fold"), *FEATURES).withColumn(
        "_rank", F.row_number().over(order)).filter(
        F.col("_rank") <= max(1, sample // 4)).drop("_rank", "_order"), "labelled-urls")
    taken = {k: min(c, max(1, sample // 4)) for k, c in n.items()}
    some = vectors.transform(some)
    weight = F.lit(1.0)
    for kind, count in n.items():
        weight = F.when(F.col("kind") == kind, count / taken[kind]).otherwise(weight)
    labelled = some.filter("kind <> 'open'").unionByName(reliable(some, trees)).withColumns({
        "label": F.col("kind").isin("block", "seed").cast("double"), "weight": weight})
    kinds = [r["label"] for r in labelled.select("label").distinct().collect()]
    wanted = ["page_id", "url", "host", "path", "rule"]
    if len(kinds) == 2:
        judged_rows = fitted(labelled, trees, depth).transform(vectors.transform(with_stats))
        guess = blocked_share()
    else:
        judged_rows, guess = with_stats, F.lit(float(kinds[0]) if kinds else 0.0)
    allowed = [r for v, r in rules if v == "allow"]
    by_trees = F.when(F.col("rule").isNull(), guess)
    return judged_rows.select(*wanted, by_trees.alias("block_probability")).withColumn(
        "verdict", F.when(F.col("rule").isin(allowed), "allow").when(
            F.col("rule").isNotNull(), "block").when(
            F.col("block_probability") >= 0.5, "block").otherwise("allow"))
