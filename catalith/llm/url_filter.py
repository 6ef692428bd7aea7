"""URL filter: allow and block rules, and gradient-boosted trees for the rest.

DataFrame and SQL functions build the features and Spark ML grows the trees,
all of it in the JVM. Labelled URLs come from the rules: a URL that a rule
fits carries that rule's verdict as its label. Every URL that no rule fits
gets the trees' verdict.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameter counts, and statistics of the host's suffix: how often it occurs among
all URLs, and its smoothed share of blocked labels among all labelled URLs. A row
that teaches has the share of the other folds' labels, so no label is a feature of
its own row. The trees are fitted on a bounded sample of the labelled (`max_rows`).

Defined results: a null URL or one without "://" has an empty host and path
and no rule; with no labelled URL of one of the two classes there is nothing
to learn, and the only known class (or "allow") is the verdict; repeated rows
are judged one by one; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from catalith.llm.common import load

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_parameters", "f_hyphens", "f_query", "f_suffix_count", "f_suffix_block"]


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits (ties: by text).
    `rules` is a configured list of bounded length, compiled into one expression."""
    host, path = F.col("host"), F.col("path")

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    return urls.withColumns({
        "rule": F.coalesce(*[F.when(fits(r), F.lit(r)) for r, _ in ordered], F.lit(None).cast("string")),
        "rule_verdict": F.coalesce(*[F.when(fits(r), F.lit(v)) for r, v in ordered], F.lit(None).cast("string")),
    })


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """Adds the lexical features of every URL and its host suffix."""
    u = F.coalesce(F.col(url), F.lit(""))
    size = F.length(u).cast("double")
    kept = lambda pattern: F.length(F.regexp_replace(u, pattern, "")).cast("double")
    entropy = F.aggregate(
        F.array_distinct(F.split(u, "")),
        F.lit(0.0),
        lambda acc, c: acc + F.when(c == "", 0.0).otherwise((n := size - F.length(F.replace(u, c, F.lit("")))) / size * F.log2(size / n)),
    )
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "f_length": size,
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_depth": kept("[^/]"),
        "f_labels": (F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))).cast("double"),
        "f_digits": kept("[^0-9]") / F.greatest(size, F.lit(1.0)),
        "f_entropy": F.coalesce(entropy, F.lit(0.0)),
        "f_parameters": F.when(query == "", 0.0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1.0),
        "f_hyphens": kept("[^-]"),
        "f_query": F.length(query).cast("double"),
    })


def suffix_statistics(features: DataFrame, prior: float = 8.0) -> DataFrame:
    """For each host suffix and each fold of URLs (FOLDS: none left out): log count among all
    URLs, and the share of blocked labels outside the fold, shrunk to one half."""
    sums = [F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")]
    folds = features.groupBy("suffix", "fold").agg(*sums)
    total = folds.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "known", "bad")])
    every = folds.select("suffix", "fold", "known", "bad").unionByName(total.select("suffix", F.lit(FOLDS).alias("fold"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("bad")))
    known, bad = F.col("all_known") - F.col("known"), F.col("all_bad") - F.col("bad")
    return every.join(total, "suffix").select("suffix", "fold", F.log1p("all_n").alias("f_suffix_count"), ((bad + prior / 2) / (known + prior)).alias("f_suffix_block"))


def with_suffix(features: DataFrame, statistics: DataFrame) -> DataFrame:
    return features.join(statistics, ["suffix", "fold"])


def teaching(labelled: DataFrame, max_rows: int) -> DataFrame:
    """url: at most max_rows distinct URLs, those of the smallest hashes."""
    return labelled.select("url").distinct().orderBy(F.xxhash64("url", F.lit("teach")), "url").limit(max_rows)


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_rows: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7) -> DataFrame:
    """One row for each input row: id, host, path, rule, verdict, score (the trees'
    probability of "block"; null where there was nothing to learn).

    max_rows bounds the distinct labelled URLs that the trees are grown on, those of
    the smallest hashes, however many rows share one. Everything else covers all rows."""

    def described(urls: DataFrame) -> DataFrame:
        parts = urls.withColumns({"host": host_of("url"), "path": path_of("url")})
        return lexical(apply_rules(parts, rules), "url").withColumns({
            "label": (F.col("rule_verdict") == "block").cast("double"),
            "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"),
        })

    features = described(pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")))
    labelled = features.where(F.col("rule").isNotNull())
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows at most
    out = [id_col, "host", "path", "rule", "verdict", "score"]
    if len(counts) < 2:
        only = "block" if 1.0 in counts else "allow"
        return features.withColumns({"verdict": F.coalesce("rule_verdict", F.lit(only)), "score": F.lit(None).cast("double")}).select(out)
    statistics = suffix_statistics(features)
    sample = described(teaching(labelled, max_rows))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all").fit(vector.transform(with_suffix(sample, statistics)).select("features", "label"))
    from pyspark.ml.functions import vector_to_array

    judged = model.transform(vector.transform(with_suffix(features.withColumn("fold", F.lit(FOLDS)), statistics)))
    score = vector_to_array("probability")[1]
    return judged.withColumns({"score": score, "verdict": F.coalesce("rule_verdict", F.when(score >= 0.5, "block").otherwise("allow"))}).select(out)


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(load(spark, sf_dir, "pages"))


