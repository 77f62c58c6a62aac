"""Naive Bayes over categorical features, with all kinds of features pooled for normalisation and the prior weighted by its fourth power.

A model is a table, kept with save() and read with load(). Results for odd input: null labels and features don't count; an item all of whose features are null or unknown has the prior's probability; an empty
table trains a model without rows, which classifies nothing; other columns aren't read. Training is one aggregation: p(feature | label) = (count + 0.1) / (features of the label + 0.1 distinct features); scoring is a join and a sum of logarithms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMOOTH, PRIOR_POWER = 0.1, 4


def train(features: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """features (label 0/1, feat) as the model (feat, p0, p1); the row of the null feature holds the priors."""
    counts = features.where("label is not null and feat is not null").groupBy("feat").agg(*(F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"c{k}") for k in (0, 1)))
    return _model(counts, smooth)


def _model(counts: DataFrame, smooth: float) -> DataFrame:
    totals = counts.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.count("*").alias("kinds"))
    # One row.
    smoothed = totals.select(*((F.col(f"n{k}") + smooth * F.col("kinds")).alias(f"t{k}") for k in (0, 1)))
    each = counts.crossJoin(F.broadcast(smoothed)).select("feat", *(((F.col(f"c{k}") + smooth) / F.col(f"t{k}")).alias(f"p{k}") for k in (0, 1)))
    total = F.col("t0") + F.col("t1")
    return each.unionByName(smoothed.where("t0 + t1 > 0").select(F.lit(None).cast("string").alias("feat"), (F.col("t0") / total).alias("p0"), (F.col("t1") / total).alias("p1")))


def classify(items: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """items (key, feat) as (key, p1): the probability of label 1; features that the model lacks don't count."""
    log = lambda c: F.ln(F.col(c))
    prior = model.where("feat is null").select((PRIOR_POWER * log("p0")).alias("b0"), (PRIOR_POWER * log("p1")).alias("b1"))
    known = model.where("feat is not null").select("feat", log("p0").alias("l0"), log("p1").alias("l1"))
    sums = items.join(known, "feat", "left").groupBy(key).agg(*(F.coalesce(F.sum(f"l{k}"), F.lit(0.0)).alias(f"s{k}") for k in (0, 1)))
    odds = F.col("s0") + F.col("b0") - F.col("s1") - F.col("b1")
    return sums.crossJoin(F.broadcast(prior)).select(key, (1 / (1 + F.exp(odds))).alias("p1"))


def save(model: DataFrame, folder: str) -> None:
    model.write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The model; ValueError where the folder holds another table."""
    model = spark.read.parquet(folder)
    if [c for c, _ in model.dtypes] != ["feat", "p0", "p1"]:
        raise ValueError(f"{folder} holds no model")
    return model


def _cleaned(word: Column) -> Column:
    """Numbers as <NUM>, other signs than points, hyphens and apostrophes dropped."""
    out = F.regexp_replace(word, r"[.,\d]*\d", "<NUM>")
    return F.regexp_replace(out, r"[^a-zA-Z0-9.<>\-' ]", "")


def boundary_features(pairs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """pairs (key columns, word, next) as (key columns, feat): what a possible sentence end looks like from the word with the full stop and the one after it.

    counts (word, non_abbr, lower): how often a word stands without a final full stop, and in lower case."""
    keys = [c for c in pairs.columns if c not in ("word", "next")]
    # After the last hyphen of the first word, before the first hyphen of the second.
    c1, c2 = F.regexp_replace(_cleaned(F.coalesce("word", F.lit(""))), r"^.+?-", ""), F.regexp_replace(_cleaned(F.coalesce("next", F.lit(""))), r"-.+?$", "")
    rows = pairs.select(*keys, c1.alias("c1"), c2.alias("c2"))
    if counts is not None:
        rows = rows.withColumn("_k1", F.expr("substring(c1, 1, length(c1) - 1)")).withColumn("_k2", F.lower("c2"))
        rows = rows.join(counts.select(F.col("word").alias("_k1"), "non_abbr"), "_k1", "left").join(counts.select(F.col("word").alias("_k2"), "lower"), "_k2", "left")
    else:
        rows = rows.withColumn("non_abbr", F.lit(0)).withColumn("lower", F.lit(0))
    alpha = lambda c: F.replace(F.col(c), F.lit("."), F.lit("")).rlike(r"^\p{L}+$")
    logged = lambda c: F.floor(F.ln(1 + F.coalesce(c, F.lit(0)))).cast("string")
    upper = F.when(F.left("c2", F.lit(1)).rlike(r"^\p{Lu}"), "True").otherwise("False")
    named = [
        F.concat(F.lit("w1_"), "c1"), F.concat(F.lit("w2_"), "c2"), F.concat(F.lit("both_"), "c1", F.lit("_"), "c2"),
        F.when(alpha("c1"), F.concat(F.lit("w1length_"), F.least(F.lit(10), F.length(F.regexp_replace("c1", r"\W", ""))).cast("string"))), F.when(alpha("c1"), F.concat(F.lit("w1abbr_"), logged("non_abbr"))),
        F.when(alpha("c2"), F.concat(F.lit("w2cap_"), upper)), F.when(alpha("c2"), F.concat(F.lit("w2lower_"), logged("lower"))), F.when(alpha("c2"), F.concat(F.lit("w1w2upper_"), "c1", F.lit("_"), upper)),
    ]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*named))).alias("feat"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, non_abbr, lower) over all documents with ``words``: non_abbr counts a word that no full stop follows."""
    # An outer explode, as another one has the texts cut into tokens once more for its condition.
    each = docs.select("words", F.posexplode_outer("words").alias("i", "w")).where("i is not null").select("w", F.get("words", F.col("i") + 1).alias("next"))
    counts = each.groupBy(F.col("w").alias("word")).agg(F.sum(F.when(F.col("next").eqNullSafe("."), 0).otherwise(1)).alias("non_abbr"), F.count("*").alias("n"))
    lower = (F.lower("word") == F.col("word")) & (F.upper("word") != F.col("word"))
    return counts.select("word", "non_abbr", F.when(lower, F.col("n")).otherwise(0).alias("lower"))


def boundary_pairs(boundaries: DataFrame, counts: DataFrame, sums: list[Column]) -> DataFrame:
    """boundaries (word, next, ...) as (pair, feat, and sums): what stands around a boundary has the same features wherever it stands, so these are made, and joined to the counts, once for each distinct pair."""
    pairs = boundaries.groupBy("word", "next").agg(*sums)
    return boundary_features(pairs.withColumn("pair", F.struct("word", "next")), counts)


def train_pairs(features: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """train() of features (feat, n0, n1, n_labels) that stand for so many of label 0, of label 1 and of any; those of no label don't count."""
    return _model(features.where("n_labels > 0").groupBy("feat").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1")), smooth)
