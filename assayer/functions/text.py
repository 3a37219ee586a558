"""Texts: n-grams and BLEU as joins, ranks, scripts, secrets, previews, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.verdicts import strip

# Names and forms of secrets that must not be published.
SECRETS = {
    "OpenAI-style key": r"\b(?:sk|rk|pk)-[A-Za-z0-9_-]{32,}\b",
    "GitHub token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    "AWS access key": r"\bAKIA[0-9A-Z]{16}\b",
    "Hugging Face token": r"\bhf_[A-Za-z0-9]{30,}\b",
}


def tokens(text: Column) -> Column:
    """Lower-cased runs between white space."""
    return F.filter(F.split(F.lower(strip(text)), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    many = F.size(words) - (n - 1)
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array())


def ngram_counts(df: DataFrame, key: str, text: str, most: int = 4) -> DataFrame:
    """(key, n, gram, times)."""
    words = df.select(key, tokens(F.col(text)).alias("_w"))

    def of(n: int) -> Column:
        return F.transform(ngrams(F.col("_w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    grams = F.flatten(F.array(*map(of, range(1, most + 1))))
    return words.select(key, F.explode(grams).alias("g")).groupBy(key, F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count("*").alias("times"))


def bleu_counts(df: DataFrame, key: str, hypothesis: str, reference: str, most: int = 4) -> DataFrame:
    """(key, n, clipped, total): n-grams of the hypothesis and how many the reference covers."""
    own, other = ngram_counts(df, key, hypothesis, most), ngram_counts(df, key, reference, most).withColumnRenamed("times", "most")
    met = own.join(other, [key, "n", "gram"], "left")
    return met.groupBy(key, "n").agg(F.sum(F.least("times", F.coalesce("most", F.lit(0)))).alias("clipped"), F.sum("times").alias("total"))


def bleu(df: DataFrame, key: str, hypothesis: str, reference: str, most: int = 4) -> DataFrame:
    """(key, bleu) with the brevity penalty and no smoothing: any order without a match gives 0."""
    share = bleu_counts(df, key, hypothesis, reference, most).groupBy(key).agg(
        F.when((F.count("*") == most) & (F.min("clipped") > 0), F.exp(F.avg(F.log(F.nullif("clipped", F.lit(0)) / F.col("total"))))).alias("share")
    )
    sizes = df.select(key, F.size(tokens(F.col(hypothesis))).alias("h"), F.size(tokens(F.col(reference))).alias("r"))
    penalty = F.least(F.lit(1.0), F.exp(1 - F.try_divide(F.col("r"), F.col("h"))))
    return sizes.join(share, key, "left").select(key, F.coalesce(penalty * F.col("share"), F.lit(0.0)).alias("bleu"))


def spearman(df: DataFrame, group: str, x: str, y: str, position: str) -> DataFrame:
    """(group, n, rho): ranks by value then position, nulls last, ties not averaged; null under three rows.

    Ranks are subtracted as long; sums of squares and cubes of ``n`` are decimals, exact for groups of any size.
    """

    def rank(c: str) -> Column:
        return F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last(c), F.asc_nulls_last(position))).cast("long")

    apart, n = F.col("rx") - F.col("ry"), F.count("*")
    d2, whole = F.sum((apart * apart).cast("decimal(19,0)")), n.cast("decimal(10,0)")
    rho = 1 - 6 * d2.cast("double") / (whole * (whole * whole - 1)).cast("double")
    return df.select(group, rank(x).alias("rx"), rank(y).alias("ry")).groupBy(group).agg(n.alias("n"), F.when(n >= 3, rho).alias("rho"))


def has_script(text: Column, first: str = "가", last: str = "힣") -> Column:
    return text.rlike(f"[{first}-{last}]")


def secrets(text: Column) -> Column:
    """Names of the secret forms that occur, in the order of ``SECRETS``."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in SECRETS.items())))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def truncated_messages(messages: Column, most: int) -> Column:
    """A list of messages (role, content) with contents cut for a log."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), truncated(m["content"], most).alias("content")))


def fingerprint(**parts: Column) -> Column:
    """SHA-256 of compact JSON with keys in order and nulls written out."""
    ordered = F.struct(*(parts[k].alias(k) for k in sorted(parts)))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def safe_name(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))
