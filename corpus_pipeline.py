"""The corpus pipeline: quality, toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.jaccard import similar_groups
from assayer.llm.packing import pack
from assayer.llm.quality_model import weak_quality
from assayer.llm.suffixes import without_repeats
from assayer.llm.tables import materialize, read
from assayer.llm.toxicity import held_out, toxicity


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that no name of a caller meets one of an operator."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []))


def _whole(out: DataFrame, docs: DataFrame, rest: str = "rest", **own: Column) -> DataFrame:
    """The columns of ``docs`` again; ``own`` ones take the place of those they name."""
    columns = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"{rest}.`{c}`") for c in docs.columns}
    return out.select(*(c.alias(n) for n, c in (columns | own).items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model scores 0.5 or more.

    Null text counts as empty; repeated rows and rows without an id are judged each for itself. An empty table stays empty.
    """
    return _whole(weak_quality(_bare(docs), carry=True).where("quality_score >= 0.5"), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores below 0.3.

    Null and empty texts score 0 and stay; repeated rows and rows without an id are judged each for itself.
    """
    labels = read(spark, sf_dir, "labels").where(~held_out())
    return _whole(toxicity(_bare(docs), labels, carry=True).where("toxicity_score < 0.3"), docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Null and empty texts are near copies of nothing. Rows without an id stay; rows that repeat an id stay or go together.
    """
    dropped = similar_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur elsewhere, every document stays; ``n_chars`` follows the text.

    Null text becomes empty, a null ``n_chars`` stays null. Repeated rows count each for itself, so copies of 200 bytes or more empty each other.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = without_repeats(docs, carry=rest, as_text=True)
    text, own = F.col("kept"), {}
    if "n_chars" in rest:
        own["n_chars"] = F.when(F.col("carried.n_chars").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType))
    return _whole(out, docs, "carried", text=text, **own)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 2048 tokens and their place in sequences.

    Null text counts as empty, one piece; repeated rows and rows without an id are packed each for itself.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("suffix-array dedup", unrepeated),
    ("best-fit packing", packed),
]

#: No stage but the third can be put in SQL; ``tests/llm/test_pipeline.py`` runs each stage, and ``run``, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
