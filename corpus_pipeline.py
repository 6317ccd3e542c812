"""The corpus pipeline: drop toxic documents, exact copies and near copies, mix sources, encode.

Every stage keeps the columns of its documents as they are, whatever they are named: beside columns
that a stage adds, rows are a struct, or their columns have numbers for names. Null texts count as empty, very long ones are documents as any
others. Rows without doc_id are scored, mixed and encoded as others; among equal texts they stay only
where no row with an id does, and they are near copies of nothing. Rows that share an id are judged
by their own texts. An empty table passes all stages as one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import exact_dedup, mixing, sentencepiece_bpe, similarity, toxicity
from granary.llm.common import bound_batches, held_out, table
from granary.session import scratch, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows(docs: DataFrame, *beside) -> DataFrame:
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), *beside)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with columns named by their places, and the name of the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    plain, text = _numbered(docs)
    return toxicity.score(plain, index, text).where("score < 0.3").select(*plain.columns).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; of rows that share this id too, the one with
    the least hash of all columns."""
    found = stage(exact_dedup.deduplicate(docs).select("doc_id", "text_sha256", "kept"), "pipeline-exact")
    sha = F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)
    rows = _rows(docs, F.col("doc_id").alias("id"), sha.alias("sha"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    left = rows.join(found.where("kept").select("doc_id", "text_sha256"), same, "left_semi")
    repeated = stage(found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("n > 1 AND kept").select("doc_id", "text_sha256"), "pipeline-repeated")
    if repeated.isEmpty():
        return left.select("row.*")
    several = left.join(repeated, same, "left_semi").withColumn("hash", F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"})))
    least = several.groupBy("id", "sha").agg(F.min_by("row", "hash").alias("row"))
    return left.join(repeated, same, "left_anti").select("row.*").unionByName(least.select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles, the one with the smallest id stays; of linked texts
    that share this id, the one with the least hash."""
    found = stage(similarity.linked(docs).where("doc_id IS NOT NULL AND comp IS NOT NULL"), "pipeline-near")
    first = found.where("doc_id = component_id")
    several = first.groupBy("comp").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most")
    gone = found.where("doc_id <> component_id").select("doc_id", "text_hash").union(first.join(several, "comp").where("text_hash <> least").select("doc_id", "text_hash"))
    rows = _rows(docs, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids with begin and end, their number and the digest of what they decode to; columns of
    these names are replaced."""
    plain, text = _numbered(docs)
    found = sentencepiece_bpe.encode_column(plain, public_tokenizers.path("piece_bpe_32k.model"), text)
    added = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kept = [F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns, strict=True) if name not in added]
    return found.select(*kept, *sentencepiece_bpe.digests(found), "ids")


def _owned(step: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return step(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _owned(clean)),
    ("exact_dedup", _owned(exact)),
    ("ngram_jaccard_join", _owned(near)),
    ("mixing", _owned(mixed)),
    ("sentencepiece", _owned(encoded)),
]

#: Fitted scores, sampling by hashes and encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others wrote; what a stage wrote for itself goes when it's done."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with scratch(spark):
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
