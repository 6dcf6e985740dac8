"""Raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the
shared folder and reads back as the next one's docs. All stages but the last return the columns of
documents, further ones included, whatever their names.

In every stage a null text is an empty one and an empty table gives an empty result. Rows with a null doc_id are
judged by their texts where a stage judges texts, and stay where it compares documents. Repeated rows are one
document: they stay or go together. Very long texts are worked on whole. doc_id is a whole number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontam, linededup, neardup, packing, toxicity
from panelforge.llm.common import release, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a probability of 0.5 or more of being toxic go. Null and empty texts have what the model gives to
    texts without evidence; without toxic or clean labels nothing is learnt and all stay. Equal texts are judged alike."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages go, the first by doc_id and place stays; a document of which nothing but white
    space is left goes with them. n_chars is counted anew where text has changed. Documents without text, and rows
    with a null doc_id, stay as they are."""
    out = linededup.line_dedup(docs)
    runs = F.col(f"`{out.columns[-1]}`")  # its name depends on those of docs
    gone = runs.isNotNull() & (F.length(F.regexp_replace("text", r"\s+", "")) == 0)
    out = out.where(~gone).withColumn("n_chars", F.when(runs.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more) the document with the
    smallest id stays. Documents without words are nobody's copies and stay, as do rows with a null doc_id."""
    drop = neardup.near_duplicates(docs, shingle=5, num=80, den=100).where("not kept").select(F.col("doc_id").alias("__drop"))
    return docs.join(drop, docs["doc_id"] == F.col("__drop"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter one, go. Documents without words,
    and all where the benchmark is empty, stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets, one row per piece of every row of docs; a document without text is
    one token. Equal pieces are told apart by doc_id, piece and place only."""
    return packing.best_fit_packing(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("near-dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages learn, hash and tokenise; SQL cannot express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return docs
