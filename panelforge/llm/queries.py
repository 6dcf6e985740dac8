"""The opN_ queries over the driver's tables, their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontam, linededup, neardup, packing, pii, quality, simhash, suffixtree, toxicity, urlfilter
from panelforge.llm.common import join_grouped, staged, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.line_dedup(docs)
    deleted = F.aggregate("runs_deleted", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select("doc_id", F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(F.size("runs_deleted"), F.lit(0)).cast("long").alias("n_runs"), "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("toxic", F.col("toxic_probability") >= 0.5)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = staged(simhash.document_fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    asked = F.col("doc_id") % 50 == 0
    near = simhash.near_classes(prints.select("doc_id", "fp"), prints.where(asked).select("fp"))
    out = join_grouped(prints, near, ["fp"])
    hexed = [F.lower(F.lpad(F.hex(c), 16, "0")).alias(n) for c, n in (("fp", "fingerprint"), ("edited_fp", "edited_fingerprint"))]
    found = [F.when(asked, F.col("n_within") - 1).alias("n_within"), F.when(asked, F.col("near")).alias("near_class_ids")]
    return out.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next", F.col("class").alias("class_id"), *found)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), capacity=2048)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))
    tree, counts = suffixtree.train(docs.where(~held_out))
    out = suffixtree.score(docs, tree, counts, learnt=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = decontam.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    items = F.array_sort(F.array_distinct(F.transform("items", lambda x: x.cast("string"))))
    n_hit = decontam.hit_words()
    return m.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.array_max("length"), F.lit(0)).cast("long").alias("longest_match"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("rank"), F.get(kinds, s["kind"]).alias("kind"), s["end"].alias("end")))
    rank = lambda kind: F.coalesce(F.nullif(F.array_position(kinds, kind), F.lit(0)) - 1, F.lit(len(pii.KINDS))).cast("int")
    more = F.transform("more", lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.concat(base, more)).alias("spans"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))


#: Host, path and verdict of the rules of op10_url_filters.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_toxicity, op3_document_fingerprints, op4_best_fit_packing, op5_quality_classifier, op6_minhash_near_dedup, op7_lm_scoring, op8_benchmark_decontamination, op9_pii, op10_url_filters)
}
ORACLE_SQL: dict[str, str] = {}
