"""Training-data pipeline: language, toxicity, near copies, repeated passages, packing.

``STAGES`` are (name, function) pairs in order.  Each function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last keep the columns of ``documents``.  ``run`` writes each
stage's rows into the shared checkpoint folder and reads them back for the next.

Defined results: documents whose language is undecided, or too far from every learned profile,
go, and so do those that the classifier calls toxic (score at least 0.7); of documents linked by
their shingles one row stays, of the smallest doc_id (a null one comes last), and rows without a
shingle all stay, whatever doc_id they share with others; the repeat
cutter keeps every document, with what is left of its text, and adjusts ``n_chars``; null text
stays null up to the language stage, which has no language for it.  Extra columns travel along.

The stages pass whole documents through Arrow, so each one lowers the session's
``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``shared.BATCH_ROWS`` rows if it is larger: a
batch is held in the executor and in its Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlease.llm import jaccard, language, packing, suffix, toxicity
from fairlease.llm.queries import tokenizer_file
from fairlease.llm.shared import bound_batches, stage_table, table

#: Below this likeness to the nearest profile a text is in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.2
TOXIC_SCORE = 0.7


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    s = language.Settings()
    profiles = language.learn_profiles(docs.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), s)
    scored = language.predict(docs.select("text", F.struct("*").alias("row")), profiles, ["row"], s)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs.select("doc_id", "text"), labels, toxicity.Settings())
    scored = toxicity.score(docs.select("text", F.struct("*").alias("row")), model, ["row"])
    return scored.where(F.col("score") < TOXIC_SCORE).select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    kept = jaccard.first_of_components(docs.select("doc_id", "text")).select(F.col("name").alias("kept"), F.col("doc_id").alias("kept_id"))
    rows = jaccard.named_rows(docs)
    stay = rows.where("name <> 0").join(kept, (F.col("name") == F.col("kept")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    once = Window.partitionBy("name").orderBy(F.xxhash64("row.text"))
    single = stay.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
    return single.unionByName(rows.where("name = 0").select("row.*"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    rows = suffix.cleaned_rows(docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else rows


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near copies", keep_one_of_near_copies),
    ("repeated passages", cut_repeated_passages),
    ("packing", pack),
]

#: The classifier, the packing and the tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
