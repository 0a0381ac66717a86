"""Queries of the operators that learn from labelled rows, and of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import language, pii, toxicity
from claimlake.llm.common import query, table


@query("op4_language_id")
def identify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.remainder("doc_id", 4) == 2
    model = language.Model(language.sample(docs.filter(~held_out).select("doc_id", "text", "lang")))
    found = language.identify(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_toxicity")
def score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language.remainder("doc_id", 5) == 0
    model = toxicity.fit(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score_documents(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op10_personal_data")
def find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
