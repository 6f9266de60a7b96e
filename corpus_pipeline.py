"""The training-data pipeline: each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.llm import minhash, mixing, packing, pii, toxicity
from strandline.session import dropped, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7


def drop_toxic(spark, docs, sf_dir):
    """Rows scored below TOXIC stay; the models learn from this stage's own input. Null texts and ids are scored like others."""
    return toxicity.kept(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), TOXIC)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: the one with the least id.

    Rows with a null id or without words have no copies and stay; rows that repeat an id stay or go together.
    """
    found = minhash.near_duplicates(docs)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def sanitise(spark, docs, sf_dir):
    """Personal data and disclosing terms give way to the name of their kind; n_chars follows."""
    out = pii.sanitised(pii.find(docs)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """Each row as often as the mix takes it: no, one or two times. Null ids and sources are values like others."""
    rows = mixing.mixed(docs.select(*COLUMNS)).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def pack(spark, docs, sf_dir):
    """Pieces of the mixed documents in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("drop_toxic", drop_toxic), ("near_dedup", near_dedup), ("sanitise", sanitise), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each earlier stage is written and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir))
        dropped(last)
    return STAGES[-1][1](spark, docs, sf_dir)
