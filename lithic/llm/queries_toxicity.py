"""Query of the toxicity operator."""

from pyspark.sql import functions as F

from lithic.llm.common import held_out, table
from lithic.llm.toxicity_fm import fit, score

MODULUS, REMAINDER = 5, 0


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels, "toxic", MODULUS, REMAINDER))
    return scored.select("doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
