"""Query of the quality operator."""

from pyspark.sql import functions as F

from lithic.llm.common import held_out, table
from lithic.llm.quality_gam import fit, score

MODULUS, REMAINDER = 3, 1


def op9_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels, "quality", MODULUS, REMAINDER))
    return scored.select("doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
