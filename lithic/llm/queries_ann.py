"""Query of the approximate nearest-neighbour operator."""

from pyspark.sql import functions as F

from lithic.llm.common import table
from lithic.llm.lsh_multiprobe import nearest, usable

K = 5


def op2_multiprobe(spark, sf_dir):
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("id") % 50 == 0), K)


QUERIES = {"op2_multiprobe": op2_multiprobe}
ORACLES: dict[str, str] = {}
