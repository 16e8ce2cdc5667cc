"""Query of the SimHash operator."""

from pyspark.sql import functions as F

from lithic.llm.common import table
from lithic.llm.simhash_golay import near_duplicates


def op7_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
