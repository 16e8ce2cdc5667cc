"""Query of the personal-data operator."""

from lithic.llm.common import table
from lithic.llm.pii_weak import find, fit


def op5_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
