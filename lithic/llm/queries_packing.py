"""Query of the packing operator."""

from lithic.llm.common import table
from lithic.llm.packing import pack_documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
