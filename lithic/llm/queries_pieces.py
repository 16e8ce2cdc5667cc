"""Query of the SentencePiece operator."""

from lithic.llm.common import table
from lithic.llm.nbest_pieces import segmentations


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_nbest_pieces(spark, sf_dir):
    return segmentations(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op8_nbest_pieces": op8_nbest_pieces}
ORACLES: dict[str, str] = {}
