"""Query of the subword operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.llm.common import table
from seqweft.llm.pieces import encode_decode
from seqweft.llm.registry import query

MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@query("op7_sentencepiece")
def sentencepiece_round_trip(spark, sf):
    out = encode_decode(table(spark, sf, "documents").select("doc_id", "text"), model_path())
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
