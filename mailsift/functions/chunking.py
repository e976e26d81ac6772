"""The chunk table of a mail table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from .text import chunks, header_text


def chunk_table(mail: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                max_chunks: int | None = None) -> DataFrame:
    """(no, chunk_id, section, chunk_text): one header chunk and the body chunks of every mail.

    All chunks of a body are kept unless `max_chunks` is given.  The pieces are cut inside the row: no shuffle.
    """
    def piece(name, text):
        return F.struct(name.alias("section"), text.alias("chunk_text"))

    header = header_text([F.col("subject"), F.col("sendername"), F.col("company_name")], size)
    body = F.transform(chunks(F.col("plaintextbody"), size, overlap, max_chunks), lambda text, i: piece(
        F.concat(F.lit("body_"), i.cast("string")), text))
    pieces = F.filter(F.concat(F.array(piece(F.lit("header"), header)), body), lambda p: p["chunk_text"] != "")
    return (mail.select("no", F.explode(pieces).alias("piece"))
            .select("no", F.concat_ws("_", "no", "piece.section").alias("chunk_id"), "piece.section",
                    "piece.chunk_text"))
