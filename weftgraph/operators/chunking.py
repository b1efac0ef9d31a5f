"""Texts to overlapping windows of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text and between sentences.
WS = r"[\s\p{Z}]"


def split_sentences(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, sentence): cut at white space after ``.``, ``!`` or ``?``; blanks dropped, ``pos`` from 0.

    Null and blank texts have no sentences.
    """
    trimmed = F.regexp_replace(F.col(text_col), rf"^{WS}+|{WS}+$", "")
    parts = F.filter(F.split(trimmed, rf"(?<=[.!?]){WS}+"), lambda s: F.regexp_replace(s, rf"{WS}+", "") != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("pos", "sentence"))


def windows(sentences: DataFrame, size: int = 3, step: int = 1, part: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, seq, text): ``size`` neighbouring sentences joined by a blank, every ``step`` sentences.

    A text of at most ``size`` sentences is one window; where the steps don't reach the last
    sentence, a window over the last ``size`` sentences follows. ``part`` names the columns that
    tell texts apart. One shuffle on the text; a window only looks ``size - 1`` rows ahead.
    """
    w = Window.partitionBy(*part).orderBy("pos")
    n = F.count("*").over(Window.partitionBy(*part))
    ahead = [F.col("sentence"), *[F.lead("sentence", i).over(w) for i in range(1, size)]]
    last = F.col("_n") - size
    starts = (F.col("_n") <= size) & (F.col("pos") == 0) | (F.col("_n") > size) & (F.col("pos") <= last) & ((F.col("pos") % step == 0) | (F.col("pos") == last))
    rows = sentences.withColumn("text", F.concat_ws(" ", *ahead)).withColumn("_n", n).filter(starts)
    seq = F.when(F.col("pos") % step == 0, F.col("pos") / step).otherwise(F.floor(F.col("pos") / step) + 1).cast("int")
    return rows.select(*part, seq.alias("seq"), "text")


def chunk_corpus(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", size: int = 3, step: int = 1) -> DataFrame:
    """(chunk_id, doc_id, seq, text) of all texts; ids are ``<doc>#c<seq>``. Repeated documents count once."""
    once = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull()).distinct()
    return windows(split_sentences(once, id_col, text_col), size, step).select(F.concat("doc_id", F.lit("#c"), F.col("seq").cast("string")).alias("chunk_id"), "doc_id", "seq", "text")
