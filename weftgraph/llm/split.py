"""Splitting oversized texts at natural boundaries, with a given overlap.

One regular expression per (limit, overlap) consumes the text piece by piece. Its
alternatives stand in the order of the strength of the boundary they end at, each with a
bounded quantifier that takes as much as the limit leaves; the last takes characters. The
matches add up to the text, so their lengths give the cuts, and looking back from every
cut by the overlap gives the pieces. All of it runs on array functions in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import norm_key
from weftgraph.operators.skew import salted_join

# What may close a sentence, ordered as one set each.
CLOSERS = "\"'”’»)\\]】」』）》〉›"
LATIN_END = ".!?…؟۔।॥"
WIDE_END = "。！？｡…"

#: Ends of a piece, strongest first. Each begins with a check of one character, since the
#: regular expression tries it at every place it backs off to.
PARAGRAPH = r"(?<=\n)(?!\s)(?<=\n[ \t]{0,8}\r?\n)"
LINE = r"(?<=\n)(?!\s)"
SENTENCE = rf"(?:(?<=\s)(?!\s)(?<=[{LATIN_END}][{CLOSERS}]{{0,3}}\s{{1,3}})|(?<=[{WIDE_END}{CLOSERS}])(?![{WIDE_END}{CLOSERS}\s])(?<=[{WIDE_END}][{CLOSERS}]{{0,3}}))"
CLAUSE = r"(?:(?<=\s)(?!\s)(?<=[,;:،؛]\s{1,3})|(?<=[，、；：]))"
BLANK = r"(?<=\s)(?!\s)"
WHOLE_CHARACTER = r"(?![\p{M}‍️])(?<!‍)"


def piece_pattern(limit: str, lap: str) -> Column:
    """The pattern of a row, from SQL of the limit and the overlap.

    A boundary is first looked for in the upper half of the room, by strength; failing that
    anywhere, by strength; then between whole characters; then anywhere. The first piece holds
    the overlap at least, since the second looks back into it; the new text of later ones has
    the limit less the overlap as room.
    """
    bounds = [PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK]

    def room(size: Column, floor: Column) -> Column:
        floor = F.greatest(F.lit(1), floor)
        low = F.greatest(floor, (size / 2).cast("int")).cast("string")
        take = lambda lo: F.concat(F.lit(".{"), lo, F.lit(","), size.cast("string"), F.lit("}"))
        options = [F.concat(take(F.lit("1")), F.lit(r"+\z"))]
        options += [F.concat(take(low), F.lit(b)) for b in bounds]
        options += [F.concat(take(floor.cast("string")), F.lit(b)) for b in (*bounds, WHOLE_CHARACTER, "")]
        return F.concat(F.lit("(?:"), F.concat_ws("|", *options), F.lit(")"))

    return F.concat(F.lit(r"(?s)(?:\A"), room(F.expr(limit), F.expr(lap)), F.lit(r"|(?!\A)"), room(F.expr(limit) - F.expr(lap), F.lit(1)), F.lit(")"))


def split_oversized(items: DataFrame, text: str = "text", limit: str = "max_chars", overlap: str = "overlap_chars") -> DataFrame:
    """``items`` with ``pieces``: array of (piece_no, start_char, end_char, piece), in order.

    Sizes are code points. No piece is longer than ``limit``; the first begins at 0, the last
    ends at the end, and each later one begins ``overlap`` characters before its predecessor
    ends. Texts within the limit, and those with a null or non-positive limit, are one piece; a
    null text has null, an empty text no pieces. Any overlap under the limit is kept; a null or
    negative one is 0, one that isn't under the limit is the limit less one, since pieces must
    advance. Other columns stay; clashing helper names aren't used. Repeated rows stay repeated.
    """
    size, lim = F.char_length(F.col(text)), F.col(limit)
    lap = F.greatest(F.lit(0), F.least(F.coalesce(F.col(overlap), F.lit(0)), lim - 1))
    large = (lim > 0) & (size > lim)
    named = items.withColumn("_split", F.when(large, F.struct(lim.alias("room"), lap.alias("lap"))))
    pattern = piece_pattern("_split.room", "_split.lap")
    parts = F.when(F.col("_split").isNotNull(), F.regexp_extract_all(F.col(text), pattern, F.lit(0))).when(size > 0, F.array(F.col(text))).when(size == 0, F.array().cast("array<string>"))
    back = F.coalesce(F.col("_split.lap"), F.lit(0))

    def cut(parts: Column) -> Column:
        # the running ends of the parts; a part is the new text of its piece
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(part))))

        def piece(part: Column, i: Column, ends: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i) - back)
            return F.struct(i.alias("piece_no"), start.alias("start_char"), F.get(ends, i + 1).alias("end_char"), F.concat(F.substr(F.col(text), start + 1, F.get(ends, i) - start), part).alias("piece"))

        return _let(ends, lambda ends: F.transform(parts, lambda part, i: piece(part, i, ends)))

    return named.withColumn("pieces", _let(parts, cut)).drop("_split")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where plain nesting would compute it in every lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def limited_items(documents: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Documents and chunks that may exceed their limit, with it: item_type, item_id, text, max_chars, overlap_chars.

    A chunk has the source of its document. Items that are no longer than the smallest limit of
    their type can't be oversized and are left out before anything is shuffled. Sources are
    compared trimmed and upper-cased; of several limits for one source the smallest holds.
    """
    rules = limits.select(F.lower(norm_key("item_type")).alias("item_type"), norm_key("source_name").alias("_source"), "max_chars", "overlap_chars").filter("max_chars is not null").groupBy("item_type", "_source").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("rule"))
    least = {r[0]: r[1] for r in rules.groupBy("item_type").agg(F.min("rule.max_chars")).collect()}  # one row per item type
    size = F.char_length("text")
    docs = documents.filter(size > least.get("document", 2**31 - 1)).select(F.lit("document").alias("item_type"), F.col("document_id").alias("item_id"), "text", norm_key("source").alias("_source")).distinct()
    long_chunks = chunks.filter(size > least.get("chunk", 2**31 - 1)).select("chunk_id", "text", norm_key("doc_id").alias("_doc")).distinct()
    sources = documents.select(norm_key("document_id").alias("_doc"), norm_key("source").alias("_source")).filter("_doc is not null and _source is not null").distinct()
    with_source = salted_join(long_chunks, sources, ["_doc"], F.col("chunk_id"), how="inner").select(F.lit("chunk").alias("item_type"), F.col("chunk_id").alias("item_id"), "text", "_source")
    # size_limits has one row per item type and source name: a catalogue, broadcast by Spark only under its threshold
    return docs.unionByName(with_source).join(rules, ["item_type", "_source"]).select("item_type", "item_id", "text", "rule.max_chars", "rule.overlap_chars")
