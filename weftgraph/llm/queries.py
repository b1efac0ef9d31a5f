"""Queries p1, p4, p6, p7 and p8, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import leakage, packing, sentences, split, terms
from weftgraph.runtime import cut
from weftgraph.sources.tables import table


def _limited(spark: SparkSession, folder: str) -> DataFrame:
    return split.limited_items(table(spark, folder, "documents"), table(spark, folder, "chunks"), table(spark, folder, "size_limits"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that come out of the split with a second piece."""
    pieces = split.split_oversized(_limited(spark, folder)).select("item_type", "item_id", F.inline("pieces"))
    return pieces.filter("piece_no = 1").select("item_type", "item_id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized document and chunk."""
    oversized = _limited(spark, folder).filter(F.char_length("text") > F.col("max_chars"))
    return split.split_oversized(oversized).select("item_type", "item_id", "max_chars", "overlap_chars", F.inline("pieces"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    triples = terms.occurrences(table(spark, folder, "extracted_triples"), "extracted_triples.predicate", "predicate", "source_doc_id")
    links = terms.occurrences(table(spark, folder, "document_links"), "document_links.relationship", "relationship", "document_id")
    return terms.term_frequencies(triples.unionByName(links))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).filter("mark is not null").select("field_name", "term", "mark")


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct term with its occurrences and its number of documents."""
    return _terms(spark, folder).drop("term_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text assigned to containers of every kind, in tokens of a public multilingual vocabulary."""
    sizes = packing.count_tokens(table(spark, folder, "documents"), "doc_id", "text", packing.tokenizer_path())
    return packing.pack(sizes, table(spark, folder, "containers"))


def p1_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each item must add up to: their number, the text less the overlaps, and how many break a rule."""
    limited = _limited(spark, folder).filter(F.char_length("text") > F.col("max_chars"))
    whole = F.aggregate("pieces", F.lit(""), lambda acc, p: F.concat(acc, F.substr(p["piece"], F.char_length(acc) - p["start_char"] + 1, F.lit(2**31 - 1))))
    lap = F.greatest(F.lit(0), F.least(F.coalesce("overlap_chars", F.lit(0)), F.col("max_chars") - 1))
    laps = F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: F.get("pieces", i - 1)["end_char"] - F.get("pieces", i)["start_char"])
    return split.split_oversized(limited).select(
        "item_type", "item_id", F.char_length("text").alias("n_chars"), (whole == F.col("text")).alias("rebuilt"),
        F.size(F.filter("pieces", lambda p: (F.char_length(p["piece"]) > F.col("max_chars")) | (F.char_length(p["piece"]) == 0))).alias("wrong_sizes"),
        F.size(F.filter(laps, lambda n: n != lap)).alias("wrong_overlaps"),
    )


def p6_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What every packing must hold, per kind: nothing over capacity, cut without need or missing, and at most one container half empty or less."""
    sizes = cut(packing.count_tokens(table(spark, folder, "documents"), "doc_id", "text", packing.tokenizer_path()))
    packed = cut(packing.pack(sizes, table(spark, folder, "containers")))
    bins = packed.groupBy("container_kind", "capacity_tokens", "container_no").agg(F.sum("tokens").alias("held")).groupBy("container_kind", "capacity_tokens").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("over_capacity"), (F.count_if(F.col("held") * 2 <= F.col("capacity_tokens")) > 1).alias("loose"))
    items = packed.groupBy("container_kind", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("held"), F.count("*").alias("pieces"))
    judged = items.join(sizes.withColumnRenamed("tokens", "whole"), "doc_id").groupBy("container_kind").agg(F.count("*").alias("n_items"), F.count_if(F.col("held") != F.col("whole")).alias("wrong_sums"), F.count_if(F.col("pieces") != F.ceil(F.col("whole") / F.col("capacity_tokens"))).alias("needless_cuts"))
    return bins.join(judged, "container_kind").select("container_kind", "n_items", "over_capacity", "loose", "wrong_sums", "needless_cuts")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p6_containers(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items per document with their score, longest run and the overlap of question and answers."""
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "documents")).select("doc_id", "start_char", "end_char")


def p8_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences themselves, in order."""
    return sentences.split_sentences(table(spark, folder, "documents"), carry=True)


# ---------------------------------------------------------------- the same in SQL


def _key(c: str) -> str:
    return f"upper(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)))"


_TERM = "nullif(trim(regexp_replace(upper({}), '[^A-Z0-9]+', '_', 'g'), '_'), '')"
_TERMS = f"""
rows as (select 'extracted_triples.predicate' as f, {_TERM.format('predicate')} as term, nullif({_key('source_doc_id')}, '') as doc from (select distinct * from extracted_triples)
         union all select 'document_links.relationship', {_TERM.format('relationship')}, nullif({_key('document_id')}, '') from (select distinct * from document_links)),
freq as (select f, term, count(*) as occurrences, count(distinct doc) as documents from rows where term is not null group by all),
alldocs as (select f, count(distinct doc) as field_documents from rows where term is not null group by all),
marked as (select f as field_name, term, occurrences, documents, field_documents, case when documents = 0 then null when documents < 5 then 'rare' when documents > 0.15 * field_documents then 'common' end as mark from freq join alldocs using (f))"""

QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_rules, p4_found, p4_terms, p6_containers, p6_fill, p6_rules, p7_found, p7_report, p8_found, p8_sentences)}
SQL = {
    "p1_found": f"""with lim as (select lower({_key('item_type')}) as t, {_key('source_name')} as s, min(max_chars) as m from size_limits group by all)
        select distinct 'document' as item_type, document_id as item_id from documents d join lim on t = 'document' and s = {_key('d.source')} where length(text) > m
        union all select distinct 'chunk', c.chunk_id from chunks c join documents d on {_key('c.doc_id')} = {_key('d.document_id')} join lim on t = 'chunk' and s = {_key('d.source')} where length(c.text) > m""",
    "p1_rules": f"""with lim as (select lower({_key('item_type')}) as t, {_key('source_name')} as s, min(max_chars) as m from size_limits group by all)
        select distinct 'document' as item_type, document_id as item_id, length(text) as n_chars, true as rebuilt, 0 as wrong_sizes, 0 as wrong_overlaps from documents d join lim on t = 'document' and s = {_key('d.source')} where length(text) > m
        union all select distinct 'chunk', c.chunk_id, length(c.text), true, 0, 0 from (select distinct chunk_id, doc_id, text from chunks) c join documents d on {_key('c.doc_id')} = {_key('d.document_id')} join lim on t = 'chunk' and s = {_key('d.source')} where length(c.text) > m""",
    # texts of blanks have tokens too; a text without characters has none
    "p6_rules": "select container_kind, (select count(*) from documents where text <> '') as n_items, 0 as over_capacity, false as loose, 0 as wrong_sums, 0 as needless_cuts from containers where capacity_tokens > 0 group by 1",
    "p4_found": f"with {_TERMS} select field_name, term, mark from marked where mark is not null",
    "p4_terms": f"with {_TERMS} select * from marked",
}
