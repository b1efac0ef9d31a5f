"""Frequency of every distinct term: global integer dictionary and blockwise count arrays.

Values become terms, terms get dense integers, and occurrences and document presence are
accumulated in arrays over blocks of identifiers, which are then summed by identifier range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import real_key
from weftgraph.operators.skew import salted_join
from weftgraph.runtime import cut, shuffle_partitions

#: Identifiers in a block.
BLOCK = 1024
#: Blocks that a task holds at most before it hands its counts on (64 MB).
HELD = 4096
#: Dictionaries up to this many terms are broadcast (about 20 MB); larger ones are joined by shuffle.
BROADCAST_TERMS = 200_000


def term(c: Column | str) -> Column:
    """Upper case, runs of other characters than A-Z and 0-9 as one underscore, none at the ends; empty is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), "^_|_$", ""), F.lit(""))


def occurrences(rows: DataFrame, field: str, value: str, doc: str) -> DataFrame:
    """(field_name, term, doc, n): how often each term occurs in each document; a repeated row counts once.

    Rows are compared over all their columns by two 64-bit hashes. Null and empty terms are left
    out; rows without a document (null or blank) have a null doc.
    """
    every = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in every])
    keyed = rows.select(F.lit(field).alias("field_name"), term(value).alias("term"), real_key(doc).alias("doc"), F.xxhash64(nulls, *every).alias("h1"), F.xxhash64(F.lit("second"), *reversed(every), nulls).alias("h2"))
    return keyed.filter("term is not null").distinct().groupBy("field_name", "term", "doc").agg(F.count("*").alias("n"))


def dictionary(terms: DataFrame) -> tuple[DataFrame, int]:
    """Distinct (field_name, term) → dense ``id`` from 0 in the order of field and term, and their number.

    Terms are range-partitioned and numbered inside their partition; the partition sizes, one
    number each, give the offsets. The numbered terms are checkpointed before the sizes are read,
    so both see the same partitions.
    """
    spark = terms.sparkSession
    ordered = terms.select("field_name", "term").distinct().repartitionByRange(shuffle_partitions(spark), "field_name", "term").sortWithinPartitions("field_name", "term")
    numbered = cut(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"))
    sizes = {r[0]: r[1] for r in numbered.groupBy("_part").count().collect()}  # one row per partition
    offsets, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(part, 0)
    start = F.get(F.array(*[F.lit(o).cast("bigint") for o in offsets]) if offsets else F.array().cast("array<bigint>"), F.col("_part"))
    return numbered.select("field_name", "term", (start + F.col("_row")).alias("id")), total


def _emit(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    blocks, slots, occ, docs = [], [], [], []
    for block, counts in held.items():
        at = np.flatnonzero(counts[0])
        blocks.append(block)
        slots.append(at.astype(np.int32))
        occ.append(counts[0, at])
        docs.append(counts[1, at])
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(slots, pa.list_(pa.int32())), pa.array(occ, pa.list_(pa.int64())), pa.array(docs, pa.list_(pa.int64()))], ["block", "slots", "occ", "docs"])


_BLOCKS = "block bigint, slots array<int>, occ array<bigint>, docs array<bigint>"


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, docs) rows → count arrays per block, of the slots that occur."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, n, docs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "docs"))
        block, slot = ids // BLOCK, ids % BLOCK
        order = np.argsort(block, kind="stable")
        block, slot, n, docs = block[order], slot[order], n[order], docs[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(block)]):
            if lo == hi:
                continue
            counts = held.setdefault(int(block[lo]), np.zeros((2, BLOCK), np.int64))
            np.add.at(counts[0], slot[lo:hi], n[lo:hi])
            np.add.at(counts[1], slot[lo:hi], docs[lo:hi])
        if len(held) > HELD:
            yield _emit(held)
            held = {}
    if held:
        yield _emit(held)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count arrays sorted by block → (id, occurrences, documents)."""

    def rows() -> pa.RecordBatch:
        at = np.flatnonzero(total[0])
        return pa.RecordBatch.from_arrays([pa.array(current * BLOCK + at, pa.int64()), pa.array(total[0, at]), pa.array(total[1, at])], ["id", "occurrences", "documents"])

    current, total = None, np.zeros((2, BLOCK), np.int64)
    for batch in batches:
        for i, block in enumerate(batch.column("block").to_pylist()):
            if block != current:
                if current is not None:
                    yield rows()
                current, total = block, np.zeros((2, BLOCK), np.int64)
            at = batch.column("slots")[i].values.to_numpy()
            total[0, at] += batch.column("occ")[i].values.to_numpy()
            total[1, at] += batch.column("docs")[i].values.to_numpy()
    if current is not None:
        yield rows()


def term_frequencies(counts: DataFrame, rare_below: int = 5, common_above: float = 0.15) -> DataFrame:
    """Rows of ``occurrences`` → field_name, term_id, term, occurrences, documents, field_documents, mark.

    ``documents`` counts distinct documents, so rows without one add to ``occurrences`` only.
    ``mark`` is rare for terms in fewer than ``rare_below`` documents, else common for terms in
    more than the share ``common_above`` of the documents that hold any term of the field, else
    null. A term that stands in rows without a document only is in no document and has no mark.
    Empty input gives no rows.
    """
    # summed again, so that counts of several deliveries of the same pair meet; cut because three plans read it
    counts = cut(counts.groupBy("field_name", "term", "doc").agg(F.sum("n").alias("n")))
    ids, total = dictionary(counts)
    weights = counts.select("field_name", "term", "doc", F.col("n"), F.when(F.col("doc").isNull(), 0).otherwise(1).cast("bigint").alias("docs"))
    if total <= BROADCAST_TERMS:
        encoded = weights.join(F.broadcast(ids), ["field_name", "term"])
    else:
        encoded = salted_join(weights, ids, ["field_name", "term"], F.coalesce("doc", F.lit("")), how="inner")
    blocks = encoded.select("id", "n", "docs").mapInArrow(_accumulate, _BLOCKS)
    summed = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "id bigint, occurrences bigint, documents bigint")
    field_docs = counts.filter("doc is not null").select("field_name", "doc").distinct().groupBy("field_name").agg(F.count("*").alias("field_documents"))
    marked = ids.join(summed, "id").join(F.broadcast(field_docs), "field_name", "left").withColumn("field_documents", F.coalesce("field_documents", F.lit(0).cast("bigint")))  # one row per field
    mark = F.when(F.col("documents") == 0, None).when(F.col("documents") < rare_below, "rare").when(F.col("documents") > F.col("field_documents") * common_above, "common")
    return marked.select("field_name", F.col("id").alias("term_id"), "term", "occurrences", "documents", "field_documents", mark.alias("mark"))
