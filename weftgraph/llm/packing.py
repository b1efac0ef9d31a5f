"""Filling fixed-capacity containers: global best-fit decreasing over the whole corpus.

Best-fit decreasing looks at sizes only, and sizes are whole tokens up to the capacity. So
the packing is planned on the histogram of sizes, whose length the capacity bounds: items
of one size and bins with one remaining capacity are handled as ranges, and a segment tree
over the remaining capacities finds the tightest open bins in logarithmic time. The plan is
exactly the packing that the item-by-item run would give. Items get their rank within
their size in the cluster and find their container in the plan.
"""

from __future__ import annotations

import base64
import importlib.util
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.runtime import cut

#: Ranks are numbered in groups of about this many items.
GROUP_ROWS = 250_000
#: Segments of one size in a bucket, by which items find theirs when the plan is joined by shuffle.
RANKS = 4096
#: Plans up to this many segments (48 bytes each, so 10 MB) are broadcast; larger ones are joined by
#: shuffle. A plan has at most about 1.5 x capacity squared segments and usually two or three per size.
BROADCAST_SEGMENTS = 200_000


class SegmentTree:
    """Which remaining capacities have open bins; the least one from a size on, in logarithmic time."""

    def __init__(self, capacity: int):
        self.width = 1
        while self.width <= capacity:
            self.width *= 2
        self.any = [False] * (2 * self.width)

    def set(self, value: int, open_: bool) -> None:
        i = value + self.width
        self.any[i] = open_
        while i > 1:
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def least_from(self, value: int) -> int | None:
        i = value + self.width
        if self.any[i]:
            return value
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (size, rank_from, rank_to, first_bin, per_bin) and the number of bins.

    Items of ``size`` with ranks in [rank_from, rank_to) go to the bins from ``first_bin`` on,
    ``per_bin`` to each. Sizes must lie in 1..capacity.
    """
    tree, open_bins, bins = SegmentTree(capacity), [deque() for _ in range(capacity + 1)], 0
    segments: list[tuple[int, int, int, int, int]] = []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            if not open_bins[remaining]:
                tree.set(remaining, True)
            open_bins[remaining].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, count = 0, counts[size]
        while rank < count:
            room = tree.least_from(size)
            if room is None:
                room, first, n = capacity, bins, -(-(count - rank) // (capacity // size))
                bins += n
            else:
                first, n = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.set(room, False)
            per_bin = room // size
            full = min(n, (count - rank) // per_bin)
            if full:
                segments.append((size, rank, rank + full * per_bin, first, per_bin))
                rank += full * per_bin
                put(room - per_bin * size, first, full)
            rest = count - rank
            if full < n:
                if 0 < rest < per_bin:
                    segments.append((size, rank, count, first + full, per_bin))
                    rank = count
                    put(room - rest * size, first + full, 1)
                    full += 1
                if n - full:
                    put(room, first + full, n - full)
    return segments, bins


# ---------------------------------------------------------------- token counts


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the public vocabulary file ``name`` is installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = spec.submodule_search_locations[0] if spec and spec.submodule_search_locations else "/opt/tokenizers"
    return f"{folder}/{name}"


#: How text is cut before byte pairs are merged (fixed value, the usual one of this vocabulary).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(``key``, tokens) of every text that has any; null and empty texts give no rows."""
    field = documents.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["_key", "tokens"])

    return documents.select(documents[key].alias("_key"), documents[text].alias("_text")).mapInArrow(count, f"_key {field}, tokens bigint").filter("tokens > 0").withColumnRenamed("_key", key)


# ---------------------------------------------------------------- packing


def pack(sizes: DataFrame, containers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Assign every item to a container of every kind.

    ``sizes``: ``key``, tokens. ``containers``: container_kind, capacity_tokens; kinds with a null
    or non-positive capacity are left out, a kind given twice counts with its least capacity.
    Returns container_kind, capacity_tokens, container_no, ``key``, piece_no, from_token, to_token,
    tokens. An item within the capacity is one piece; a larger one is cut into full pieces and a
    rest. Items of the same size are ranked by ``key``; repeated items are packed each. Items
    without tokens need no container.
    """
    spark = sizes.sparkSession
    kinds = [(r[0], r[1]) for r in containers.filter("capacity_tokens > 0 and container_kind is not null").groupBy("container_kind").agg(F.min("capacity_tokens")).collect()]  # a catalogue of container kinds
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity_tokens")) for k, c in sorted(kinds)])) if kinds else F.explode(F.array().cast("array<struct<container_kind:string,capacity_tokens:bigint>>"))
    items = cut(sizes.filter("tokens > 0").select(key, F.col("tokens").cast("bigint").alias("_tokens")))  # token counts, read twice
    groups = max(1, -(-items.count() // GROUP_ROWS))
    pieces = (
        items.select(key, "_tokens", each.alias("_kind"))
        .select(key, "_tokens", "_kind.*")
        .withColumn("piece_no", F.explode(F.expr("sequence(0, cast((_tokens - 1) div capacity_tokens as int))")))
        .withColumn("from_token", F.col("piece_no") * F.col("capacity_tokens"))
        .withColumn("to_token", F.least("_tokens", F.col("from_token") + F.col("capacity_tokens")))
        .withColumn("tokens", F.col("to_token") - F.col("from_token"))
        .withColumn("_group", F.pmod(F.xxhash64(key, "piece_no"), F.lit(groups)).cast("int"))
        .drop("_tokens")
    )
    sized = cut(pieces.groupBy("container_kind", "tokens", "_group").agg(F.count("*").alias("n")))
    segments = []
    for kind, capacity in kinds:
        # at most one row per size up to the capacity
        histogram = {r[0]: r[1] for r in sized.filter(F.col("container_kind") == kind).groupBy("tokens").agg(F.sum("n")).collect()}
        segments += [(kind, *s) for s in plan(histogram, capacity)[0]]
    before = sized.withColumn("_before", F.sum("n").over(Window.partitionBy("container_kind", "tokens").orderBy("_group")) - F.col("n")).drop("n")  # one row per group
    numbered = pieces.withColumn("_row", F.row_number().over(Window.partitionBy("container_kind", "tokens", "_group").orderBy(key, "piece_no")) - 1)
    ranked = numbered.join(before, ["container_kind", "tokens", "_group"]).withColumn("_rank", F.col("_row") + F.col("_before"))
    out = ["container_kind", "capacity_tokens", "container_no", key, "piece_no", "from_token", "to_token", "tokens"]
    if len(segments) > BROADCAST_SEGMENTS:
        planned = spark.createDataFrame(segments, "container_kind string, tokens bigint, rank_from bigint, rank_to bigint, first_bin bigint, per_bin bigint")
        # a segment stands once in every bucket of ranks that it touches, and items of one size spread over those buckets
        planned = planned.withColumn("_bucket", F.explode(F.expr(f"sequence(rank_from div {RANKS}, (rank_to - 1) div {RANKS})")))
        placed = ranked.withColumn("_bucket", F.expr(f"_rank div {RANKS}")).join(planned, ["container_kind", "tokens", "_bucket"]).filter("_rank >= rank_from and _rank < rank_to")
        return placed.withColumn("container_no", (F.col("first_bin") + F.expr("(_rank - rank_from) div per_bin")).cast("bigint")).select(*out)
    shared = spark.sparkContext.broadcast(_Plan(segments))
    place = F.pandas_udf(lambda kind, tokens, rank: shared.value.bins(kind, tokens, rank), "bigint")
    return ranked.withColumn("container_no", place("container_kind", "tokens", "_rank")).select(*out)


class _Plan:
    """The segments in order of kind, size and rank, for binary search."""

    def __init__(self, segments: list[tuple[str, int, int, int, int, int]]):
        segments = sorted(segments)
        self.span = max((s[3] for s in segments), default=0) + 1
        self.kinds = {k: n for n, k in enumerate(sorted({s[0] for s in segments}))}
        self.sizes = max((s[1] for s in segments), default=0) + 1
        self.at = np.array([(self.kinds[k] * self.sizes + size) * self.span + lo for k, size, lo, _, _, _ in segments], np.int64)
        self.lo, self.first, self.per_bin = (np.array([s[c] for s in segments], np.int64) for c in (2, 4, 5))

    def bins(self, kind: pd.Series, tokens: pd.Series, rank: pd.Series) -> pd.Series:
        code = kind.map(self.kinds).to_numpy(np.int64) * self.sizes + tokens.to_numpy(np.int64)
        n = np.searchsorted(self.at, code * self.span + rank.to_numpy(np.int64), side="right") - 1
        return pd.Series(self.first[n] + (rank.to_numpy(np.int64) - self.lo[n]) // self.per_bin[n])


def fill(assigned: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the least number that could hold them, and the share filled."""
    bins = assigned.groupBy("container_kind", "capacity_tokens", "container_no").agg(F.sum("tokens").alias("held"))
    return bins.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.max("held").alias("fullest")).withColumn("at_least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
