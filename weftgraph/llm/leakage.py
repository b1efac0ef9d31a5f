"""Evaluation passages inside training texts: BM25 over character grams with block-max WAND.

The held-out passages form the index, every passage of every training text is a query.
Terms are grams of N characters of the bare text (NFKC, lower case, letters and digits
only), so wrapping, marks and width don't hide a copy. The retrieval threshold of an item
is the least BM25 score that a shared run of the required length can give, so nothing that
shares such a run is missed; an exact comparison of the runs follows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import cut

#: Characters in a gram.
N = 8
#: Shared characters that make a leak, by language of the item; others need DEFAULT_RUN.
RUNS = {"zh": 16, "ja": 16}
DEFAULT_RUN = 40
#: Bare characters in a passage of a training text; neighbours overlap by a run less one.
PASSAGE = 512
#: Postings in a block of a list.
BLOCK = 64
#: Postings up to which lists over the same items are merged in a query; a block or less.
SHORT = 16
#: Bytes of an index, about. More items are spread over several indexes, none is dropped.
INDEX_BYTES = 64 << 20
#: What a character of a passage takes in an index: posting, term, offset, place among the item's terms, text.
BYTES_PER_CHARACTER = 52
#: Bits per character of all passages in the filter of texts, and the most bytes it may have.
FILTER_BITS, FILTER_BYTES = 16, 128 << 20
K1, B = 1.2, 0.75

_OTHER = re.compile(r"[\W_]+")
_ASCII_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_P = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(64)], np.uint64)


def bare(text: str | None) -> str:
    """NFKC, lower case, only letters and digits."""
    if text and text.isascii():  # the same, faster
        return text.encode().translate(None, _ASCII_OTHER).lower().decode()
    return _OTHER.sub("", unicodedata.normalize("NFKC", text or "").lower())


def grams(text: str, n: int = N) -> np.ndarray:
    """A 64-bit hash for every gram of ``n`` characters, by place."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(points) - n + 1, np.uint64)
    for j in range(n):
        out += (points[j : len(points) - n + 1 + j] + np.uint64(0x51ED27)) * _P[j]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Item:
    item_id: int
    text: str
    run: int
    question: str
    answers: list[str]


@dataclass
class Statistics:
    """Of all items, whatever index they are in: their number, grams per item, and the items of each gram that more than one has."""

    total: int
    mean: float
    shared: dict[int, int]


def statistics(items: list[Item]) -> Statistics:
    within = Counter(t for i in items for t in np.unique(grams(i.text)).tolist())
    sizes = [max(0, len(i.text) - N + 1) for i in items]
    return Statistics(len(items), sum(sizes) / len(sizes) if sizes else 1.0, {t: n for t, n in within.items() if n > 1})


class Index:
    """Inverted index of the items in flat arrays: postings sorted by item, BM25 weights, block maxima, thresholds.

    ``offsets[t]`` to ``offsets[t + 1]`` are the postings of term ``t`` in ``docs`` and ``weights``.
    """

    def __init__(self, items: list[Item], known: Statistics | None = None):
        self.items = [i for i in items if len(i.text) >= i.run]
        known = known or statistics(self.items)
        spots = [grams(i.text) for i in self.items]
        size = np.array([len(s) for s in spots], np.int64)
        owner = np.repeat(np.arange(len(spots)), size)
        every = np.concatenate(spots) if spots else np.empty(0, np.uint64)
        self.terms, term = np.unique(every, return_inverse=True)
        # one posting per item and term, in the order of term, then item
        pair, count = np.unique(term * max(1, len(spots)) + owner, return_counts=True)
        of, doc = np.divmod(pair, max(1, len(spots)))
        self.docs = doc.astype(np.int32)
        self.offsets = np.searchsorted(of, np.arange(len(self.terms) + 1))
        within = np.array([known.shared.get(t, 1) for t in self.terms.tolist()], float)
        idf = np.log(1 + (known.total - within + 0.5) / (within + 0.5))
        tf = count.astype(float)
        self.weights = (idf[of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(known.mean, 1e-9)))).astype(np.float32)
        ends = np.cumsum(size)
        at = np.searchsorted(pair, term * max(1, len(spots)) + owner)
        weight = self.weights[at].astype(float)
        self.least = [self._least(at[e - n : e].tolist(), weight[e - n : e].tolist(), i.run - N + 1) for i, n, e in zip(self.items, size.tolist(), ends.tolist())]
        self.floor = min(self.least, default=0.0)
        lengths = np.diff(self.offsets)
        per_term = -(-lengths // BLOCK)
        self.block_offsets = np.concatenate([[0], np.cumsum(per_term)]).astype(np.int64)
        starts = np.repeat(self.offsets[:-1] - self.block_offsets[:-1] * BLOCK, per_term) + np.arange(self.block_offsets[-1]) * BLOCK
        self.block_max = np.maximum.reduceat(self.weights, starts) if len(starts) else np.empty(0, np.float32)
        self.most = np.maximum.reduceat(self.weights, self.offsets[:-1]) if len(self.terms) else np.empty(0, np.float32)
        # short lists over the same items have the same sign: that of a single item is its number
        self.sign = np.where(lengths == 1, self.docs[self.offsets[:-1]] if len(self.terms) else 0, -1).astype(np.int32)
        several: dict[bytes, int] = {}
        for t in np.flatnonzero((lengths > 1) & (lengths <= SHORT)).tolist():
            self.sign[t] = several.setdefault(self.docs[self.offsets[t] : self.offsets[t + 1]].tobytes(), len(self.items) + len(several))
        by_item = np.argsort(self.docs, kind="stable")
        self.own = of[by_item].astype(np.int32)
        self.own_offsets = np.searchsorted(self.docs[by_item], np.arange(len(self.items) + 1))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.terms >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _least(spot: list[int], weight: list[float], width: int) -> float:
        """The least sum of the weights of the distinct terms (``spot``) over ``width`` neighbouring grams."""
        if len(set(spot)) == len(spot) >= width:
            upto = np.concatenate([[0.0], np.cumsum(weight)])
            return float((upto[width:] - upto[:-width]).min()) * (1 - 1e-9) - 1e-9
        inside: Counter = Counter()
        total, least = 0.0, float("inf")
        for p, t in enumerate(spot):
            inside[t] += 1
            if inside[t] == 1:
                total += weight[p]
            if p >= width:
                gone = spot[p - width]
                inside[gone] -= 1
                if not inside[gone]:
                    total -= weight[p - width]
            if p >= width - 1:
                least = min(least, total)
        return least * (1 - 1e-9) - 1e-9

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms, and the numbers of the terms."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
        found = np.searchsorted(self.terms, hashes[at])
        ok = found < len(self.terms)
        at, found = at[ok], found[ok]
        ok = self.terms[found] == hashes[at]
        return at[ok], found[ok]

    def list_of(self, t: int) -> tuple[list[int], list[float]]:
        """The postings of a term: items and weights."""
        a, b = self.offsets[t], self.offsets[t + 1]
        return self.docs[a:b].tolist(), self.weights[a:b].tolist()

    def search(self, terms: np.ndarray | list[int]) -> list[tuple[int, float]]:
        """Every item whose BM25 score for ``terms`` reaches its threshold, by block-max WAND."""
        hits: list[tuple[int, float]] = []
        docs, weights, block_max, most = self._lists(terms)
        cursors = [[d[0], 0, t] for t, d in enumerate(docs)]  # item, place in the postings, list
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for n, (_, _, t) in enumerate(cursors):
                bound += most[t]
                if bound >= self.floor:
                    pivot = n
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            # refine by the blocks that would hold d, and the first item past the nearest of their ends
            bound, past = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for item, place, t in cursors[: pivot + 1]:
                at = place if item == d else bisect_left(docs[t], d, place)
                if at < len(docs[t]):
                    bound += block_max[t][at // BLOCK]
                    end = min((at // BLOCK + 1) * BLOCK, len(docs[t])) - 1
                    past = min(past, docs[t][end] + 1)
            if bound < self.floor or bound < self.least[d] and past <= d + 1:
                goal = max(past, d + 1)
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == d:
                score = 0.0
                for _, place, t in cursors[: pivot + 1]:
                    score += weights[t][place]
                if score >= self.least[d]:
                    hits.append((d, score))
                goal = d + 1
                moved = cursors[: pivot + 1]
            else:
                goal = d
                moved = [c for c in cursors[: pivot + 1] if c[0] < d]
            for c in moved:
                c[1] = bisect_left(docs[c[2]], goal, c[1])
                c[0] = docs[c[2]][c[1]] if c[1] < len(docs[c[2]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return hits

    def _lists(self, terms: np.ndarray | list[int]) -> tuple[list, list, list, list]:
        """The postings of the terms; short lists over the same items are one list with the sums of their weights."""
        docs, weights, block_max, most = [], [], [], []
        short: dict[int, tuple[list[int], list[float]]] = {}
        terms = np.asarray(terms, np.int64)
        single = self.offsets[terms + 1] - self.offsets[terms] == 1
        if single.any():  # most lists: those of one item each, summed at once
            at = self.offsets[terms[single]]
            item, place = np.unique(self.docs[at], return_inverse=True)
            for d, w in zip(item.tolist(), np.bincount(place, self.weights[at]).tolist()):
                short[d] = [d], [w]
            terms = terms[~single]
        for t, sign in zip(terms.tolist(), self.sign[terms].tolist()):
            d, w = self.list_of(t)
            if sign < 0:
                docs.append(d)
                weights.append(w)
                block_max.append(self.block_max[self.block_offsets[t] : self.block_offsets[t + 1]].tolist())
                most.append(max(block_max[-1]))
            elif sign in short:
                held = short[sign][1]
                for i, x in enumerate(w):
                    held[i] += x
            else:
                short[sign] = d, w
        for d, w in short.values():
            docs.append(d)
            weights.append(w)
            most.append(max(w))
            block_max.append([most[-1]])
        return docs, weights, block_max, most

    def leaks(self, whole: str) -> list[tuple[int, float, int, float, int]]:
        """(item, best score, longest shared run, share of the question, answers found) per item that a bare text leaks."""
        at, terms = self.lookup(grams(whole))
        if not len(at):
            return []
        best: dict[int, float] = {}
        overlap = max(DEFAULT_RUN, *RUNS.values()) - 1
        step = PASSAGE - overlap
        for lo in range(0, max(1, len(whole) - overlap), step):
            a, b = np.searchsorted(at, [lo, lo + PASSAGE - N + 1])
            if a == b:
                continue
            query = np.unique(terms[a:b])
            if self.most[query].sum() * (1 + 1e-6) < self.floor:
                continue
            for d, score in self.search(query):
                if score > best.get(d, 0.0):
                    best[d] = score
        out = []
        for d, score in sorted(best.items()):
            run = self.shared_run(whole, d, at, terms)
            if run:
                item = self.items[d]
                said = item.question
                q = {said[p : p + N] for p in range(max(1, len(said) - N + 1))} if said else set()
                out.append((d, score, run, sum(g in whole for g in q) / len(q) if q else 0.0, sum(x in whole for x in item.answers)))
        return out

    def shared_run(self, whole: str, d: int, at: np.ndarray, terms: np.ndarray) -> int:
        """The longest run that the text shares with the item, 0 if shorter than required.

        A shared run lies where neighbouring grams of the text are all grams of the item; there the characters are compared.
        """
        item, best = self.items[d], 0
        mine = at[np.isin(terms, self.own[self.own_offsets[d] : self.own_offsets[d + 1]])]
        width = item.run - N + 1
        for part in np.split(mine, np.flatnonzero(np.diff(mine) != 1) + 1):
            if len(part) < width:
                continue
            p, end = int(part[0]), int(part[-1]) + N
            while p + max(best, item.run) <= end:
                size = max(best, item.run)
                if whole[p : p + size] in item.text:
                    while p + size < end and whole[p : p + size + 1] in item.text:
                        size += 1
                    best = size
                p += 1
        return best


def shares_run(whole: str, bits: np.ndarray, width: int) -> bool:
    """Whether ``width`` neighbouring grams of a bare text are all in the filter."""
    h = grams(whole)
    if len(h) < width:
        return False
    spot = h % np.uint64(len(bits) * 8)
    miss = np.flatnonzero((bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 0)
    edges = np.concatenate([[-1], miss, [len(h)]])
    return bool((np.diff(edges) > width).any())


def _item(r) -> Item:
    return Item(r["item_id"], bare(r["passage"]), r["run"], bare(r["question"]), [x for x in map(bare, (r["answer"] or "").split(";")) if x])


def _wanted(items: DataFrame) -> DataFrame:
    """One row per item and passage; of several deliveries the one with the shortest run holds, then the first by text."""
    kept = items.select("item_id", "passage", "lang", "question", "answer").filter("item_id is not null and passage is not null")
    language = F.element_at(F.split(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "[-_]"), 1)
    run = F.lit(DEFAULT_RUN)
    for code, length in RUNS.items():
        run = F.when(language == code, length).otherwise(run)
    rest = F.struct(run.alias("run"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    return kept.groupBy("item_id", "passage").agg(F.min(rest).alias("_r")).select("item_id", "passage", "_r.*")


def _statistics(wanted: DataFrame, blocks: int) -> tuple[Statistics, DataFrame | None]:
    """The numbers of all items but for the shared grams, which come as (block, gram, n): bounded by what a block holds."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, run, passage in zip(*(batch.column(c).to_pylist() for c in ("block", "run", "passage"))):
                text = bare(passage)
                if len(text) >= run:
                    h = np.unique(grams(text)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block, np.int32)), pa.array(h), pa.array(np.r_[len(text) - N + 1, np.zeros(len(h) - 1, np.int64)])], ["block", "gram", "size"])

    rows = cut(wanted.select("block", "run", "passage").mapInArrow(postings, "block int, gram bigint, size bigint"))
    total = rows.agg(F.count_if(F.col("size") > 0).alias("n"), F.sum("size").alias("size")).first()
    shared = rows.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    return Statistics(total["n"], (total["size"] or 0) / max(1, total["n"]), {}), cut(rows.select("block", "gram").distinct().join(shared, "gram"))


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, item_id, bm25, shared_run, question_share, answers_found for every text and item that share a run.

    ``items``: item_id, passage, lang, question, answer. A row comes out if text and passage
    share an unbroken run of 40 bare characters (16 if the item is Chinese or Japanese).
    ``bm25`` is the best score of a passage of the text; ``question_share`` the share of the
    question's grams that the text has; ``answers_found`` the number of its answers (parted by
    ``;``) in the text. Null or short passages and null or empty texts give no rows; a repeated
    text row or item counts once, an item delivered under several languages with the shortest run.

    Items are spread over indexes of about ``INDEX_BYTES``, with the statistics of all items in each,
    so their number plays no part in the result. With one index texts are read once and searched
    at once. With several they are read once against a filter of all grams, which lets every
    text with a run pass, and those that pass are searched in each index.
    """
    spark = documents.sparkSession
    wanted = cut(_wanted(items))
    characters = wanted.agg(F.sum(F.length("passage")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-characters * BYTES_PER_CHARACTER // INDEX_BYTES))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)).cast("int"))
    field, id_field = documents.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"_key {field}, item_id {id_field}, bm25 double, shared_run int, question_share double, answers_found int"
    texts = documents.select(documents[key].alias("_key"), documents[text].alias("_text"))
    known, shared_grams = _statistics(wanted, blocks) if blocks > 1 else (None, None)
    bits = np.zeros(min(FILTER_BYTES, max(1024, characters * FILTER_BITS // 8)), np.uint8)
    indexes, width = [], 1 << 30
    for n in range(blocks):
        rows = [_item(r) for r in sorted(wanted.filter(F.col("block") == n).collect(), key=lambda r: (str(r["item_id"]), r["passage"]))]  # INDEX_BYTES, about
        if shared_grams is not None:
            held = shared_grams.filter(F.col("block") == n).select("gram", "n").toPandas()  # grams of this index
            known = Statistics(known.total, known.mean, dict(zip(held["gram"].to_numpy().view(np.uint64).tolist(), held["n"].tolist())))
        index = Index(rows, known)
        spot = index.terms % np.uint64(len(bits) * 8)
        np.bitwise_or.at(bits, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))
        width = min([width, *(i.run - N + 1 for i in index.items)])
        indexes.append(spark.sparkContext.broadcast(index))
    if blocks == 1:
        found = texts.mapInArrow(_scan(indexes[0], bare), schema)
    else:
        passing = cut(texts.mapInArrow(_pass(spark.sparkContext.broadcast(bits), width), f"_key {field}, _text string"))
        parts = [passing.mapInArrow(_scan(i, str), schema) for i in indexes]
        found = reduce(DataFrame.unionByName, parts)
    return found.withColumnRenamed("_key", key).distinct()


def _pass(shared, width: int):
    """Texts that share a run with the filter, made bare."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = [(r, w) for r, w in enumerate(map(bare, batch.column(1).slice(lo, 256).to_pylist()), lo) if shares_run(w, shared.value, width)]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in rows])), pa.array([w for _, w in rows], pa.string())], ["_key", "_text"])

    return keep


def _scan(shared, make):
    """Texts, made bare by ``make``, to what they leak of one index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        ids = pa.array([i.item_id for i in index.items])
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                row, item, rest = [], [], []
                for r, t in enumerate(texts.slice(lo, 256).to_pylist(), lo):
                    for d, *values in index.leaks(make(t)) if t else ():
                        row.append(r)
                        item.append(d)
                        rest.append(values)
                if row:
                    score, run, share, answers = zip(*rest)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), ids.take(pa.array(item)), pa.array(score, pa.float64()), pa.array(run, pa.int32()), pa.array(share, pa.float64()), pa.array(answers, pa.int32())], ["_key", "item_id", "bm25", "shared_run", "question_share", "answers_found"])

    return scan
