"""Model-dependent steps behind small interfaces, with deterministic defaults.

Any object with the same method can stand in: a client of a model server, for instance.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.json_repair import read_json
from weftgraph.runtime import cut
from weftgraph.sources.tables import exists


class ItemFailed(RuntimeError):
    """An item that fails alone; ``place`` is its place in the list that was asked for."""

    def __init__(self, place: int, cause: Exception):
        super().__init__(f"item {place}: {type(cause).__name__}: {cause}")
        self.place = place


def in_parts(items: list, call: Callable[[list], list]) -> list:
    """What ``call`` gives for all items, in order. A part that fails is asked for again in two parts; an item that fails alone ends it."""
    answers: list = [None] * len(items)
    open_parts = [range(len(items))] if items else []
    while open_parts:
        part = open_parts.pop()
        try:
            answers[part.start : part.stop] = call([items[i] for i in part])
        except Exception as e:
            if len(part) == 1:
                raise ItemFailed(part.start, e) from e
            open_parts += [part[len(part) // 2 :], part[: len(part) // 2]]
    return answers


# ---------------------------------------------------------------- embedding


@dataclass(frozen=True)
class HashEmbedder:
    """Signed counts of hashed word and character grams: similar wording, similar vector."""

    dim: int = 256
    name: str = "hash-grams-1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in enumerate(texts):
            words = re.findall(r"\w+", (text or "").lower())
            grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])] + [w[i : i + 4] for w in words for i in range(max(0, len(w) - 3))]
            for g in grams:
                h = zlib.crc32(g.encode())
                out[row, h % self.dim] += 1.0 if h >> 31 else -1.0
        return out.tolist()


def embed(df: DataFrame, text: str, embedder=HashEmbedder(), batch: int = 16, out: str = "embedding") -> DataFrame:
    """``df`` with the vector of its text; batches of ``batch`` that fail are asked for in parts. Null texts count as empty."""

    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            values = s.fillna("").tolist()
            made = [v for i in range(0, len(values), batch) for v in in_parts(values[i : i + batch], embedder.embed)]
            yield pd.Series(made, index=s.index)

    return df.withColumn(out, F.pandas_udf(vectors, "array<float>")(F.col(text)))


def cached_embeddings(texts: DataFrame, text: str, path: str, embedder=HashEmbedder()) -> DataFrame:
    """(content_key, ``text``, embedding) of the distinct texts; vectors under the same content and model are read from ``path``.

    What is missing is embedded and appended there, so a text is embedded once.
    """
    spark = texts.sparkSession
    wanted = texts.select(text).filter(F.col(text).isNotNull()).distinct().withColumn("content_key", F.md5(F.concat_ws("||", text, F.lit(embedder.name))))
    known = spark.read.parquet(path) if exists(spark, path) else None
    missing = wanted if known is None else wanted.join(known.select("content_key"), "content_key", "left_anti")
    made = cut(embed(missing, text, embedder).select("content_key", text, "embedding"))
    made.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select("content_key"), "content_key", "left_semi")


# ---------------------------------------------------------------- extraction

TRIPLE = "array<struct<subject_id:string,predicate:string,object_id:string,evidence:string>>"


@dataclass(frozen=True)
class TemplateExtractor:
    """The default extractor: neighbouring candidates of a sentence, by id or name, related by the words between them."""

    reach: int = 60

    @staticmethod
    def _spans(text: str, low: str, what: str, pattern: str) -> list[tuple[int, int]]:
        """Where ``what`` stands as a word, whatever its case: what ``pattern`` finds, which is not compiled where all is ASCII."""
        word = lambda c: c.isalnum() or c == "_"
        if not (text.isascii() and what.isascii() and word(what[:1]) and word(what[-1:])):
            return [m.span() for m in re.finditer(pattern, text, re.I)]
        what = what.lower()
        out, at = [], low.find(what)
        while at >= 0:
            end = at + len(what)
            whole = not (at and word(low[at - 1])) and not word(low[end : end + 1])
            if whole:
                out.append((at, end))
            at = low.find(what, end if whole else at + 1)
        return out

    def _named(self, text: str, names: list[tuple[str, str]], taken: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
        """Where names stand, longer ones first, apart from each other and from what is taken; equal names stand for all their ids."""
        ids, found, low = {}, {}, text.lower()
        for i, name in names:
            ids.setdefault(name.lower(), set()).add(i)
        for name in sorted(ids, key=lambda n: (-len(n), n)):
            for start, end in self._spans(text, low, name, rf"(?<!\w){re.escape(name)}(?!\w)"):
                if all(end <= a or start >= b for a, b in [*taken, *found]):
                    found[start, end] = sorted(ids[name])
        return found

    def extract(self, text: str, candidates: list[str], names: list[tuple[str, str]] = ()) -> list[dict]:
        """``names``: (id, name) of candidates."""
        text = text or ""
        low = text.lower()
        by_id = [(*span, c) for c in candidates for span in self._spans(text, low, c, rf"\b{re.escape(c)}\b")]
        named = self._named(text, names, [(a, b) for a, b, _ in by_id])
        spots = sorted([(a, b, [c]) for a, b, c in by_id] + [(a, b, c) for (a, b), c in named.items()])
        out = []
        for (a, b, left), (c, d, right) in (((*x[:2], i), (*y[:2], j)) for x, y in zip(spots, spots[1:]) for i in x[2] for j in y[2]):
            between = text[b:c]
            if left != right and c - b <= self.reach and not re.search(r"[.!?]\s", between):
                words = re.findall(r"[A-Za-z]+", between)
                out.append({"subject_id": left, "predicate": "_".join(words[:4]).upper() or "RELATED_TO", "object_id": right, "evidence": text[a:d]})
        return out


def extract_triples(chunks: DataFrame, links: DataFrame, extractor=TemplateExtractor(), least: int = 2, limit: int | None = None) -> DataFrame:
    """Chunks (chunk_id, doc_id, text) with ``least`` or more linked entities → raw triples in the table's columns.

    A failing call gives no triples. ``limit`` bounds the chunks for a dry run. Repeated rows of the
    same chunk count once. Match tags and surfaces are filled in by the gate. If ``links`` has a column
    ``name``, extractors that take ``names`` get the candidates' (id, name) too.
    """
    takes_names = "name" in links.columns and "names" in inspect.signature(extractor.extract).parameters
    named = F.when(F.col("name").isNotNull(), F.struct("id", "name")) if takes_names else F.lit(None).cast("struct<id:string,name:string>")
    candidates = links.groupBy("chunk_id").agg(F.array_sort(F.collect_set("id")).alias("candidates"), F.array_sort(F.collect_set(named)).alias("names")).filter(F.size("candidates") >= least)
    todo = chunks.select("chunk_id", "doc_id", "text").repartition("chunk_id").distinct().join(candidates, "chunk_id")  # texts move once
    if limit is not None:
        todo = todo.orderBy("chunk_id").limit(limit)

    def call(text: pd.Series, candidates: pd.Series, names: pd.Series) -> pd.Series:
        def one(t: str, c: list[str], n: list[dict]) -> list[dict]:
            try:
                return extractor.extract(t, list(c), names=[(x["id"], x["name"]) for x in n]) if takes_names else extractor.extract(t, list(c))
            except Exception:  # a call that fails gives no triples
                return []

        return pd.Series([one(t, c, n) for t, c, n in zip(text, candidates, names)])

    said = todo.withColumn("t", F.explode(F.pandas_udf(call, TRIPLE)("text", "candidates", "names")))
    none = F.lit(None).cast("string")
    # the calls are dear and not repeatable, so what they gave is kept
    return cut(said.select("t.subject_id", "t.predicate", "t.object_id", none.alias("subject_match"), none.alias("object_match"), none.alias("subject_surface"), none.alias("object_surface"), F.col("t.evidence").alias("predicate_cue"), F.col("chunk_id").alias("source_chunk_id"), F.col("doc_id").alias("source_doc_id"), F.col("text").alias("chunk_text")))


# ---------------------------------------------------------------- language models


class SchemaRefused(Exception):
    """What ``send`` raises if the server can't decode under a schema."""


@dataclass
class Model:
    """A language model behind ``send(messages, schema) -> str``, where schema is a JSON schema or None.

    Once the server refuses a schema, it is asked in words for good; other failures, such as a
    timeout, are raised and change nothing. Without ``system_role`` instructions stand before the text.
    """

    send: Callable[[list[dict], dict | None], str]
    system_role: bool = True
    takes_schema: bool = True

    def messages(self, instructions: str, text: str) -> list[dict]:
        if self.system_role:
            return [{"role": "system", "content": instructions}, {"role": "user", "content": text}]
        return [{"role": "user", "content": f"{instructions}\n\n{text}"}]

    def say(self, instructions: str, text: str) -> str:
        return self.send(self.messages(instructions, text), None)

    def fill(self, instructions: str, text: str, schema: dict, list_key: str | None = None) -> dict:
        """An object of the schema; whatever is around it in the answer is left out."""
        if self.takes_schema:
            try:
                return read_json(self.send(self.messages(instructions, text), schema), list_key)
            except SchemaRefused:
                self.takes_schema = False
        return read_json(self.say(instructions, f"{text}\n\nReply with one JSON object that fits this schema:\n{json.dumps(schema)}"), list_key)


def _object(**properties: object) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties)}


def _list(of: dict) -> dict:
    return {"type": "array", "items": of}


TEXT, NUMBER = {"type": "string"}, {"type": "integer"}


@dataclass
class ModelExtractor:
    """Triples that a passage states between the candidates, by a model."""

    model: Model

    def extract(self, text: str, candidates: list[str], names: list[tuple[str, str]] = ()) -> list[dict]:
        known = dict(names)
        listed = "\n".join(f"- {c}" + (f" ({known[c]})" if c in known else "") for c in candidates)
        ask = "List the relations that the passage states between two of the records below. Give ids as listed, a short verb phrase, and the words of the passage that say so."
        schema = _object(triples=_list(_object(subject_id=TEXT, predicate=TEXT, object_id=TEXT, evidence=TEXT)))
        said = self.model.fill(ask, f"Records:\n{listed}\n\nPassage:\n{text}", schema, "triples")
        keys = ("subject_id", "predicate", "object_id", "evidence")
        return [{k: str(t.get(k) or "") for k in keys} for t in said.get("triples", []) if isinstance(t, dict)]


@dataclass
class ModelSense:
    """The entry of a menu that fits the evidence, by a model; OTHER if none does or the call fails."""

    model: Model

    def __call__(self, menu: list[str], evidence: str) -> str:
        from weftgraph.operators.extraction import SENSES

        texts = {n: t for senses in SENSES.values() for n, t in senses}
        listed = "\n".join(f"- {n}: {texts.get(n) or GLOSS(n)}" for n in menu)
        try:
            said = self.model.fill("Choose the meaning that the sentence expresses, or OTHER.", f"{listed}\n- OTHER\n\nSentence: {evidence}", _object(choice=TEXT))
        except Exception:
            return "OTHER"
        return said.get("choice") if said.get("choice") in menu else "OTHER"


def GLOSS(name: str) -> str:
    from weftgraph.plans.introspect import GLOSSES

    return GLOSSES.get(name, name.replace("_", " ").lower())


@dataclass
class ModelPruner:
    """Relationships that a question may need, by a model; a call that fails raises, and then nothing is pruned."""

    model: Model

    def pick(self, question: str, patterns: list[tuple[str, str, str]], seed_labels: list[str]) -> list[str]:
        lines = "\n".join(f"({a})-[:{r}]-({b})" for a, r, b in patterns)
        said = self.model.fill("Name every relationship on a path that could answer the question.", f"Question: {question}\nNamed in it: {', '.join(seed_labels) or 'nothing'}\n\n{lines}", _object(types=_list(TEXT)), "types")
        return [t for t in said.get("types", []) if isinstance(t, str)]


@dataclass
class ModelWriter:
    """A pattern query for a question, by a model; ``error`` is what was wrong with the one before."""

    model: Model

    def write(self, question: str, seeds: list[tuple[str, str]], patterns: list[tuple[str, str, str]], pks: dict[str, str], error: str | None = None, schema: str = "") -> str:
        keys = "\n".join(f"({label} {{{pks.get(label, 'id')}: '{i}'}})" for label, i in seeds)
        lines = schema or "\n".join(f"({a})-[:{r}]-({b})" for a, r, b in patterns)
        text = f"{lines}\n\nRecords in the question:\n{keys or 'none'}\n\nQuestion: {question}" + (f"\n\nYour last query failed: {error}" if error else "")
        return self.model.say("Write one query with MATCH, WHERE and RETURN over the graph below, with undirected relationships -[:TYPE]- and named result columns. Reply with the query alone.", text)


@dataclass
class ModelKeywords:
    """Names and topics of a question, by a model; a call that fails gives none."""

    model: Model

    def keywords(self, question: str) -> tuple[list[str], list[str]]:
        try:
            said = self.model.fill("Pick the names and ids in the question, and apart from these its topics.", question, _object(names=_list(TEXT), topics=_list(TEXT)))
        except Exception:
            return [], []
        return tuple([str(x) for x in said.get(k) or []] for k in ("names", "topics"))


@dataclass
class ModelPoints:
    """Points of the four paths for a question, by a model; what is no number counts as zero."""

    model: Model

    def points(self, question: str) -> dict[str, int]:
        paths = {"DB": "records and counts", "Doc": "what texts tell", "Hybrid": "both together", "LLM": "neither, common knowledge"}
        said = self.model.fill("Rate from 0 to 10 how well each source could answer the question.", "\n".join(f"{k}: {v}" for k, v in paths.items()) + f"\n\nQuestion: {question}", _object(**dict.fromkeys(paths, NUMBER)))
        return {k: int(said[k]) if str(said.get(k, "")).lstrip("-").isdecimal() else 0 for k in paths}


#: What an answer may rest on, by the kind of context.
ANSWER_FROM = {
    "rows": "Answer from the result rows alone; if they don't hold the answer, say that it is not there.",
    "graph": "Answer from the entities, relations and passages alone; if they don't hold the answer, say that it is not there.",
    "both": "Answer from the rows under A and the passages under B alone; if they don't hold the answer, say that it is not there.",
    "documents": "Answer from the passages alone; if they don't hold the answer, say that it is not there.",
    "none": "Answer from what is commonly known, in short.",
}


@dataclass
class ModelAnswerer:
    model: Model

    def answer(self, question: str, context: str, kind: str = "rows") -> str:
        return self.model.say(ANSWER_FROM[kind], f"Question: {question}" + (f"\n\n{context}" if kind != "none" else ""))


# ---------------------------------------------------------------- questions

# Words that say nothing about what a question is after.
STOP_WORDS = set("a an and any are as at by did do does for from had has have how in is it its many me of on or that the their there these this to was were what when where which who whom why will with".split())


@dataclass(frozen=True)
class WordKeywords:
    """Low-level keywords are ids and capitalised words, high-level ones the other content words."""

    def keywords(self, question: str) -> tuple[list[str], list[str]]:
        words = re.findall(r"[\w#-]+", question or "")
        low = [w for n, w in enumerate(words) if re.search(r"\d", w) or n and w[:1].isupper()]
        high = [w.lower() for w in words if w not in low and w.lower() not in STOP_WORDS]
        return list(dict.fromkeys(low)), list(dict.fromkeys(high))


@dataclass(frozen=True)
class PathPruner:
    """Picks the relationships on the shortest paths between the labels that a question names."""

    def pick(self, question: str, patterns: list[tuple[str, str, str]], seed_labels: list[str]) -> list[str]:
        near: dict[str, set[tuple[str, str]]] = {}
        for a, rel, b in patterns:
            near.setdefault(a, set()).add((rel, b))
            near.setdefault(b, set()).add((rel, a))
        named = set(seed_labels) | {label for label in near if re.sub(r"(?<!^)(?=[A-Z])", " ", label).lower() in (question or "").lower()}
        picked: set[str] = set()
        for start in sorted(named):
            for path in shortest_paths(near, start, named - {start}):
                picked.update(path)
        return sorted(picked)


def shortest_paths(near: dict[str, set[tuple[str, str]]], start: str, goals: set[str]) -> list[list[str]]:
    """The relationships of a shortest path from ``start`` to every goal that is reached."""
    paths, found, frontier = {start: []}, [], [start]
    while frontier:
        step = []
        for label in frontier:
            for rel, other in sorted(near.get(label, ())):
                if other not in paths:
                    paths[other] = [*paths[label], rel]
                    step.append(other)
                    if other in goals:
                        found.append(paths[other])
        frontier = step
    return found


@dataclass(frozen=True)
class PathWriter:
    """Writes a pattern query along a shortest path from the first seed to the label that is asked for.

    A hop over a pair that ``untyped`` names has no relationship type; it asks for promoted edges instead.
    """

    def write(self, question: str, seeds: list[tuple[str, str]], patterns: list[tuple[str, str, str]], pks: dict[str, str], error: str | None = None, schema: str = "", untyped: frozenset = frozenset()) -> str:
        if not seeds:
            return ""
        near: dict[str, set[tuple[str, str]]] = {}
        for a, rel, b in patterns:
            rel = "" if frozenset((a, b)) in untyped else rel
            near.setdefault(a, set()).add((rel, b))
            near.setdefault(b, set()).add((rel, a))
        label, id_ = seeds[0]
        asked = [x for x in near if x != label and re.sub(r"(?<!^)(?=[A-Z])", " ", x).lower() in question.lower()] or [x for x, _ in seeds[1:] if x != label]
        goal = asked[0] if asked else None
        steps = self._route(near, label, goal) if goal else []
        text, loose = f"(n0:{label} {{{pks.get(label, 'id')}: '{id_}'}})", []
        for i, (rel, other) in enumerate(steps, 1):
            text += f"-[:{rel}]-(n{i}:{other})" if rel else f"-[r{i}]-(n{i}:{other})"
            loose += [] if rel else [f"r{i}.origin = 'extracted'"]
        last = f"n{len(steps)}"
        return f"MATCH {text}" + (f" WHERE {' AND '.join(loose)}" if loose else "") + f" RETURN DISTINCT {last} AS id ORDER BY id"

    def _route(self, near: dict, start: str, goal: str) -> list[tuple[str, str]]:
        paths, frontier = {start: []}, [start]
        while frontier and goal not in paths:
            step = []
            for label in frontier:
                for rel, other in sorted(near.get(label, ())):
                    if other not in paths:
                        paths[other] = [*paths[label], (rel, other)]
                        step.append(other)
            frontier = step
        return paths.get(goal, [])


@dataclass(frozen=True)
class RowAnswerer:
    """Answers from what was retrieved alone; nothing retrieved, or nothing to retrieve (kind none), is said so."""

    def answer(self, question: str, context: str, kind: str = "rows") -> str:
        if kind == "none":
            return "No records were asked for this question."
        empty = context.strip() in ("", "(no results)", "(no passages)", "(no valid query)")
        return "No results were found." if empty else f"{'The documents say' if kind == 'documents' else 'Found'}: {context}"


def sense_column(provider: Callable[[list[str], str], str] | None):
    """A classifier for ``fold_senses`` from a function (menu, evidence) → name; None gives the cue words."""
    from weftgraph.operators.extraction import classify_sense

    if provider is None:
        return classify_sense

    def classify(menu: list[str], evidence: Column) -> Column:
        return F.pandas_udf(lambda s: s.map(lambda e: provider(menu, e)), "string")(evidence)

    return classify
