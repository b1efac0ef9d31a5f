"""A read-only graph pattern language, compiled to joins.

MATCH and OPTIONAL MATCH clauses with WHERE, then RETURN [DISTINCT], ORDER BY, SKIP and
LIMIT. Directions are read and ignored: matching is undirected, as every relationship
between two labels has one direction anyway. Within one MATCH clause an edge is used once.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph_build import _EDGE_TYPES, EdgeSet, Graph

#: Rows that a query without LIMIT returns at most.
MAX_ROWS = 50


class PatternError(ValueError):
    """The query is unsafe, malformed or names what the graph doesn't have."""


# ---------------------------------------------------------------- text level

# Words that write or load.
_WRITES = re.compile(r"\b(?:create|merge|delete|detach|set|remove|drop|foreach|load\s+csv|apoc\.(?:create|merge|refactor)|call\s+db\.(?:create|drop))\b", re.I)
_LIMIT = re.compile(r"\blimit\s+\d+", re.I)


def clean(query: str | None) -> str:
    """Code fences and arrow heads removed."""
    text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", (query or "").strip()).strip()
    text = re.sub(r"-\s*(\[[^\]]*\])\s*->", r"-\1-", text)
    text = re.sub(r"<-\s*(\[[^\]]*\])\s*-", r"-\1-", text)
    return text.replace("-->", "--").replace("<--", "--")


def validate(query: str) -> str:
    """The query with a LIMIT; write words (anywhere in the text) and several statements are refused."""
    if _WRITES.search(query):
        raise PatternError("only reading is allowed")
    if ";" in query.strip().rstrip(";"):
        raise PatternError("only one statement is allowed")
    return query if _LIMIT.search(query) else query.rstrip().rstrip(";") + f"\nLIMIT {MAX_ROWS}"


def repair_tokens(query: str, allowed: set[str], opener: str, least: float = 0.75) -> tuple[str, list[tuple[str, str]]]:
    """Replace unknown ``[:TYPE`` or ``(:Label`` tokens that resemble exactly one allowed name."""
    fixes: list[tuple[str, str]] = []

    def replace(m: re.Match) -> str:
        token = m["token"]
        near = [] if token in allowed else difflib.get_close_matches(token, sorted(allowed), n=2, cutoff=least)
        if len(near) != 1:
            return m.group()
        fixes.append((token, near[0]))
        return m["head"] + near[0]

    return re.sub(rf"(?P<head>{re.escape(opener)}\s*\w*\s*:\s*)`?(?P<token>[A-Za-z_]\w*)`?", replace, query), fixes


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Node:
    var: str
    label: str | None
    props: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Rel:
    var: str
    types: tuple[str, ...]
    props: tuple[tuple[str, object], ...] = ()
    arrow: str = ""


@dataclass
class Match:
    optional: bool
    paths: list[list[Node | Rel]]
    where: tuple | None = None


@dataclass
class Query:
    matches: list[Match]
    items: list[tuple[tuple, str]]
    distinct: bool = False
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int | None = None


_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>`[^`]+`|[A-Za-z_]\w*)|(?P<op><=|>=|<>|=~|[-<>=()\[\]{}:,.|*+/%;]))")


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if not text[at:].strip():
                    break
                raise PatternError(f"can't read {text[at : at + 20]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind].strip("`") if kind == "name" else m[kind]))
            at = m.end()
        self.at, self.hidden = 0, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        """Take the keywords if they come next."""
        if all(self.peek(n).lower() == w for n, w in enumerate(words)) and self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += len(words)
            return True
        return False

    def take(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.peek() in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise PatternError(f"expected {op!r} before {self.peek()!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise PatternError(f"expected a name before {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def fresh(self) -> str:
        self.hidden += 1
        return f"_{self.hidden}"

    def query(self) -> Query:
        matches = []
        while True:
            optional = self.word("optional", "match")
            if not optional and not self.word("match"):
                break
            paths = [self.path()]
            while self.take(","):
                paths.append(self.path())
            matches.append(Match(optional, paths, self.expression() if self.word("where") else None))
        if not matches:
            raise PatternError("a query begins with MATCH")
        if not self.word("return"):
            raise PatternError(f"expected RETURN before {self.peek()!r}")
        q = Query(matches, [], self.word("distinct"))
        while True:
            e = self.expression()
            q.items.append((e, self.name() if self.word("as") else _title(e)))
            if not self.take(","):
                break
        if self.word("order", "by"):
            while True:
                e = self.expression()
                down = self.word("desc") or self.word("descending")
                if not down:
                    self.word("asc") or self.word("ascending")
                q.order.append((e, down))
                if not self.take(","):
                    break
        if self.word("skip"):
            q.skip = self.integer()
        if self.word("limit"):
            q.limit = self.integer()
        if self.at < len(self.tokens):
            raise PatternError(f"can't go on at {self.peek()!r}")
        return q

    def integer(self) -> int:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "num":
            raise PatternError("expected a number")
        self.at += 1
        return int(self.tokens[self.at - 1][1])

    def path(self) -> list[Node | Rel]:
        out: list[Node | Rel] = [self.node()]
        while self.peek() in ("-", "<"):
            left = bool(self.take("<"))
            self.need("-")
            var, types, props = "", (), ()
            if self.take("["):
                var = self.name() if self.tokens[self.at][0] == "name" else ""
                if self.take(":"):
                    names = [self.name()]
                    while self.take("|"):
                        self.take(":")
                        names.append(self.name())
                    types = tuple(names)
                if self.peek() == "*":
                    raise PatternError("paths of variable length are not supported")
                if self.peek() == "{":
                    props = self.props()
                self.need("]")
            self.need("-")
            right = bool(self.take(">"))
            out.append(Rel(var or self.fresh(), types, props, "<" * (left and not right) + ">" * (right and not left)))
            out.append(self.node())
        return out

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else ""
        label = self.name() if self.take(":") else None
        props = self.props() if self.peek() == "{" else ()
        self.need(")")
        return Node(var or self.fresh(), label, props)

    def props(self) -> tuple[tuple[str, object], ...]:
        self.need("{")
        out = []
        while not self.take("}"):
            key = self.name()
            self.need(":")
            value = self.atom()
            if value[0] != "value":
                raise PatternError("properties in braces must be constants")
            out.append((key, value[1]))
            self.take(",")
        return tuple(out)

    # expressions: ("value", v) ("prop", var, (name, ...)) ("var", v) ("call", name, distinct, args) (operator, ...)
    def expression(self) -> tuple:
        left = self.conjunction()
        while self.word("or"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.word("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.word("not") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        if op := self.take("=", "<>", "<=", ">=", "<", ">", "=~"):
            return (op, left, self.sum())
        if self.word("is", "not", "null"):
            return ("not", ("null", left))
        if self.word("is", "null"):
            return ("null", left)
        for words in (("starts", "with"), ("ends", "with"), ("contains",), ("in",)):
            if self.word(*words):
                return (words[0], left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.product()
        while op := self.take("+", "-"):
            left = (op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.atom()
        while op := self.take("*", "/", "%"):
            left = (op, left, self.atom())
        return left

    def atom(self) -> tuple:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.take("-"):
            return ("-", ("value", 0), self.atom())
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expression())
                self.take(",")
            return ("list", *items)
        if self.at >= len(self.tokens):
            raise PatternError("the query ends too early")
        kind, text = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return ("value", float(text) if "." in text else int(text))
        if kind == "str":
            self.at += 1
            return ("value", re.sub(r"\\(.)", r"\1", text[1:-1]))
        name = self.name()
        if name.lower() in ("true", "false", "null"):
            return ("value", {"true": True, "false": False, "null": None}[name.lower()])
        if self.take("("):
            distinct, args = self.word("distinct"), []
            while not self.take(")"):
                args.append(("all",) if self.take("*") else self.expression())
                self.take(",")
            return ("call", name.lower(), distinct, tuple(args))
        steps = []
        while self.take("."):
            steps.append(self.name())
        return ("prop", name, tuple(steps)) if steps else ("var", name)


def _title(e: tuple) -> str:
    if e[0] == "prop":
        return "_".join((e[1], *e[2]))
    if e[0] == "var":
        return e[1]
    if e[0] == "call":
        return e[1]
    return "value"


def parse(text: str) -> Query:
    return _Parser(text).query()


# ---------------------------------------------------------------- analysis


def _walk(e: tuple | None):
    if isinstance(e, tuple):
        yield e
        for x in e:
            if isinstance(x, tuple):
                yield from _walk(x)


def labels_of(q: Query) -> dict[str, str]:
    """The label of every variable, the first one that is named."""
    out: dict[str, str] = {}
    for m in q.matches:
        for path in m.paths:
            for n in path[::2]:
                if n.label:
                    out.setdefault(n.var, n.label)
    return out


def check(query: str, patterns: set[tuple[str, str, str]], props: dict[str, set[str]], allowed: list[str] | None = None, directed: bool = False) -> str | None:
    """The first problem of a query in words, or None: relationship, label, end points, property, repeated key, syntax."""
    types, labels = {p[1] for p in patterns}, {p[0] for p in patterns} | {p[2] for p in patterns}
    bad = sorted(set(re.findall(r"\[\s*\w*\s*:\s*`?([A-Za-z_]\w*)", query)) - types)
    if bad:
        return f"relationship type(s) {bad} do not exist; use {', '.join(sorted(allowed or types))}"
    bad = sorted(set(re.findall(r"\(\s*\w*\s*:\s*`?([A-Za-z_]\w*)", query)) - labels) if labels else []
    if bad:
        return f"node label(s) {bad} do not exist; use {', '.join(sorted(labels))}"
    try:
        q = parse(query)
    except PatternError as e:
        return f"syntax: {e}"
    named = labels_of(q)
    for m in q.matches:
        for path in m.paths:
            for i in range(1, len(path), 2):
                rel, a, b = path[i], named.get(path[i - 1].var), named.get(path[i + 1].var)
                for t in rel.types if a and b else ():
                    ends = [(a, t, b), (b, t, a)]
                    if directed and rel.arrow:
                        ends = [ends[0] if rel.arrow == ">" else ends[1]]
                    if not any(e in patterns for e in ends):
                        return f"({ends[0][0]})-[:{t}]->({ends[0][2]}) does not exist; {t} connects {'; '.join(sorted(f'({x})->({y})' for x, r, y in patterns if r == t))}"
    for m in q.matches:
        for path in m.paths:
            for n in path[::2]:
                keys = [k for k, _ in n.props]
                label = named.get(n.var)
                for k in keys:
                    if label in props and k not in props[label]:
                        return f"property {k!r} does not exist on ({label}); it has {', '.join(sorted(props[label]))}"
    used = [e for m in q.matches for e in _walk(m.where)] + [e for item, _ in q.items for e in _walk(item)] + [e for item, _ in q.order for e in _walk(item)]
    for e in used:
        if e[0] == "prop" and named.get(e[1]) in props and e[2][0] not in props[named[e[1]]]:
            return f"property {e[2][0]!r} does not exist on ({named[e[1]]}); it has {', '.join(sorted(props[named[e[1]]]))}"
    for m in q.matches:
        for path in m.paths:
            for n in path:
                keys = [k for k, _ in n.props]
                if len(keys) != len(set(keys)):
                    return "a pattern repeats a property key"
    return None


# ---------------------------------------------------------------- compilation


def _same(x: DataFrame, a: str, y: DataFrame, b: str) -> Column:
    """Equal ids; ids of different types are compared as text."""
    if x.schema[a].dataType == y.schema[b].dataType:
        return x[a] == y[b]
    return x[a].cast("string") == y[b].cast("string")


_DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth}
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


class Compiler:
    """Patterns to DataFrames over one graph. Only the edge sets and columns that a query names are read."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def run(self, text: str, checked: bool = True) -> DataFrame:
        """A query as a DataFrame; with ``checked`` unsafe text is refused and a missing LIMIT added."""
        return self.compile(parse(clean(validate(text) if checked else text)))

    def compile(self, q: Query) -> DataFrame:
        self.labels = dict(labels_of(q))
        self.rels: dict[str, list[str]] = {}
        self.needed = self._needed(q)
        rows: DataFrame | None = None
        for m in q.matches:
            rows = self._match(rows, m)
        return self._return(rows, q)

    def _needed(self, q: Query) -> dict[str, set[str]]:
        """The properties of every variable that the query reads."""
        out: dict[str, set[str]] = {}
        whole = [e for m in q.matches for e in _walk(m.where)] + [e for i, _ in q.items for e in _walk(i)] + [e for i, _ in q.order for e in _walk(i)]
        for e in whole:
            if e[0] == "prop":
                out.setdefault(e[1], set()).add(e[2][0])
        for m in q.matches:
            for path in m.paths:
                for n in path:
                    for k, _ in n.props:
                        out.setdefault(n.var, set()).add(k)
        return out

    # columns: a node variable v has v (its id), v#label, v.prop; an edge variable has r (its identity), r#type, r.prop
    def _node(self, n: Node) -> DataFrame:
        labels = [n.label or self.labels.get(n.var)]
        labels = [x for x in labels if x] or sorted(self.graph.nodes)
        parts = []
        wanted = sorted(self.needed.get(n.var, set()))
        for label in labels:
            df = self.graph.nodes.get(label)
            if df is None:
                raise PatternError(f"node label {label} does not exist")
            for k in wanted:
                if len(labels) == 1 and k not in df.columns:
                    raise PatternError(f"property {k!r} does not exist on ({label})")
            for k, v in n.props:
                if k in df.columns:
                    df = df.filter(F.col(k) == F.lit(v))
                else:
                    df = df.filter(F.lit(False))
            cols = [(F.col("id") if len(labels) == 1 else F.col("id").cast("string")).alias(n.var), F.lit(label).alias(f"{n.var}#label")]
            cols += [(F.col(k) if k in df.columns else F.lit(None)).alias(f"{n.var}.{k}") for k in wanted]
            parts.append(df.select(*cols))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def _edge(self, rel: Rel, a: str | None, b: str | None, far_read: bool) -> DataFrame:
        """Both orientations of the edge sets that fit: near and far end, identity, type, properties.

        ``far_read``: the plan joins the nodes of the far end anyway.
        """
        wanted = sorted(self.needed.get(rel.var, set()) | {k for k, _ in rel.props})
        parts = []
        for e in self.graph.edges:
            if rel.types and e.rel_type and e.rel_type not in rel.types:
                continue
            for near, far, flipped in ((e.src_label, e.dst_label, False), (e.dst_label, e.src_label, True)):
                if near and ((a and near != a) or (b and far != b)):
                    continue
                parts.append(self._oriented(e, rel, wanted, flipped, far_read or flipped, a, b))
        if not parts:
            raise PatternError(f"nothing connects ({a or ''}) and ({b or ''}) by {'|'.join(rel.types) or 'any relationship'}")
        if any(p.dtypes[i][1] != parts[0].dtypes[i][1] for p in parts for i in (0, 2)):
            parts = [p.withColumns({c: F.col(c).cast("string") for c in ("_near", "_far")}) for p in parts]
        return reduce(lambda x, y: x.unionByName(y), parts)

    def _oriented(self, e: EdgeSet, rel: Rel, wanted: list[str], flipped: bool, trusted: bool, a: str | None, b: str | None) -> DataFrame:
        df = e.unchecked if trusted and e.unchecked is not None else e.df
        kind = F.lit(e.rel_type) if e.rel_type else F.col("rel_type")
        if rel.types and not e.rel_type:
            df = df.filter(F.col("rel_type").isin(*rel.types))
        near, far = ("dst", "src") if flipped else ("src", "dst")
        labels = {"src": F.lit(e.src_label), "dst": F.lit(e.dst_label)} if e.src_label else {"src": F.col("src_label"), "dst": F.col("dst_label")}
        if not e.src_label:  # the labels that the pattern names, or any that the graph has
            for end, label in ((near, a), (far, b)):
                df = df.filter(labels[end] == label if label else labels[end].isin(*sorted(self.graph.nodes)))
        if flipped and e.src_label == e.dst_label:
            df = df.filter((F.col("src") != F.col("dst")) | (labels["src"] != labels["dst"]))  # a self loop matches once

        def prop(k: str) -> Column:
            if k == "origin":
                return F.lit(e.origin)
            return F.col(k) if k in df.columns else F.lit(None).cast(_EDGE_TYPES.get(k, "string"))

        for k, v in rel.props:
            df = df.filter(prop(k) == F.lit(v))
        identity = F.concat_ws("\u0001", labels["src"], F.col("src"), kind, labels["dst"], F.col("dst"))
        return df.select(F.col(near).alias("_near"), labels[near].alias("_near_label"), F.col(far).alias("_far"), labels[far].alias("_far_label"), identity.alias(rel.var), kind.alias(f"{rel.var}#type"), *[prop(k).alias(f"{rel.var}.{k}") for k in wanted])

    def _match(self, rows: DataFrame | None, m: Match) -> DataFrame:
        found = rows
        outer = set(rows.columns) if rows is not None else set()
        used: list[tuple] = []
        for path in m.paths:
            found = self._path(found, path, used, m.optional)
        if m.where is not None:
            found = found.filter(self._value(m.where))
        if not m.optional or rows is None:
            return found
        # what was bound before keeps a row where nothing matches
        keys = sorted(outer)
        added = [c for c in found.columns if c not in outer]
        right = found.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)], *[F.col(f"`{c}`") for c in added])
        condition = reduce(lambda x, y: x & y, [rows[f"`{c}`"].eqNullSafe(right[f"_k{i}"]) for i, c in enumerate(keys)])
        return rows.join(right, condition, "left").drop(*[f"_k{i}" for i in range(len(keys))])

    def _path(self, found: DataFrame | None, path: list[Node | Rel], used: list[tuple], optional: bool) -> DataFrame:
        if optional and found is not None:
            found = found.distinct()
        anchor = next((i for i in range(0, len(path), 2) if found is not None and path[i].var in found.columns), None)
        if anchor is None:  # begin at the most selective end, which constants mark
            anchor = max(range(0, len(path), 2), key=lambda i: (len(path[i].props), bool(path[i].label), -i))
            start = self._node(path[anchor])
            found = start if found is None else found.crossJoin(start)
        else:
            found = self._bound(found, path[anchor])
        for i in range(anchor, len(path) - 1, 2):
            found = self._hop(found, path[i], path[i + 1], path[i + 2], used)
        for i in range(anchor, 0, -2):
            found = self._hop(found, path[i], path[i - 1], path[i - 2], used)
        return found

    def _bound(self, found: DataFrame, n: Node) -> DataFrame:
        for k, v in n.props:
            found = found.filter(F.col(f"`{n.var}.{k}`") == F.lit(v))
        if n.label:
            found = found.filter(F.col(f"`{n.var}#label`") == n.label)
        return found

    def _hop(self, found: DataFrame, a: Node, rel: Rel, b: Node, used: list[tuple]) -> DataFrame:
        la, lb = a.label or self.labels.get(a.var), b.label or self.labels.get(b.var)
        far_read = b.var in found.columns or not lb or bool(self.needed.get(b.var)) or bool(b.props)
        edges = self._edge(rel, la, lb, far_read)
        if rel.var in found.columns:
            raise PatternError(f"{rel.var} is bound twice")
        fused = self._fused(rel, la, b) if lb and far_read and b.var not in found.columns else None
        if fused is not None:
            joined = found.join(fused, _same(found, a.var, fused, "_near") & (found[f"`{a.var}#label`"] == fused["_near_label"])).drop("_near", "_near_label")
            return self._once(joined, rel, la, lb, used)
        joined = found.join(edges, _same(found, a.var, edges, "_near") & (found[f"`{a.var}#label`"] == edges["_near_label"])).drop("_near", "_near_label")
        if b.var in found.columns:
            joined = self._bound(joined.filter(_same(joined, b.var, joined, "_far") & (F.col(f"`{b.var}#label`") == F.col("_far_label"))).drop("_far", "_far_label"), b)
        elif not far_read:
            joined = joined.withColumnsRenamed({"_far": b.var, "_far_label": f"{b.var}#label"})  # edges end at nodes, so the node need not be read
        else:
            nodes = self._node(b)
            joined = joined.join(nodes, _same(joined, "_far", nodes, b.var) & (joined["_far_label"] == nodes[f"`{b.var}#label`"])).drop("_far", "_far_label")
        return self._once(joined, rel, la, lb, used)

    def _once(self, joined: DataFrame, rel: Rel, la: str | None, lb: str | None, used: list[tuple]) -> DataFrame:
        """Within a clause an edge is used once; hops that can't share an edge need no comparison."""
        pair = {la, lb} if la and lb else None
        for other, types, ends in used:
            if (not types or not rel.types or set(types) & set(rel.types)) and (pair is None or ends is None or pair == ends):
                joined = joined.filter(F.col(f"`{other}`") != F.col(f"`{rel.var}`"))
        used.append((rel.var, rel.types, pair))
        return joined

    def _fused(self, rel: Rel, a: str | None, b: Node) -> DataFrame | None:
        """Edges that stand in the rows of their source nodes, with the nodes' columns, so the nodes aren't joined again."""
        label = b.label or self.labels.get(b.var)
        fits = [(e, flipped) for e in self.graph.edges if not (rel.types and e.rel_type and e.rel_type not in rel.types) for near, far, flipped in ((e.src_label, e.dst_label, False), (e.dst_label, e.src_label, True)) if not near or (not a or near == a) and far == label]
        if len(fits) != 1 or not fits[0][1] or fits[0][0].wide is None or rel.props or self.needed.get(rel.var, set()) - {"origin"}:
            return None
        e, df = fits[0][0], fits[0][0].wide
        for k in sorted(self.needed.get(b.var, set())):
            if k not in df.columns:
                raise PatternError(f"property {k!r} does not exist on ({label})")
        for k, v in b.props:
            df = df.filter(F.col(k) == F.lit(v))
        identity = F.concat_ws("\u0001", F.lit(e.src_label), F.col("id"), F.lit(e.rel_type), F.lit(e.dst_label), F.col("dst"))
        return df.select(F.col("dst").alias("_near"), F.lit(e.dst_label).alias("_near_label"), identity.alias(rel.var), F.lit(e.rel_type).alias(f"{rel.var}#type"), *[F.lit(e.origin).alias(f"{rel.var}.origin")] * ("origin" in self.needed.get(rel.var, set())), F.col("id").alias(b.var), F.lit(label).alias(f"{b.var}#label"), *[F.col(k).alias(f"{b.var}.{k}") for k in sorted(self.needed.get(b.var, set()))])

    def _value(self, e: tuple) -> Column:
        kind = e[0]
        if kind == "value":
            return F.lit(e[1])
        if kind == "var":
            return F.col(f"`{e[1]}`")
        if kind == "prop":
            c = F.col(f"`{e[1]}.{e[2][0]}`")
            for step in e[2][1:]:
                if step not in _DATE_PARTS:
                    raise PatternError(f"unknown part .{step}")
                c = _DATE_PARTS[step](c)
            return c
        if kind == "call":
            return self._call(e)
        if kind == "list":
            return F.array(*[self._value(x) for x in e[1:]])
        if kind == "not":
            return ~self._value(e[1])
        if kind == "null":
            return self._value(e[1]).isNull()
        if kind == "in":
            if e[2][0] != "list":
                raise PatternError("IN needs a list")
            return self._value(e[1]).isin(*[x[1] for x in e[2][1:]])
        a, b = self._value(e[1]), self._value(e[2])
        table = {"and": lambda: a & b, "or": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), "contains": lambda: F.contains(a, b), "starts": lambda: F.startswith(a, b), "ends": lambda: F.endswith(a, b), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}
        return table[kind]()

    def _call(self, e: tuple) -> Column:
        _, name, distinct, args = e
        if name == "type":
            return F.col(f"`{args[0][1]}#type`")
        if name in ("label", "labels"):
            return F.col(f"`{args[0][1]}#label`")
        if name == "count":
            if not args or args[0] == ("all",):
                return F.count(F.lit(1))
            return F.count_distinct(self._value(args[0])) if distinct else F.count(self._value(args[0]))
        values = [self._value(a) for a in args]
        simple = {"tolower": F.lower, "toupper": F.upper, "trim": F.trim, "size": F.length, "abs": F.abs, "round": F.round, "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.cast("bigint"), "tofloat": lambda c: c.cast("double"), "coalesce": F.coalesce, "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}
        if name == "collect":
            return F.array_sort(F.collect_set(values[0]) if distinct else F.collect_list(values[0]))
        if name not in simple:
            raise PatternError(f"unknown function {name}")
        return simple[name](*values)

    def _return(self, rows: DataFrame, q: Query) -> DataFrame:
        names = [n for _, n in q.items]
        if len(set(names)) < len(names):
            raise PatternError("result columns must have different names")
        aggregated = [any(x[0] == "call" and x[1] in _AGGREGATES for x in _walk(e)) for e, _ in q.items]
        columns = [self._value(e).alias(n) for e, n in q.items]
        hidden: list[str] = []
        if any(aggregated):
            keys = [c for c, a in zip(columns, aggregated) if not a]
            out = rows.groupBy(*keys).agg(*[c for c, a in zip(columns, aggregated) if a]).select(*names)
        else:
            if q.order and not q.distinct:
                for i, (e, _) in enumerate(q.order):
                    if self._by_name(e, q) is None:
                        hidden.append(f"_o{i}")
                        columns.append(self._value(e).alias(f"_o{i}"))
            out = rows.select(*columns)
            if q.distinct:
                out = out.distinct()
        keys = []
        for i, (e, down) in enumerate(q.order):
            name = self._by_name(e, q) or (f"_o{i}" if f"_o{i}" in hidden else None)
            if name is None:
                raise PatternError("ORDER BY must name a result column here")
            keys.append(F.col(name).desc_nulls_first() if down else F.col(name).asc_nulls_last())
        if keys:
            out = out.orderBy(*keys)
        if q.skip:
            out = out.offset(q.skip)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop(*hidden)

    def _by_name(self, e: tuple, q: Query) -> str | None:
        if e[0] == "var" and e[1] in [n for _, n in q.items]:
            return e[1]
        return next((n for item, n in q.items if item == e), None)
