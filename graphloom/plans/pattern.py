"""A subset of Cypher, compiled to joins over a graph's two tables.

Supported: MATCH and OPTIONAL MATCH with node labels (also alternatives), property maps, typed, alternative, untyped,
reverse, undirected and variable-length (up to three) edges, path variables, several patterns joined by shared variables;
WHERE with =, <>, <, >, IN, CONTAINS, STARTS WITH, IS [NOT] NULL, n:Label, AND, OR, NOT; WITH and RETURN with DISTINCT,
aliases, count, sum, min, max, avg, collect, coalesce, type, labels, id, elementId, startNode, endNode, nodes,
relationships, length, head, size, toLower, toUpper, substring, CASE, lists, list comprehensions, maps, and + for lists and
texts; UNWIND; ORDER BY, LIMIT, also after WITH. Within one MATCH an edge is used once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.graph import GraphStore

_CLAUSES = re.compile(r"\b(OPTIONAL\s+MATCH|MATCH|WHERE|(?<!STARTS\s)WITH|UNWIND|RETURN|ORDER\s+BY|LIMIT)\b", re.I)
_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_NODE = re.compile(r"\(\s*(\w*)\s*((?::\s*\w+(?:\s*\|\s*\w+)*)?)\s*(\{(?:[^}'\"]|" + _QUOTED + r")*\})?\s*\)")
_EDGE = re.compile(r"(<)?-\s*(?:\[\s*(\w*)\s*(?::\s*([\w|:\s]+?))?\s*(\*\s*(\d+)?\s*(?:\.\.\s*(\d+))?)?\s*\])?\s*-(>)?")
_TOKEN = re.compile(r"\s*(" + _QUOTED + r"|<>|<=|>=|[=<>(),.\[\]*:{}|+]|\d+\.\d+|\w+)")
_PATH = re.compile(r"(\w+)\s*=\s*(?=\()")

#: Other names of a node's columns, and properties that a node may lack: they are null then.
NAMES = {"source_document_id": "doc", "node_type": "type"}
OPTIONAL = ("doc_id", "short_name", "year", "jenis", "regulation_type", "status", "version")


class PatternError(ValueError):
    """The text is not of the supported subset."""


@dataclass
class _Node:
    name: str
    labels: list[str] = field(default_factory=list)
    props: dict[str, object] = field(default_factory=dict)


def _literal(text: str) -> object:
    if text[0] in "'\"":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return float(text) if "." in text else int(text)


class _Expression:
    """A WHERE condition or RETURN item as a column; variables are structs in the rows."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise PatternError(f"cannot read {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at, self.aggregate, self.locals = 0, False, {}

    def peek(self, *words: str) -> bool:
        return all(self.at + k < len(self.tokens) and self.tokens[self.at + k].upper() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise PatternError(f"{word} expected at {' '.join(self.tokens[self.at :])!r}")

    def condition(self) -> Column:
        out = self.conjunction()
        while self.take("OR"):
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.negation()
        while self.take("AND"):
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        return ~self.negation() if self.take("NOT") else self.comparison()

    def comparison(self) -> Column:
        if self.peek("("):
            self.need("(")
            out = self.condition()
            self.need(")")
            return out
        left = self.sum()
        for sign, op in (("=", Column.__eq__), ("<>", Column.__ne__), ("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if self.take(sign):
                return op(left, self.sum())
        if self.take("CONTAINS"):
            return F.contains(left, self.sum())
        if self.take("STARTS", "WITH"):
            return F.startswith(left, self.sum())
        if self.take(":"):
            labels = [self.next()]
            while self.take("|"):
                labels.append(self.next())
            return reduce(lambda a, b: a | b, (F.array_contains(left.getField("labels"), x) for x in labels))
        if self.take("IN"):
            return F.array_contains(self.sum(), left)
        if self.take("IS", "NOT", "NULL"):
            return left.isNotNull()
        if self.take("IS", "NULL"):
            return left.isNull()
        return left

    def sum(self) -> Column:
        """Lists or texts, joined by +."""
        parts = [self.value()]
        while self.take("+"):
            parts.append(self.value())
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise PatternError("the text ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def value(self) -> Column:
        out = self.plain()
        while self.take("."):
            out = out.getField(self.next())
        return out

    def plain(self) -> Column:
        word = self.next()
        if word[0] in "'\"" or word[0].isdigit():
            return F.lit(_literal(word))
        if word == "[":
            return self.list()
        if word == "{":
            return self.map()
        if word.upper() == "CASE":
            return self.case()
        if word.upper() in ("TRUE", "FALSE", "NULL") and not self.peek("("):
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[word.upper()])
        if not word[0].isalpha() and word[0] != "_":
            raise PatternError(f"a value expected at {word!r}")
        if self.take("("):
            return self.function(word.lower())
        return self.locals[word] if word in self.locals else F.col(word)

    def list(self) -> Column:
        if self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].upper() == "IN":
            name = self.next()
            self.need("IN")
            items = self.sum()
            start, end = self.at, self.at

            def each(x: Column) -> tuple[Column | None, Column]:
                """The condition and the value of an item; read anew for each lambda."""
                nonlocal end
                self.at, self.locals = start, self.locals | {name: x}
                keep = self.condition() if self.take("WHERE") else None
                made = self.sum() if self.take("|") else x
                end = self.at
                return keep, made

            if any(w.upper() == "WHERE" for w in self.tokens[start : start + 1]):
                items = F.filter(items, lambda x: each(x)[0])
            out = F.transform(items, lambda x: each(x)[1])
            self.at = end
            self.locals.pop(name)
            self.need("]")
            return out
        items = []
        while not self.take("]"):
            items.append(self.sum())
            if not self.peek("]"):
                self.need(",")
        return F.array(*items)

    def map(self) -> Column:
        fields = []
        while not self.take("}"):
            name = self.next()
            self.need(":")
            fields.append(self.sum().alias(name))
            if not self.peek("}"):
                self.need(",")
        return F.struct(*fields)

    def case(self) -> Column:
        subject = None if self.peek("WHEN") else self.sum()
        branches = []
        while self.take("WHEN"):
            test = self.condition() if subject is None else subject == self.sum()
            self.need("THEN")
            branches.append((test, self.sum()))
        if not branches:
            raise PatternError("CASE without WHEN")
        out = self.sum() if self.take("ELSE") else F.lit(None)
        self.need("END")
        for test, value in reversed(branches):
            out = F.when(test, value).otherwise(out)
        return out

    def function(self, name: str) -> Column:
        distinct = self.take("DISTINCT")
        if name == "count" and self.take("*"):
            self.need(")")
            self.aggregate = True
            return F.count("*")
        args = [self.sum()]
        while self.take(","):
            args.append(self.sum())
        self.need(")")
        if name in ("count", "sum", "min", "max", "avg", "collect"):
            self.aggregate = True
            if name == "count":
                return F.count_distinct(args[0]) if distinct else F.count(args[0])
            if name == "collect":
                return F.array_sort(F.collect_set(args[0]) if distinct else F.collect_list(args[0]))
            return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[name](args[0])
        simple = {"coalesce": lambda *a: F.coalesce(*a), "type": lambda e: e.getField("type"), "labels": lambda n: n.getField("labels"), "head": lambda a: F.try_element_at(a, F.lit(1)), "tolower": F.lower, "toupper": F.upper, "size": F.size, "id": lambda n: n.getField("id"), "elementid": lambda n: n.getField("id"),
            "startnode": lambda e: F.struct(e.getField("src").alias("id")), "endnode": lambda e: F.struct(e.getField("dst").alias("id")),
            "nodes": lambda p: p.getField("nodes"), "relationships": lambda p: p.getField("edges"), "length": lambda p: F.size(p.getField("edges"))}
        if name in simple:
            return simple[name](*args)
        if name == "substring":
            return F.substring(args[0], args[1] + 1, args[2])
        raise PatternError(f"unknown function {name}")


def _split(text: str) -> list[str]:
    """Parts between commas that stand in no brackets and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:k])
            start = k + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


class Matcher:
    def __init__(self, store: GraphStore) -> None:
        self.store, self.fresh = store, 0

    def name(self, given: str) -> str:
        self.fresh += not given
        return given or f"_{self.fresh}"

    def nodes(self, node: _Node) -> DataFrame:
        rows = self.whole
        if node.labels:
            rows = rows.where(reduce(lambda a, b: a | b, (F.array_contains("labels", x) for x in node.labels)))
        for key, value in node.props.items():
            rows = rows.where(F.col(key) == F.lit(value))
        return rows.select(F.col("id").alias(f"{node.name}__id"), F.struct(*rows.columns).alias(node.name))

    @property
    def whole(self) -> DataFrame:
        """The nodes with their other names and what they lack."""
        rows = self.store.nodes
        more = {name: F.col(own) for name, own in NAMES.items() if name not in rows.columns and own in rows.columns}
        return rows.withColumns(more | {name: F.lit(None).cast("string") for name in OPTIONAL if name not in rows.columns})

    def edges(self, name: str, types: list[str], way: str) -> DataFrame:
        rows = self.store.edges.where(F.col("type").isin(types)) if types else self.store.edges
        own = F.struct("src", "type", "dst").alias(name)
        ahead = rows.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), own)
        back = rows.select(F.col("dst").alias("__a"), F.col("src").alias("__b"), own)
        return ahead if way == ">" else back if way == "<" else ahead.unionByName(back)

    def pattern(self, rows: DataFrame | None, bound: dict[str, _Node], text: str, used: list[str]) -> DataFrame:
        named = _PATH.match(text)
        text, path = (text[named.end() :], named[1]) if named else (text, "")
        m = _NODE.match(text)
        if not m:
            raise PatternError(f"a node expected at {text!r}")
        at, left = m.end(), self._node(m)
        rows = self._bind(rows, bound, left)
        if path:
            rows = rows.withColumn(path, F.struct(F.array(left.name).alias("nodes"), F.array().cast("array<struct<src:string,type:string,dst:string>>").alias("edges")))
        while at < len(text.rstrip()):
            m = _EDGE.match(text, at)
            if not m or (m[1] and m[7]):
                raise PatternError(f"an edge expected at {text[at:]!r}")
            n = _NODE.match(text, m.end())
            if not n:
                raise PatternError(f"a node expected at {text[m.end():]!r}")
            at, right = n.end(), self._node(n)
            way, types = "<" if m[1] else ">" if m[7] else "", [t.strip(" :") for t in (m[3] or "").split("|") if t.strip(" :")]
            low, high = (int(m[5] or 1), int(m[6] or m[5] or 3)) if m[4] else (1, 1)
            if not 1 <= low <= high <= 3:
                raise PatternError("variable lengths go from 1 to 3")
            rows = self._hop(rows, bound, left, right, self.name(m[2] or ""), types, way, low, high, used, path)
            left = right
        return rows

    def _node(self, m: re.Match) -> _Node:
        props = {}
        for part in _split((m[3] or "{}")[1:-1]):
            key, _, value = part.partition(":")
            props[key.strip()] = _literal(value.strip())
        return _Node(self.name(m[1]), [x.strip() for x in m[2].lstrip(": ").split("|") if x.strip()], props)

    def _bind(self, rows: DataFrame | None, bound: dict[str, _Node], node: _Node) -> DataFrame:
        if node.name in bound:
            return self._narrowed(rows, node)
        found = self.nodes(node)
        if rows is not None:
            raise PatternError("patterns must share a variable")
        bound[node.name] = node
        return found

    @staticmethod
    def _narrowed(rows: DataFrame, node: _Node) -> DataFrame:
        if node.labels:
            rows = rows.where(reduce(lambda a, b: a | b, (F.array_contains(f"{node.name}.labels", x) for x in node.labels)))
        for key, value in node.props.items():
            rows = rows.where(F.col(f"{node.name}.{key}") == F.lit(value))
        return rows

    def _hop(self, rows, bound, left, right, name, types, way, low, high, used, path) -> DataFrame:
        step = rows.withColumn("__at", F.col(f"{left.name}__id")).withColumn(f"{name}__l", F.array().cast("array<struct<src:string,type:string,dst:string>>"))
        found = []
        for k in range(1, high + 1):
            e = self.edges("__e", types, way)
            step = step.join(e, F.col("__at") == F.col("__a"))
            taken = [F.array_contains(f"{name}__l", F.col("__e")), *(F.array_contains(F.col(f"{u}__l"), F.col("__e")) for u in used)]
            step = step.where(~reduce(lambda a, b: a | b, taken)).withColumn(f"{name}__l", F.array_append(f"{name}__l", F.col("__e"))).withColumn("__at", F.col("__b"))
            if path:
                met = self.whole.select(F.col("id").alias("__b"), F.struct(*self.whole.columns).alias("__n"))
                longer = F.struct(F.array_append(f"{path}.nodes", F.col("__n")).alias("nodes"), F.array_append(f"{path}.edges", F.col("__e")).alias("edges"))
                step = step.join(met, "__b").withColumn(path, longer).drop("__n")
            step = step.drop("__a", "__b", "__e")
            if k >= low:
                found.append(step)
        out = reduce(DataFrame.unionByName, found)
        out = out.withColumn(name, F.element_at(f"{name}__l", 1) if (low, high) == (1, 1) else F.col(f"{name}__l"))
        used.append(name)
        if right.name in bound:
            return self._narrowed(out.where(F.col("__at") == F.col(f"{right.name}__id")).drop("__at"), right)
        bound[right.name] = right
        return out.join(self.nodes(right), F.col("__at") == F.col(f"{right.name}__id")).drop("__at")


def _clauses(text: str) -> list[tuple[str, str]]:
    """(clause, body) in order; words within quotes and brackets begin none."""
    plain = re.sub(r"\bSTARTS\s+WITH\b", "STARTS WITH", text.strip().rstrip(";"), flags=re.I)
    hidden = re.sub(_QUOTED, lambda m: "'" + "_" * (len(m[0]) - 2) + "'", plain)
    depth, seen = 0, []
    for c in hidden:
        depth += (c in "([{") - (c in ")]}")
        seen.append(c if depth <= 0 else "_")
    hidden = "".join(seen)
    found = list(_CLAUSES.finditer(hidden))
    if not found or hidden[: found[0].start()].strip():
        raise PatternError(f"unknown clause {plain[: found[0].start() if found else 20].strip()!r}")
    ends = [m.start() for m in found[1:]] + [len(plain)]
    return [(re.sub(r"\s+", " ", m[1]).upper(), plain[m.end() : end].strip()) for m, end in zip(found, ends, strict=True)]


def compile_query(store: GraphStore, text: str) -> DataFrame:
    """The rows of a query; PatternError for what is not of the subset."""
    clauses = _clauses(text)
    if "RETURN" not in [k for k, _ in clauses]:
        raise PatternError("RETURN is missing")
    matcher, rows, bound = Matcher(store), None, {}
    at = 0
    while at < len(clauses) and clauses[at][0] != "RETURN":
        kind, body = clauses[at]
        at += 1
        follows = lambda *kinds: at < len(clauses) and clauses[at][0] in kinds  # noqa: B023, E731
        if kind in ("MATCH", "OPTIONAL MATCH"):
            where = None
            if follows("WHERE"):
                where, at = clauses[at][1], at + 1
            if kind == "MATCH":
                used: list[str] = []
                for pattern in _ordered(_split(body), bound):
                    rows = matcher.pattern(rows, bound, pattern, used)
                if where is not None:
                    rows = rows.where(_Expression(where).condition())
            elif rows is None:
                raise PatternError("OPTIONAL MATCH needs a MATCH before it")
            else:
                rows = _optional(matcher, rows, bound, body, where)
        elif kind == "UNWIND":
            rows = _unwound(store, rows, bound, body)
        elif kind == "WITH":
            if rows is None:
                raise PatternError("WITH needs a MATCH before it")
            rows, bound = _projected(rows, body, bound)
            while follows("WHERE", "ORDER BY", "LIMIT"):
                rows, at = _finished(rows, *clauses[at]), at + 1
        else:
            raise PatternError(f"{kind} is out of place")
    if rows is None:
        raise PatternError("MATCH is missing")
    out, _ = _projected(rows, clauses[at][1], {})
    for clause in clauses[at + 1 :]:
        if clause[0] not in ("ORDER BY", "LIMIT"):
            raise PatternError(f"{clause[0]} is out of place")
        out = _finished(out, *clause)
    return out


def _unwound(store: GraphStore, rows: DataFrame | None, bound: dict[str, _Node], body: str) -> DataFrame:
    """A row for each item of a list; items that are nodes can be matched from."""
    m = re.fullmatch(r"(.*?)\s+AS\s+(\w+)", body, re.I | re.S)
    if not m:
        raise PatternError(f"UNWIND needs a name at {body!r}")
    e = _Expression(m[1])
    items = e.sum()
    if e.at < len(e.tokens) or e.aggregate:
        raise PatternError(f"cannot read {body!r}")
    out = (store.nodes.sparkSession.range(1).drop("id") if rows is None else rows).withColumn(m[2], F.explode(items))
    kind = out.schema[m[2]].dataType
    if "id" in getattr(kind, "names", []) and "labels" in kind.names:
        bound[m[2]] = _Node(m[2])
        out = out.withColumn(f"{m[2]}__id", F.col(f"{m[2]}.id"))
    return out


def _ordered(patterns: list[str], bound: dict[str, _Node]) -> list[str]:
    """The patterns so that each begins with a variable that stands before it, where there is one."""
    out, known, rest = [], set(bound), list(patterns)
    while rest:
        k = next((k for k, p in enumerate(rest) if (m := _NODE.match(p)) and m[1] in known), 0)
        pattern = rest.pop(k)
        out.append(pattern)
        known |= {m[1] for m in _NODE.finditer(pattern)}
    return out


def _optional(matcher: Matcher, rows: DataFrame, bound: dict[str, _Node], body: str, where: str | None) -> DataFrame:
    """The optional part is matched from the distinct bound ends, with its own WHERE, and then joined from the left."""
    names = [m[1] for p in _split(body) for m in _NODE.finditer(p) if m[1] in bound]
    if not names:
        raise PatternError("OPTIONAL MATCH must share a variable")
    keys = [f"{n}__id" for n in dict.fromkeys(names)]
    ends = rows.select(*keys, *(F.col(k[:-4]) for k in keys)).dropDuplicates(keys)
    inner_bound, part, used = {k[:-4]: bound[k[:-4]] for k in keys}, ends, []
    for pattern in _ordered(_split(body), inner_bound):
        part = matcher.pattern(part, inner_bound, pattern, used)
    if where is not None:
        part = part.where(_Expression(where).condition())
    part = part.drop(*(k[:-4] for k in keys))
    for name in inner_bound:
        bound.setdefault(name, inner_bound[name])
    return rows.join(part, keys, "left")


def _projected(rows: DataFrame, body: str, bound: dict[str, _Node]) -> tuple[DataFrame, dict[str, _Node]]:
    """The rows with the items of WITH or RETURN alone, and the variables among them that are still nodes."""
    items, nodes = [], {}
    distinct = re.match(r"DISTINCT\b", body, re.I)
    for part in _split(body[8:] if distinct else body):
        m = re.fullmatch(r"(.*?)\s+AS\s+(\w+)", part, re.I | re.S)
        e = _Expression(m[1] if m else part)
        value = e.sum()
        if e.at < len(e.tokens):
            raise PatternError(f"cannot read {part!r}")
        name = m[2] if m else re.sub(r"\W+", "_", part).strip("_")
        items.append((name, value, e.aggregate))
        if e.tokens[0] in bound and len(e.tokens) == 1:
            nodes[name] = _Node(name)
            items.append((f"{name}__id", F.col(f"{e.tokens[0]}__id"), False))
    if any(a for *_, a in items):
        out = rows.groupBy(*(c.alias(n) for n, c, a in items if not a)).agg(*(c.alias(n) for n, c, a in items if a)).select(*(n for n, *_ in items))
    else:
        out = rows.select(*(c.alias(n) for n, c, _ in items))
    return out.distinct() if distinct else out, nodes


def _finished(out: DataFrame, kind: str, text: str) -> DataFrame:
    if kind == "WHERE":
        return out.where(_Expression(text).condition())
    if kind == "LIMIT":
        if not text.isdigit():
            raise PatternError(f"LIMIT {text}")
        return out.limit(int(text))
    order = []
    for part in _split(text):
        m = re.fullmatch(r"(.*?)(?:\s+(ASC|DESC)\w*)?", part.strip(), re.I | re.S)
        name = re.sub(r"\W+", "_", m[1]).strip("_")
        of = F.col(name) if name in out.columns else _Expression(m[1]).sum()
        order.append(of.desc_nulls_first() if (m[2] or "").upper() == "DESC" else of.asc_nulls_last())
    return out.orderBy(*order, *(c for c in out.columns))


def run_query(store: GraphStore, text: str) -> DataFrame:
    """The rows of a query, or one row (error) if the text can't be read."""
    try:
        return compile_query(store, text)
    except PatternError as e:
        return store.nodes.sparkSession.createDataFrame([(str(e),)], "error string")


def is_valid(store: GraphStore, text: str) -> bool:
    """Whether a text can be planned; nothing is run."""
    try:
        compile_query(store, text).schema  # noqa: B018
        return True
    except Exception:  # the planner's own errors count as well
        return False
