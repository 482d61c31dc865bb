"""Chat formatting: layouts found by the fingerprint of nested field paths, canonical turns, a reversible template."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from graphloom.llm._arrow import row_slices

START, END = "### ", "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """How records of a layout become turns.

    Either ``items`` names a list whose elements hold role and text, or ``turns`` gives, in order, a role and the fields
    whose texts, joined by blank lines, make its turn, or the record is itself a turn at the place ``order``.
    """

    name: str
    role: str = ""
    text: str = ""
    items: str = ""
    order: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        if self.turns:
            return sorted({f for _, fields in self.turns for f in fields})
        prefix = f"{self.items}[]." if self.items else ""
        return sorted([prefix + self.role, prefix + self.text, *([self.order] if self.order else [])])

    def variants(self) -> Iterator[tuple[str, ...]]:
        """The sets of paths that a record of this layout may have."""
        given, free = [p for p in self.paths() if p not in self.optional], sorted(self.optional)
        for k in range(len(free) + 1):
            for some in combinations(free, k):
                yield tuple(sorted([*given, *some]))


LAYOUTS = (
    Layout("turn_rows", role="role", text="text", order="turn"),
    Layout("messages", items="messages", role="role", text="content"),
    Layout("from_value", items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant", "model": "assistant"}),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Layout("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Layout("question_answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: Iterator[str] | tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


class Registry:
    """Layouts by fingerprint. Paths that no layout names don't count, so further fields don't matter."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS) -> None:
        self.known = {p for x in layouts for p in x.paths()}
        self.by_print = {fingerprint(v): x for x in layouts for v in x.variants()}

    def find(self, paths: set[str]) -> tuple[str, Layout | None]:
        own = fingerprint(paths & self.known)
        return own, self.by_print.get(own)


def schema_paths(kind: DataType, prefix: str = "") -> set[str]:
    """The paths of a schema's leaves: a.b for structs, a[].b for lists."""
    if isinstance(kind, StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def value_paths(value: object, prefix: str = "") -> set[str]:
    """The paths of a JSON value's leaves; null fields don't count."""
    if isinstance(value, dict):
        return {p for k, v in value.items() if v is not None for p in value_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value if v is not None for p in value_paths(v, f"{prefix}[]")}
    return {prefix}


def canonical_turns(df: DataFrame, id_col: str, registry: Registry | None = None) -> DataFrame:
    """(conv_id, seq, role, text, layout) for a table whose schema's fingerprint selects a layout; ValueError if none does.

    Null roles and texts are empty. A null list has no turns. Repeated rows are turns of their own.
    """
    own, layout = (registry or Registry()).find(schema_paths(df.drop(id_col).schema))
    if layout is None:
        raise ValueError(f"no layout has the fingerprint {own}")
    name = F.lit(layout.name).alias("layout")

    def role(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        for old, new in layout.roles.items():
            c = F.when(c == old, new).otherwise(c)
        return c.alias("role")

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("")).alias("text")

    key = F.col(id_col).alias("conv_id")
    if layout.order:
        return df.select(key, F.col(layout.order).cast("long").alias("seq"), role(F.col(layout.role)), text(F.col(layout.text)), name)
    if layout.items:
        rows = df.select(key, F.posexplode(layout.items).alias("seq", "item"))
        return rows.select("conv_id", F.col("seq").cast("long"), role(F.col(f"item.{layout.role}")), text(F.col(f"item.{layout.text}")), name)
    given = set(df.columns)
    turns = [F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *(F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in given)).alias("text")) for r, fields in layout.turns if set(fields) & given]
    rows = df.select(key, F.posexplode(F.array(*turns)).alias("seq", "item"))
    return rows.select("conv_id", F.col("seq").cast("long"), "item.role", "item.text", name).where((F.col("role") != "system") | (F.col("text") != ""))


def _said(value: object) -> str:
    """A role or text: null is empty, other values than texts are their JSON; what UTF-8 can't hold becomes U+FFFD."""
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _place(value: object) -> int | None:
    """A turn's place if it is a whole number that 64 bits hold, also as text."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        return None
    try:
        number = int(value)
    except (ValueError, OverflowError):
        return None
    return number if -(2**63) <= number < 2**63 and (isinstance(value, str) or number == value) else None


def _json_turns(raw: str | None, registry: Registry) -> list[tuple]:
    """(seq, role, text, layout, error) of a record's turns, or one row with the error."""
    wrong = lambda why: [(None, None, None, None, why)]
    try:
        record = json.loads(raw) if raw is not None else None
        if not isinstance(record, dict):
            return wrong("not a JSON object")
        own, layout = registry.find(value_paths(record))
        if layout is None:
            return wrong(f"no layout has the fingerprint {own}")
        name = lambda role: layout.roles.get(_said(role), _said(role))
        if layout.order:
            place = _place(record[layout.order])
            return wrong("the turn's place is not a whole number") if place is None else [(place, name(record[layout.role]), _said(record[layout.text]), layout.name, None)]
        if layout.items:
            items = [x if isinstance(x, dict) else {} for x in record[layout.items]]
            return [(k, name(x.get(layout.role)), _said(x.get(layout.text)), layout.name, None) for k, x in enumerate(items)]
        found = [(r, "\n\n".join(_said(record[f]) for f in fields if _said(record.get(f)))) for r, fields in layout.turns if any(f in record for f in fields)]
        return [(k, r, t, layout.name, None) for k, (r, t) in enumerate(x for x in found if x[0] != "system" or x[1])]
    except RecursionError:
        return wrong("nested too deeply")
    except ValueError:
        return wrong("not a JSON object")


def canonical_json_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, seq, role, text, layout, error) for records as JSON texts of any layout, each found by its own fingerprint.

    Broken or too deeply nested JSON, null, records of no layout and turns without a place give one row with seq null and
    the reason in ``error``; the other records go on. Half surrogates become U+FFFD. A list without items has no turns.
    Repeated and null ids stay as they are; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry()
        for batch in batches:
            for start, n in row_slices(batch.column(1), 1 << 20):
                part = batch.slice(start, n)
                rows = [(i, *t) for i, raw in zip(*(c.to_pylist() for c in part.columns), strict=True) for t in _json_turns(raw, registry)]
                kinds = (pa.int64(), pa.int64(), *[pa.string()] * 4)
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "seq", "role", "text", "layout", "error"])

    return df.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, "conv_id long, seq long, role string, text string, layout string, error string")


def escaped(c: Column) -> Column:
    """The text without the template's control strings: a backslash before each backslash and hash sign, and in the end mark."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    return F.replace(c, F.lit("</turn>"), F.lit("<\\/turn>"))


def formatted_turns(turns: DataFrame) -> DataFrame:
    """The turns with their formatted text and the part of it under the loss mask: (mask_start, mask_chars) in characters.

    A conversation is the joined texts of its turns in the order of seq, then role and text; turns that tie in all three are
    equal. Its rows come in one task and in this order, and are formatted after the shuffle, which carries each text once.
    The mask covers what assistants say, without marks. Roles also have their colons escaped. No turns give no rows.
    """
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    body = escaped(F.col("text"))
    return turns.select(
        "conv_id", "seq", "role", "text", F.concat(head, body, F.lit(END)).alias("formatted"),
        F.length(head).alias("mask_start"), F.when(F.col("role") == "assistant", F.length(body)).otherwise(0).alias("mask_chars"),
    )


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text; ValueError if it is not whole turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the formatted texts and masks
    as ``formatted_turns`` gives them, without a shuffle in between.

    The rows of a conversation are in one task, as a running digest takes them in order, but stream through it; a long
    one needs no memory. Conversations with a null id are one; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = run  # no conversation yet
        done: list[tuple] = []
        turns = loss = None
        n = chars = total = 0
        for batch in batches:
            for conv, text, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != key:
                    if turns is not None:
                        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    key, turns, loss, n, chars, total = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                masked = unescaped(text[start : start + length])
                loss.update(masked.encode())
                chars += len(masked)
                total += len(text)
            yield _digests(done)
            done = []
        if turns is not None:
            yield _digests([(key, n, turns.hexdigest(), chars, loss.hexdigest(), total)])

    return formatted.select("conv_id", "formatted", "mask_start", "mask_chars").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
