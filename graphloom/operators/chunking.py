"""Token-bounded chunks: a sliding fold over segments, windows over long texts, and packing of whole articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions import text as T

MAX_TOKENS, MIN_TOKENS, OVERLAP = 800, 400, 100
#: Tokens of a chunk of whole articles.
STRUCTURE_TOKENS = 3000


def windows(c: str | Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """A long text in pieces of as many words as give ``max_tokens``, each beginning ``overlap`` tokens before the last one's end."""
    size, step = int(max_tokens / 1.3), int(max_tokens / 1.3) - int(overlap / 1.3)
    w = T.words(c)
    return F.element_at(F.transform(F.array(w), lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(step)), lambda i: i < F.size(x)), lambda i: F.array_join(F.slice(x, i + 1, size), " "))), 1)


def tail(c: str | Column, overlap: int = OVERLAP) -> Column:
    """The last words that make ``overlap`` tokens; a shorter text whole."""
    n = int(overlap / 1.3)
    return F.element_at(F.transform(F.array(T.words(c)), lambda x: F.array_join(F.slice(x, F.greatest(F.size(x) - n, F.lit(0)) + 1, n), " ")), 1)


def tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def _windows(text: str, max_tokens: int, overlap: int) -> list[str]:
    words, size = text.split(), int(max_tokens / 1.3)
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size - int(overlap / 1.3))]


def fold(segments: list[tuple[str, str, str, list[int]]], max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, overlap: int = OVERLAP) -> list[tuple[str, str, str, list[int]]]:
    """(text, owner, owner's type, pages) of segments (text, id, type, pages) in order.

    A buffer is filled while it fits. When it doesn't, it is put out, if it is long enough, and its last words begin the
    next one; a short buffer takes the segment all the same. Pages and owner start anew with that segment. A segment too
    long for an empty buffer is cut into windows. What remains at the end is put out whatever its size. Words are counted
    once a segment, and the buffer is joined when it is put out.
    """
    out, held, n, pages, owner = [], [], 0, set(), ("", "")
    size = lambda words: int(words * 1.3)
    whole = lambda: "\n\n".join(held).strip()
    for text, own, kind, at in segments:
        words = len(text.split())
        if size(n + words) <= max_tokens:
            pages, owner = pages | set(at), owner if owner[0] else (own, kind)
            held, n = [*held, text.rstrip() if held else text], n + words
        elif held:
            if size(n) >= min_tokens:
                buffer = whole()
                out.append((buffer, *owner, sorted(pages)))
                last = buffer.split()[-int(overlap / 1.3) :]
                held, n = [" ".join(last), text], len(last) + words
            else:
                held, n = [*held, text.rstrip()], n + words
            pages, owner = set(at), (own, kind)
        else:
            out += [(piece, own, kind, sorted(set(at))) for piece in _windows(text, max_tokens, overlap)]
    if held and whole():
        out.append((whole(), *owner, sorted(pages)))
    return out


_CHUNK = "document_id string, chunk_index int, chunk_id string, text string, token_count int, owner string, owner_type string, pages string"


def _chunks(documents: DataFrame, made: Callable[[str, list[dict]], list[tuple[str, str, str, list[int]]]], infix: str) -> DataFrame:
    """The chunks that ``made`` gives for each document (document_id, items), numbered; one document is one row."""
    names = [f.split()[0] for f in _CHUNK.split(", ")]
    kinds = {"chunk_index": pa.int32(), "token_count": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                doc, items = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows += [(doc, i, f"{doc}__{infix}_{i:03d}", t, tokens(t), own, kind, ",".join(map(str, p))) for i, (t, own, kind, p) in enumerate(made(doc, items))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)

    return documents.mapInArrow(run, _CHUNK)


def sliding(segments: DataFrame, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of segments (document_id, ord, component_id, component_type, page_start, page_end, text)."""
    items = F.array_sort(F.collect_list(F.struct("ord", "component_id", "component_type", "page_start", "page_end", "text")))

    def made(doc: str, rows: list[dict]) -> list[tuple[str, str, str, list[int]]]:
        return fold([(r["text"], r["component_id"], r["component_type"], [int(r["page_start"]), int(r["page_end"])]) for r in rows], max_tokens, min_tokens, overlap)

    return _chunks(segments.groupBy("document_id").agg(items.alias("items")), made, "chunk")


def packed(articles: list[tuple[str, list[int]]], header: str, max_tokens: int) -> list[tuple[str, list[int]]]:
    """(text, pages) of whole articles (text, pages) under a header: all in one chunk if they fit, else as many in each as
    fit; an article too long makes a chunk alone."""
    words = lambda text: len(text.split())
    whole = header + "\n\n".join(t for t, _ in articles)
    if tokens(whole) <= max_tokens:
        return [(whole.strip(), sorted({p for _, at in articles for p in at}))]
    out, held, pages, n = [], [], set(), words(header)
    for text, at in articles:
        if held and int((n + words(text)) * 1.3) > max_tokens:
            out.append(("\n\n".join([header, *held]).strip(), sorted(pages)))
            held, pages, n = [], set(), words(header)
        held, pages, n = [*held, text], pages | set(at), n + words(text)
    return [*out, ("\n\n".join([header, *held]).strip(), sorted(pages))]


def structure_aware(rows: DataFrame, articles: DataFrame, titles: DataFrame | None = None, max_tokens: int = STRUCTURE_TOKENS, with_explanations: bool = False) -> DataFrame:
    """Chunks of components: what has no parent and is no chapter in one first chunk; then chapter by chapter, articles right
    below it before those of its sections, whole articles under a header that names document, chapter and section.

    titles: (document_id, title); the id is the title of other documents. Explanations are left out unless asked for.
    """
    tree = rows.select("document_id", "component_id", "component_type", "parent_id", "ord", "number", "title", "is_explanation")
    up = lambda k: tree.select("document_id", *(F.col(c).alias(f"{k}_{c}") for c in tree.columns[1:]))
    placed = articles.join(rows.select("document_id", "component_id", "parent_id", "page_start", "page_end", "is_explanation"), ["document_id", "component_id"])
    for k, child in (("a", "parent_id"), ("b", "a_parent_id"), ("c", "b_parent_id")):
        placed = placed.join(up(k).withColumnRenamed(f"{k}_component_id", child), ["document_id", child], "left")
    of_chapter = lambda c: F.coalesce(*(F.when(F.col(f"{k}_component_type") == "BAB", F.col(own if c == "component_id" else f"{k}_{c}")) for k, own in (("a", "parent_id"), ("b", "a_parent_id"), ("c", "b_parent_id"))))
    placed = placed.select(
        "document_id", F.lit(1).alias("kind"), *(of_chapter(c).alias(f"bab_{c}") for c in ("component_id", "ord", "number", "title", "is_explanation")),
        F.when(F.col("a_component_type") == "BAGIAN", F.col("a_ord")).otherwise(F.lit(-1)).cast("int").alias("section_ord"),
        F.when(F.col("a_component_type") == "BAGIAN", F.concat_ws(" ", F.lit("Bagian"), "a_number", "a_title")).alias("section"), "ord", "text", "page_start", "page_end", "is_explanation",
    ).where("bab_component_id is not null")
    if not with_explanations:
        placed = placed.where("not bab_is_explanation and not is_explanation")
    loose = rows.where("parent_id is null and component_type <> 'BAB' and content <> ''").select("document_id", F.lit(0).alias("kind"), "ord", F.col("content").alias("text"))
    every = placed.unionByName(loose, allowMissingColumns=True)
    names = ["kind", "bab_ord", "section_ord", "ord", "bab_component_id", "bab_number", "bab_title", "bab_is_explanation", "section", "text", "page_start", "page_end"]
    documents = every.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))
    if titles is not None:
        documents = documents.join(titles, "document_id", "left")
    named = documents.select("document_id", F.struct((F.coalesce("title", "document_id") if titles is not None else F.col("document_id")).alias("title"), "items").alias("items"))

    def made(doc: str, found: dict) -> list[tuple[str, str, str, list[int]]]:
        out, head = [], f"[DOKUMEN: {found['title']}]\n"
        loose = [r["text"] for r in found["items"] if r["kind"] == 0]
        if loose:
            out.append(((head + "[BAGIAN: PEMBUKAAN]\n---\n" + "\n\n".join(loose)).strip(), "", "PREAMBLE", []))
        for (bab, _), group in groupby((r for r in found["items"] if r["kind"] == 1), key=lambda r: (r["bab_component_id"], r["section_ord"])):
            items = list(group)
            first = items[0]
            header = f"{head}[BAB: {' '.join(x for x in ('BAB', first['bab_number'], first['bab_title']) if x)}]"
            header += "\n[BAGIAN: PENJELASAN]" * bool(first["bab_is_explanation"]) + (f"\n[BAGIAN: {first['section']}]" if first["section"] else "") + "\n---\n"
            out += [(t, bab, "BAB", p) for t, p in packed([(r["text"], [r["page_start"], r["page_end"]]) for r in items], header, max_tokens)]
        return out

    return _chunks(named, made, "struct_chunk")


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.round(F.avg("token_count"), 1).alias("avg_tokens"))
