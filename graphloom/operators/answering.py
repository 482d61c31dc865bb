"""From a question to a query and an answer: forms of questions, prompts, and what models' answers hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom import model
from graphloom.functions import text as T
from graphloom.sources.adapters import filled_prompt, replayed

_ARTICLE = r"(pasal \d+[a-z]?)"
#: Forms of questions, the first that matches counts: name, pattern over the small letters, variable that documents filter, query.
FORMS = (
    ("article_sanction", rf"(?:denda|sanksi|hukuman)\b.*\b{_ARTICLE}", "a", "MATCH (a)-[:MERUJUK]->(target), (a)-[:MENETAPKAN_SANKSI]->(sk:Sanksi) WHERE toLower(target.label) CONTAINS '{}' RETURN a.label AS pasal_sanksi, target.label AS pasal_larangan, sk.label AS sanksi LIMIT 25"),
    ("sanction", r"(?:denda|sanksi|hukuman) (?:untuk |atas |dari )?([\w ]+)", "a", "MATCH (a)-[:MERUJUK]->(target)-[:MENGATUR]->(ph:PerbuatanHukum), (a)-[:MENETAPKAN_SANKSI]->(sk:Sanksi) WHERE toLower(ph.label) CONTAINS '{}' RETURN a.label AS pasal_sanksi, target.label AS pasal_larangan, sk.label AS sanksi LIMIT 25"),
    ("chapter_articles", r"pasal apa saja .*\b(bab [ivxlcdm]+)\b", "b", "MATCH (b:Bab) WHERE toLower(b.label) = '{}' OPTIONAL MATCH (b)-[:MEMUAT]->(p1:Pasal) OPTIONAL MATCH (b)-[:MEMUAT]->(bg:Bagian)-[:MEMUAT]->(p2:Pasal) WITH b, collect(DISTINCT p1) + collect(DISTINCT p2) AS pasals UNWIND pasals AS p RETURN b.label AS bab, p.label AS pasal, p.content AS isi ORDER BY p.label LIMIT 25"),
    ("definition", r"(?:definisi|pengertian) (?:dari )?([\w ]+)", "p", "MATCH (p)-[:MENDEFINISIKAN]->(k:KonsepHukum) WHERE toLower(k.label) CONTAINS '{}' RETURN p.label AS pasal, k.label AS konsep, k.content AS definisi LIMIT 25"),
    ("applies_to", rf"{_ARTICLE}.* berlaku untuk", "a", "MATCH (a)-[:BERLAKU_UNTUK]->(e:EntitasHukum) WHERE toLower(a.label) CONTAINS '{}' RETURN a.label AS pasal_ayat, e.label AS subjek LIMIT 25"),
    ("referring", rf"merujuk (?:ke|pada) {_ARTICLE}", "a", "MATCH (a)-[:MERUJUK]->(target) WHERE toLower(target.label) CONTAINS '{}' RETURN a.label AS sumber, target.label AS tujuan LIMIT 25"),
    ("paragraphs", rf"{_ARTICLE} (?:ayat berapa|memiliki ayat)", "p", "MATCH (p:Pasal)-[:MEMILIKI_AYAT]->(a:Ayat) WHERE toLower(p.label) = '{}' RETURN p.label AS pasal, a.label AS ayat, a.content AS isi ORDER BY a.label LIMIT 25"),
    ("chapter_of", rf"{_ARTICLE}.* bab (?:berapa|apa)", "p", "MATCH (b:Bab)-[:MEMUAT]->(p:Pasal) WHERE toLower(p.label) = '{}' RETURN b.label AS bab, p.label AS pasal LIMIT 25"),
    ("regulated", rf"diatur .*{_ARTICLE}", "p", "MATCH (p)-[:MENGATUR]->(ph:PerbuatanHukum) WHERE toLower(p.label) CONTAINS '{}' RETURN p.label AS pasal, ph.label AS perbuatan, ph.content AS detail LIMIT 25"),
    ("content", rf"(?:bunyi|isi) {_ARTICLE}", "p", "MATCH (p:Pasal) WHERE toLower(p.label) = '{}' RETURN p.label AS pasal, p.content AS isi LIMIT 25"),
    ("prohibited", r"(perbuatan .*dilarang)", "p", "MATCH (p)-[:MENGATUR]->(ph:PerbuatanHukum) WHERE '{}' <> '' RETURN p.label AS pasal, ph.label AS perbuatan LIMIT 25"),
)
#: For any other question: its first keyword.
KEYWORD = "MATCH (n) WHERE (toLower(n.label) CONTAINS '{}' OR toLower(n.content) CONTAINS '{}') RETURN labels(n) AS tipe, n.label AS label, n.content AS isi LIMIT 25"


def _filtered(query: str, variable: str, docs: list[str]) -> str:
    """The query with its first WHERE limited to documents."""
    names = ", ".join("'" + d.replace("\\", "\\\\").replace("'", "\\'") + "'" for d in docs)
    return query.replace("WHERE ", f"WHERE {variable}.source_document_id IN [{names}] AND ", 1)


def nl_to_query(questions: DataFrame, docs: list[str] | None = None, question_col: str = "question") -> DataFrame:
    """The questions with (form, query, status): by the first form that fits, else by the first keyword.

    docs: the documents that answers may come from. A null question, and one without any word to look for, has no query
    and the status "no query"; each row gives a row.
    """
    said = T.stripped(F.regexp_replace(F.regexp_replace(F.lower(F.col(question_col)), r"[?!.\"'\\]+", " "), r"\s+", " "))
    word = F.get(T.keywords(said), 0)
    fill = lambda query, value: F.replace(F.lit(query), F.lit("{}"), value)
    forms = [*((name, said.rlike(rule), F.btrim(F.regexp_extract(said, rule, 1)), _filtered(q, v, docs) if docs else q) for name, rule, v, q in FORMS)]
    forms.append(("keyword", word.isNotNull(), word, _filtered(KEYWORD, "n", docs) if docs else KEYWORD))
    form, query = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, fits, value, q in reversed(forms):
        form, query = F.when(fits, name).otherwise(form), F.when(fits, fill(q, value)).otherwise(query)
    out = questions.withColumns({"form": form, "query": query})
    return out.withColumn("status", F.when(F.col("query").isNull(), "no query").when(T.query_shape("query"), "ok").otherwise("error"))


def answer_prompts(rows: DataFrame, question_col: str = "question", context_col: str = "context") -> DataFrame:
    """With ``prompt``: the question, the rows found and the task."""
    text = F.concat(F.lit("Question: "), F.col(question_col), F.lit("\n\nKnowledge Graph Data:\n"), F.col(context_col), F.lit("\n\nAnswer the question based on the KG data above. Respond in formal Indonesian (Bahasa Indonesia)."))
    return rows.withColumn("prompt", text)


def answered_from(prompts: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """With (answer, status, error): recorded answers, trimmed; without one the answer is empty and the status "error"."""
    out = replayed(prompts, recorded, key)
    return out.withColumns({"status": F.when(F.col("error").isNull(), "ok").otherwise("error"), "answer": F.coalesce(T.stripped("answer"), F.lit(""))})


def schema_prompt(template: str, schema: str | None = None, sheet: DataFrame | None = None, schema_id: str | None = None, **values: str) -> str:
    """A template with {kg_schema} and further names replaced. The schema is the text given, else the sheet's row of the id
    (SCHEMA_ID, SCHEMA_TEXT), else the closed world's own tables; KeyError for an id that the sheet lacks."""
    if schema is None and sheet is not None and schema_id is not None:
        found = sheet.where(F.col("SCHEMA_ID") == schema_id).select("SCHEMA_TEXT").limit(1).collect()
        if not found:
            raise KeyError(schema_id)
        schema = found[0][0]
    return filled_prompt(template, kg_schema=model.ontology_markdown() if schema is None else schema, **values)


def augmented(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """(question, query, category) of the samples in JSON answers, each question once; samples without both texts go."""
    kind = "struct<samples:array<struct<question:string,cypher:string,category:string>>>"
    rows = answers.select(F.inline(F.from_json(F.to_json(T.parsed_json(answer_col)), kind)["samples"]))
    rows = rows.select(T.stripped("question").alias("question"), T.stripped("cypher").alias("query"), F.coalesce("category", F.lit("")).alias("category"))
    return rows.where("question <> '' and query <> ''").groupBy("question").agg(F.min(F.struct("query", "category")).alias("s")).select("question", "s.query", "s.category")


def judged_answers(rows: DataFrame, judged_col: str = "answer", predicted_col: str = "predicted") -> DataFrame:
    """With (score, is_hallucination) from a judge's JSON answers. A failed prediction scores 0 and counts as invented; an
    answer that can't be read scores 0 and doesn't; scores are 0, 1 or 2."""
    body = T.parsed_json(judged_col)
    failed = F.startswith(F.col(predicted_col), F.lit("[ERROR]"))
    score = F.least(F.greatest(F.coalesce(F.try_variant_get(body, "$.score", "int"), F.lit(0)), F.lit(0)), F.lit(2))
    invented = F.coalesce(F.try_variant_get(body, "$.is_hallucination", "boolean"), F.lit(False))
    return rows.withColumns({"score": F.when(failed, 0).otherwise(score), "is_hallucination": failed | invented})


def soft_overlap(expected: Column, predicted: Column) -> dict[str, Column]:
    """precision, recall and f1 of words that each find an equal one on the other side: the offline form of a score by
    word vectors, where only equal words are alike. Two empty texts score 1, one empty text 0."""
    a, b = T.words(F.lower(expected)), T.words(F.lower(predicted))
    share = lambda x, y: F.when(F.size(x) == 0, (F.size(y) == 0).cast("double")).otherwise(F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.size(x))
    p, r = share(b, a), share(a, b)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}
