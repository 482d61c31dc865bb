"""Cleaning, lines, hierarchy, chunks and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as T
from graphloom.operators import chunking, references, structure
from graphloom.registry import query
from graphloom.sources.cases import RULE_BOOK_SQL, case_sql, case_text, rule_book
from graphloom.sources.legal_text import LEGAL_SQL, legal_lines
from graphloom.sources.tables import table

L = "WITH" + LEGAL_SQL
Spark = SparkSession
_WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"


def _docs(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _parsed(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.components(legal_lines(spark, sf_dir))


def _segments(spark: Spark, sf_dir: str) -> DataFrame:
    """Each line of a document as a segment of its own."""
    lines = _doc_lines(spark, sf_dir).where(T.stripped("text") != "")
    return lines.select("document_id", F.col("line_no").alias("ord"), F.concat_ws("-", "document_id", "line_no").alias("component_id"), F.lit("PASAL").alias("component_type"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "text")


def _doc_lines(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.page_lines(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text"))


_PAGES = ("<p>{}</p>", "<p>" + "long enough " * 5 + "{}</p>", "", "  <b> </b> <i>{}</i>")


@query(f"""WITH p AS (SELECT page_id, html FROM pages UNION ALL SELECT -p_partkey, {case_sql(_PAGES)} FROM part)
SELECT page_id, length(trim(t, E' \\t\\n\\r\\x0b\\x0c')) < 50 AS scanned FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM p)""")
def scanned_page_flag(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "html").unionByName(table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("page_id"), case_text(_PAGES).alias("html")))
    return rows.select("page_id", T.is_scanned(F.regexp_replace("html", "<[^>]*>", "")).alias("scanned"))


@query("SELECT page_id, length(CASE WHEN length(url) % 2 = 0 THEN url ELSE coalesce(html, '') END)::INT AS n FROM pages")
def pick_text(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("scanned", F.length("url") % 2 == 0)
    return rows.select("page_id", F.length(F.coalesce(F.when(F.col("scanned"), F.col("url")).otherwise(F.col("html")), F.lit(""))).alias("n"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), E' \t\n\r\x0b\x0c') AS text FROM c""")
def src_pdf_text(spark: Spark, sf_dir: str) -> DataFrame:
    from graphloom.sources.adapters import html_text

    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


_BROKEN = r"""SELECT -p_partkey AS doc_id, concat(p_name, CASE p_partkey % 6 WHEN 0 THEN '. . .PRESIDEN  REPUBLIK INDONESIA ' WHEN 1 THEN ' . . . ' WHEN 2 THEN ' - 12 - ' WHEN 3 THEN 'x. . .y' WHEN 4 THEN concat('. .', chr(10), 'presiden republik', chr(10), 'indonesia', chr(10)) ELSE '-7-' END, p_type) AS text FROM part"""


def _with_breaks(spark: Spark, sf_dir: str) -> DataFrame:
    """The documents, and names of parts with the page breaks that scans leave within running text."""
    nth = F.col("p_partkey") % 6
    broken = F.when(nth == 0, ". . .PRESIDEN  REPUBLIK INDONESIA ").when(nth == 1, " . . . ").when(nth == 2, " - 12 - ").when(nth == 3, "x. . .y").when(nth == 4, ". .\npresiden republik\nindonesia\n").otherwise("-7-")
    parts = table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("doc_id"), F.concat("p_name", broken, "p_type").alias("text"))
    return _docs(spark, sf_dir).unionByName(parts)


@query(rf"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL {_BROKEN}),
a AS (SELECT doc_id, regexp_replace(text, '(?i)\.\s*\.\s*\.?\s*PRESIDEN\s+REPUBLIK\s+INDONESIA\s*', '', 'g') AS t FROM d),
b AS (SELECT doc_id, regexp_replace(t, '(^|[^0-9A-Za-z_.])\.\s+\.\s+\.([^0-9A-Za-z_]|$)', '\1\2', 'g') AS t FROM a)
SELECT doc_id, regexp_replace(t, '\s*-\s*\d+\s*-\s*', ' ', 'g') AS text FROM b""")
def strip_inline_artifacts(spark: Spark, sf_dir: str) -> DataFrame:
    return _with_breaks(spark, sf_dir).select("doc_id", T.strip_page_breaks("text").alias("text"))


_FURNITURE = ("{}\n- 7 -\nnext", "Salinan\n{}\nSALINAN\n salinan \nSalinan lain", "{}\nPRESIDEN  REPUBLIK INDONESIA\nwww.hukumonline.com\n.....\n..\n", "LEMBARAN NEGARA REPUBLIK INDONESIA\nTAMBAHAN  LEMBARAN NEGARA Nomor 5\n{}", " 12 \n  \n{} 12\n12 {}")
_UNFURNISHED = ("{}\nnext", "{}\nSalinan lain", "{}\n..\n", "{}", "\n{} 12\n12 {}")


@query(f"SELECT -p_partkey AS doc_id, {case_sql(_UNFURNISHED)} AS text FROM part UNION ALL " + r"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l, E' \t\n\r\x0b\x0c') = '' OR NOT regexp_matches(trim(l, E' \t\n\r\x0b\x0c'), '(?i)(?:^-?\s*\d+\s*-?\s*$)|(?:^www\.hukumonline\.com$)|(?:^Salinan$)|(?:^PRESIDEN\s+REPUBLIK\s+INDONESIA$)|(?:^LEMBARAN\s+NEGARA\s+REPUBLIK\s+INDONESIA$)|(?:^\s*\.{3,}\s*$)|(?:^TAMBAHAN\s+LEMBARAN\s+NEGARA)')),
  lambda l: CASE WHEN trim(l, E' \t\n\r\x0b\x0c') = '' THEN '' ELSE l END), chr(10)) AS text FROM documents""")
def strip_header_lines(spark: Spark, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).unionByName(table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("doc_id"), case_text(_FURNITURE).alias("text")))
    return rows.select("doc_id", T.strip_furniture("text").alias("text"))


@query(r"""SELECT doc_id, trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda l: trim(l, E' \t\n\r\x0b\x0c')), chr(10)), E' \t\n\r\x0b\x0c') AS text FROM documents""")
def normalize_whitespace(spark: Spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalize_whitespace("text").alias("text"))


_NAMES = ("UU Nomor {} Tahun 2008", "POJK {}-POJK.03-2022 salinan", "PP No. {} Tahun 2012", "Perpres Nomor {} Tahun 2022", "Permen Kominfo No {} Tahun 2017", "UU-{}-2016", "catatan (final) {}.v2")
_NAMED = (("UU_{}_2008", "{}/2008", "2008"), ("POJK_{}_2022", "{}/2022", "2022"), ("PP_{}_2012", "{}/2012", "2012"), ("Perpres_{}_2022", "{}/2022", "2022"), ("Permen_Kominfo_{}_2017", "{}/2017", "2017"), ("UU_{}_2016", "{}/2016", "2016"), ("catatan_final_{}_v2", "unknown", "0"))


@query("SELECT c_custkey, {} AS document_id, {} AS number, ({})::INT AS year FROM customer".format(*(case_sql(x, "c_custkey", "c_custkey") for x in zip(*_NAMED, strict=True))))
def parse_filename_metadata(spark: Spark, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", case_text(_NAMES, "c_custkey", "c_custkey").alias("name"))
    return names.select("c_custkey", *(c.alias(k) for k, c in T.file_metadata("name").items()))


_FIRST_PAGES = ("UNDANG-UNDANG REPUBLIK INDONESIA\nNOMOR 1\nTENTANG\n{}\nmore", "Peraturan Otoritas Jasa Keuangan\nNomor 1\nTentang {}", "KEPUTUSAN\nTENTANG {}")


@query(f"""SELECT n_nationkey, {case_sql(("Undang-Undang Nomor 1/2000 tentang {}", "POJK Nomor 1/2000 tentang {}", "none"), "n_nationkey", "n_name")} AS title FROM nation""")
def title_extract(spark: Spark, sf_dir: str) -> DataFrame:
    page = case_text(_FIRST_PAGES, "n_nationkey", "n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", T.title(page, F.lit("1/2000"), F.lit("none")).alias("title"))


@query("""SELECT doc_id::VARCHAR AS document_id, (unnest(range(0, len(string_split(text, chr(10))))))::BIGINT AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents""")
def merge_pages_to_lines(spark: Spark, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).select("document_id", F.col("line_no").cast("long"), "text")


_EXPLAINED = ("{}\nPENJELASAN\nATAS", "{}\nisi\n  penj.lasan \nx\ny\nPERATURAN", "{}\nPENJELASAN\nx\ny\nz\nATAS", "PENJELASAN {}\nATAS", "{}\nPENJEIASN\nundang-undang\nPENJELASAN\nATAS", "{}\nPENGELASAN\nATAS")


@query(f"""SELECT concat('part-', p_partkey) AS document_id, ({case_sql(("1", "2", None, None, "1", None))})::BIGINT AS start FROM part WHERE p_partkey % 6 IN (0, 1, 4)
UNION ALL SELECT document_id, min(line_no)::BIGINT AS start FROM (SELECT doc_id::VARCHAR AS document_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE t = 'PENJELASAN' GROUP BY 1""")
def explanation_boundary(spark: Spark, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("document_id"), F.lit(1).alias("page_number"), case_text(_EXPLAINED).alias("text"))
    return structure.explanation_start(_doc_lines(spark, sf_dir).unionByName(structure.page_lines(made))).select("document_id", F.col("start").cast("long"))


_BOOK_ID = "concat(document_id, '__', {})"


@query(f"WITH {RULE_BOOK_SQL} SELECT document_id, ord, component_type, number, title, {_BOOK_ID.format('id')} AS component_id, CASE WHEN parent IS NOT NULL THEN {_BOOK_ID.format('parent')} END AS parent_id, content, is_explanation FROM book")
def rule_book_components(spark: Spark, sf_dir: str) -> DataFrame:
    rows = structure.components(rule_book(spark, sf_dir))
    return rows.select("document_id", F.col("ord").cast("int").alias("ord"), "component_type", "number", "title", "component_id", "parent_id", F.coalesce("content", F.lit("")).alias("content"), "is_explanation")


@query(L + "SELECT document_id, line_no, CASE WHEN n = -1 AND k = 1 THEN 'BAB' WHEN n >= 0 AND k = -1 THEN 'PASAL' WHEN n >= 0 THEN 'AYAT' END AS kind FROM legal")
def classify_line(spark: Spark, sf_dir: str) -> DataFrame:
    return legal_lines(spark, sf_dir).select("document_id", F.col("line_no").cast("long"), T.line_type("text").alias("kind"))


@query(L + "SELECT document_id, line_no FROM legal WHERE n = -1 AND k = 2")
def header_title_lookahead(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.classified(legal_lines(spark, sf_dir)).where("is_title").select("document_id", F.col("line_no").cast("long"))


@query(L + "SELECT document_id, component_type, number, content FROM comp")
def sectionize(spark: Spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("document_id", "component_type", "number", F.coalesce("content", F.lit("")).alias("content"))


@query(L + "SELECT document_id, component_type, number, parent_id FROM comp")
def hierarchy_parent(spark: Spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("document_id", "component_type", "number", "parent_id")


@query(L + "SELECT document_id, component_id FROM comp")
def component_id(spark: Spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("document_id", "component_id")


@query(L + "SELECT document_id, parent_id, string_agg(component_id, ',' ORDER BY line_no) AS children FROM comp WHERE parent_id IS NOT NULL GROUP BY ALL")
def children_list(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.children(_parsed(spark, sf_dir))


@query(L + "SELECT document_id, component_type, count(*) AS n FROM comp GROUP BY ALL")
def component_type_counts(spark: Spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).groupBy("document_id", "component_type").agg(F.count("*").alias("n"))


@query(L + """, c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS ord FROM comp)
SELECT document_id, ord, concat(CASE component_type WHEN 'BAB' THEN '' ELSE '      ' END, component_type, ' ', number, ' ', substring(content, 1, 60)) AS line FROM c WHERE component_type IN ('BAB', 'PASAL')""")
def tree_print(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.tree_lines(_parsed(spark, sf_dir), depth=4)


@query(f"SELECT doc_id, floor({_WORDS.format('text')} * 1.3::DOUBLE)::INT AS n FROM documents")
def count_tokens(spark: Spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.count_tokens("text").alias("n"))


@query(L + "SELECT document_id, component_id, concat('Ayat (', number, ')', chr(10), content) AS text FROM comp WHERE content <> ''")
def collect_segments(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.segments(_parsed(spark, sf_dir)).select("document_id", "component_id", "text")


_SLIDING = f"""WITH RECURSIVE lines AS (SELECT doc_id::VARCHAR AS d, unnest(range(0, len(ls))) AS ln, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS MATERIALIZED (SELECT d, concat(d, '-', ln) AS own, t, {_WORDS.format('t')} AS n, row_number() OVER (PARTITION BY d ORDER BY ln) AS r FROM lines WHERE trim(t, E' \\t\\n\\r\\x0b\\x0c') <> ''),
f AS (SELECT d, 0::BIGINT AS r, '' AS buf, 0::BIGINT AS n, '' AS owner, NULL::VARCHAR AS piece, NULL::VARCHAR AS piece_owner, false AS cut FROM s WHERE r = 1
  UNION ALL SELECT d, r, CASE WHEN fits OR (buf <> '' AND NOT enough) THEN joined WHEN buf <> '' THEN concat(tail, chr(10), chr(10), t) ELSE '' END,
    CASE WHEN fits OR (buf <> '' AND NOT enough) THEN n + k WHEN buf <> '' THEN least(n, 76) + k ELSE 0 END,
    CASE WHEN fits THEN CASE WHEN owner = '' THEN own ELSE owner END WHEN buf <> '' THEN own ELSE owner END,
    CASE WHEN NOT fits AND buf <> '' AND enough THEN trim(buf, E' \\t\\n\\r\\x0b\\x0c') WHEN NOT fits AND buf = '' THEN t END, CASE WHEN NOT fits AND buf <> '' AND enough THEN owner WHEN NOT fits AND buf = '' THEN own END, NOT fits AND buf = ''
  FROM (SELECT f.d, s.r, f.buf, f.n, f.owner, s.t, s.own, s.n AS k, floor((f.n + s.n) * 1.3::DOUBLE) <= 800 AS fits, floor(f.n * 1.3::DOUBLE) >= 400 AS enough,
      CASE WHEN f.buf = '' THEN s.t ELSE trim(concat(f.buf, chr(10), chr(10), s.t), E' \\t\\n\\r\\x0b\\x0c') END AS joined,
      array_to_string(list_filter(string_split_regex(f.buf, '\\s+'), lambda w: w <> '')[-76:], ' ') AS tail FROM f JOIN s ON s.d = f.d AND s.r = f.r + 1)),
made AS (SELECT d, r, 0 AS part, piece AS text, piece_owner AS owner FROM f WHERE piece IS NOT NULL AND NOT cut
  UNION ALL SELECT d, r, i // 539, array_to_string(w[i + 1 : i + 615], ' '), piece_owner FROM (SELECT d, r, piece_owner, w, unnest(range(0, len(w), 539)) AS i FROM (SELECT *, list_filter(string_split_regex(piece, '\\s+'), lambda w: w <> '') AS w FROM f WHERE cut))
  UNION ALL SELECT d, r + 1, 0, trim(buf, E' \\t\\n\\r\\x0b\\x0c'), owner FROM f WHERE buf <> '' AND r = (SELECT max(s.r) FROM s WHERE s.d = f.d)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY r, part) - 1 AS i FROM made)
SELECT d AS document_id, i::INT AS chunk_index, concat(d, '__chunk_', format('{{:03d}}', i)) AS chunk_id, text, floor({_WORDS.format('text')} * 1.3::DOUBLE)::INT AS token_count, owner, 'PASAL' AS owner_type, '1' AS pages FROM numbered"""


@query(_SLIDING)
def chunk_sliding(spark: Spark, sf_dir: str) -> DataFrame:
    return chunking.sliding(_segments(spark, sf_dir))


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 539)) AS i FROM w)
SELECT doc_id, i // 539 AS piece, array_to_string(w[i + 1 : i + 615], ' ') AS text FROM s""")
def split_large_text(spark: Spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.windows("text")).alias("piece", "text")).withColumn("piece", F.col("piece").cast("long"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id, array_to_string(w[greatest(len(w) - 76, 0) + 1 :], ' ') AS text FROM w""")
def tail_overlap(spark: Spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunking.tail("text").alias("text"))


_STRUCTURE = "WITH RECURSIVE" + LEGAL_SQL + f""", kids AS (SELECT parent_id AS pasal, string_agg(concat('(', number, ') ', content), chr(10) ORDER BY line_no) AS kids FROM comp WHERE component_type = 'AYAT' GROUP BY 1),
art AS (SELECT document_id AS d, parent_id AS bab, page, concat('Pasal ', number, coalesce(chr(10) || kids, '')) AS t, row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS r FROM comp LEFT JOIN kids ON pasal = component_id WHERE component_type = 'PASAL'),
a AS MATERIALIZED (SELECT art.*, {_WORDS.format('t')} AS n, concat('[DOKUMEN: ', art.d, ']', chr(10), '[BAB: BAB ', (SELECT number FROM comp b WHERE b.component_id = bab), ' ', (SELECT text FROM legal WHERE legal.document_id = art.d AND legal.n = -1 AND legal.k = 2), ']', chr(10), '---', chr(10)) AS head FROM art),
w AS MATERIALIZED (SELECT d, bab, any_value(head) AS head, {_WORDS.format('any_value(head)')} AS hn, concat(any_value(head), string_agg(t, chr(10) || chr(10) ORDER BY r)) AS whole, sum(n) AS n, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages, max(r) AS last FROM a GROUP BY 1, 2),
f AS (SELECT d, 0::BIGINT AS r, '' AS held, hn AS n, []::BIGINT[] AS pp, NULL::VARCHAR AS piece, NULL::BIGINT[] AS piece_pp FROM w WHERE floor((w.n + hn) * 1.3::DOUBLE) > 3000
  UNION ALL SELECT f.d, a.r, CASE WHEN over THEN concat(chr(10), chr(10), a.t) ELSE concat(f.held, chr(10), chr(10), a.t) END, CASE WHEN over THEN w.hn + a.n ELSE f.n + a.n END, CASE WHEN over THEN [a.page] ELSE list_append(f.pp, a.page) END, CASE WHEN over THEN f.held END, CASE WHEN over THEN f.pp END
  FROM (SELECT f.*, f.held <> '' AND floor((f.n + x.n) * 1.3::DOUBLE) > 3000 AS over FROM f JOIN a x ON x.d = f.d AND x.r = f.r + 1) f JOIN a ON a.d = f.d AND a.r = f.r + 1 JOIN w ON w.d = f.d),
made AS (SELECT d, 0 AS r, whole AS text, (SELECT list(page) FROM a WHERE a.d = w.d) AS pp FROM w WHERE floor((w.n + hn) * 1.3::DOUBLE) <= 3000
  UNION ALL SELECT f.d, r, concat(head, piece), piece_pp FROM f JOIN w ON w.d = f.d WHERE piece IS NOT NULL
  UNION ALL SELECT f.d, r + 1, concat(head, held), pp FROM f JOIN w ON w.d = f.d WHERE r = last),
numbered AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY r) - 1 AS i FROM made)
SELECT d AS document_id, i::INT AS chunk_index, concat(d, '__struct_chunk_', format('{{:03d}}', i)) AS chunk_id, text, floor({_WORDS.format('text')} * 1.3::DOUBLE)::INT AS token_count, (SELECT bab FROM w WHERE w.d = numbered.d) AS owner, 'BAB' AS owner_type, array_to_string(list_sort(list_distinct(pp)), ',') AS pages FROM numbered"""


@query(_STRUCTURE)
def chunk_structure_aware(spark: Spark, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir)
    return chunking.structure_aware(rows, structure.article_texts(rows))


@query(L + """, t AS (SELECT document_id, parent_id AS root, component_id, 1 AS depth FROM comp WHERE parent_id IS NOT NULL)
SELECT * FROM t UNION ALL SELECT a.document_id, a.root, b.component_id, 2 FROM t a JOIN t b ON b.root = a.component_id""")
def descendants(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.descendants(_parsed(spark, sf_dir))


@query(L + f""", {RULE_BOOK_SQL} SELECT document_id, component_id, '' AS section FROM comp WHERE component_type = 'PASAL'
UNION ALL SELECT document_id, {_BOOK_ID.format('id')}, CASE id WHEN 'PASAL_1' THEN 'Kesatu Umum' ELSE '' END FROM book WHERE component_type = 'PASAL'""")
def group_by_section(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.by_section(structure.components(legal_lines(spark, sf_dir).unionByName(rule_book(spark, sf_dir))))


@query(L + """, k AS (SELECT parent_id, string_agg(concat('(', number, ') ', content), chr(10) ORDER BY line_no) AS kids FROM comp WHERE component_type = 'AYAT' GROUP BY 1)
SELECT document_id, component_id, concat('Pasal ', number, coalesce(chr(10) || kids, '')) AS text FROM comp LEFT JOIN k ON k.parent_id = component_id WHERE component_type = 'PASAL'""")
def article_text(spark: Spark, sf_dir: str) -> DataFrame:
    return structure.article_texts(_parsed(spark, sf_dir)).select("document_id", "component_id", "text")


@query(f"""WITH t AS (SELECT doc_id::VARCHAR AS document_id, floor({_WORDS.format('unnest(string_split(text, chr(10)))')} * 1.3::DOUBLE)::INT AS k FROM documents)
SELECT document_id, count(*) AS n, min(k) AS min_tokens, max(k) AS max_tokens, round(avg(k), 1) AS avg_tokens FROM t GROUP BY 1""")
def chunk_stats(spark: Spark, sf_dir: str) -> DataFrame:
    return chunking.stats(_doc_lines(spark, sf_dir).select("document_id", T.count_tokens("text").alias("token_count")))


@query("SELECT p_partkey, regexp_replace(translate(regexp_replace(p_name, '\\s+', '', 'g'), 'lIOogGSs', '11008655'), '[^0-9]', '', 'g') AS digits FROM part")
def clean_ocr_number(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_ocr_number("p_name").alias("digits"))


_CITING = (
    "menurut Undang-Undang Nomor 11 Tahun 2008 {}", "UNDANG UNDANG No. 19a Tahun 2016; {}", "{} Peraturan Pemerintah Nomor 71 Tahun 2019", "Peraturan  Presiden No 95 Tahun 2018 {}", "{}: Peraturan Menteri Kominfo Nomor 5 Tahun 2020.",
    "Ketentuan Pasal 27 diubah {}", "Pasal 45A tetap dengan perubahan {}", "Di antara Pasal 45 dan Pasal 46 disisipkan {}", "Pasal 54 dihapus, Pasal 55 dihapus {}", "sebagaimana dimaksud pada Pasal 28B {}", "tanpa rujukan {}",
)
#: What each text holds: (turn, pattern, type, prefix, number, year, text, place); without a place it stands after the name and one or two signs.
_CITED = (
    (0, "UU_REF", "MERUJUK_DOKUMEN", "UU", "11", "2008", "Undang-Undang Nomor 11 Tahun 2008", 8), (1, "UU_REF", "MERUJUK_DOKUMEN", "UU", "19a", "2016", "UNDANG UNDANG No. 19a Tahun 2016", 0),
    (2, "PP_REF", "MERUJUK_DOKUMEN", "PP", "71", "2019", "Peraturan Pemerintah Nomor 71 Tahun 2019", None), (3, "PERPRES_REF", "MERUJUK_DOKUMEN", "Perpres", "95", "2018", "Peraturan  Presiden No 95 Tahun 2018", 0),
    (4, "PERMEN_REF", "MERUJUK_DOKUMEN", "Permen", "5", "2020", "Peraturan Menteri Kominfo Nomor 5 Tahun 2020", None), (5, "AMEND_UBAH", "MENGUBAH_PASAL", None, "27", None, "Ketentuan Pasal 27 diubah", 0),
    (6, "AMEND_UBAH", "MENGUBAH_PASAL", None, "45A", None, "Pasal 45A tetap dengan perubahan", 0), (7, "AMEND_SISIP", "MENYISIPKAN_PASAL", None, "45", "46", "Di antara Pasal 45 dan Pasal 46 disisipkan", 0),
    (8, "AMEND_HAPUS", "MENGHAPUS_PASAL", None, "54", None, "Pasal 54 dihapus", 0), (8, "AMEND_HAPUS", "MENGHAPUS_PASAL", None, "55", None, "Pasal 55 dihapus", 18), (9, "INTERNAL_PASAL_REF", "MERUJUK_PASAL", None, "28B", None, "sebagaimana dimaksud pada Pasal 28B", 0),
)


def _citing(spark: Spark, sf_dir: str) -> DataFrame:
    """(document_id, component_id, text): names of parts in texts that cite in every way."""
    return table(spark, sf_dir, "part").select(F.lit("parts").alias("document_id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("component_id"), case_text(_CITING).alias("text"))


def _refs(spark: Spark, sf_dir: str) -> DataFrame:
    lines = legal_lines(spark, sf_dir).withColumn("component_id", F.concat_ws("-", "document_id", "line_no"))
    return references.detected(lines)


_REFS = """, refs AS (SELECT document_id, concat(document_id, '-', line_no) AS component_id, 'MERUJUK_DOKUMEN' AS type, 'UU_REF' AS pattern, 'UU' AS prefix, regexp_extract(text, 'Nomor (\\d+) Tahun (\\d+)', 1) AS number, regexp_extract(text, 'Nomor (\\d+) Tahun (\\d+)', 2) AS year, concat('Undang-Undang Nomor ', regexp_extract(text, 'Nomor (\\d+) Tahun (\\d+)', 1), ' Tahun 2000') AS source_text FROM legal WHERE n >= 0 AND k >= 0
  UNION ALL SELECT document_id, concat(document_id, '-', line_no), 'MERUJUK_PASAL', 'INTERNAL_PASAL_REF', NULL, (n + 1)::VARCHAR, NULL, concat('sebagaimana dimaksud dalam Pasal ', n + 1) FROM legal WHERE n >= 0 AND k >= 0)"""


_CITED_SQL = "(VALUES {}) AS v(k, pattern, type, prefix, number, year, source_text, place) JOIN part ON p_partkey % {} = k".format(", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in _CITED), len(_CITING))


@query(L + _REFS + f"SELECT * FROM refs UNION ALL SELECT 'parts', concat('part-', p_partkey), type, pattern, prefix, number, year::VARCHAR, source_text FROM {_CITED_SQL}")
def detect_references(spark: Spark, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).unionByName(references.detected(_citing(spark, sf_dir)))


@query(L + f"""SELECT document_id, concat(document_id, '-', line_no) AS component_id, 'UU_REF' AS pattern, (position('Undang' IN text) - 1)::INT AS match_position FROM legal WHERE n >= 0 AND k >= 0
UNION ALL SELECT document_id, concat(document_id, '-', line_no), 'INTERNAL_PASAL_REF', (position('sebagaimana' IN text) - 1)::INT FROM legal WHERE n >= 0 AND k >= 0
UNION ALL SELECT 'parts', concat('part-', p_partkey), pattern, coalesce(place, length(p_name) + k // 2)::INT FROM {_CITED_SQL}""")
def reference_positions(spark: Spark, sf_dir: str) -> DataFrame:
    lines = legal_lines(spark, sf_dir).select("document_id", F.concat_ws("-", "document_id", "line_no").alias("component_id"), "text")
    return references.positions(lines.unionByName(_citing(spark, sf_dir)))


@query(L + _REFS + "SELECT component_id, concat(prefix, '_', number, '_', year) AS target_doc_id, concat(prefix, '_', number, '_', year) IN (SELECT document_id FROM legal WHERE document_id <> 'UU_3_2000') AS is_known FROM refs WHERE prefix IS NOT NULL")
def resolve_reference(spark: Spark, sf_dir: str) -> DataFrame:
    known = legal_lines(spark, sf_dir).select(F.col("document_id").alias("doc_id")).distinct().where("doc_id <> 'UU_3_2000'")
    return references.resolved(_refs(spark, sf_dir).where("prefix is not null"), known).select("component_id", "target_doc_id", "is_known")


@query(L + _REFS + "SELECT type, count(*) AS n FROM refs GROUP BY 1")
def reference_summary(spark: Spark, sf_dir: str) -> DataFrame:
    return references.summary(_refs(spark, sf_dir))
