"""Literal scan, sweep and line-count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linecount, textscan
from . import views
from .registry import query

REF, NEW_REF = "example.net", "example.dev"
# Stand-ins for comment marks: the texts hold no program code.
LANG_MARKS = {"en": "Th", "de": "Ei", "fr": "Le", "es": "Ci"}

# Lines of a text: the empty piece after a final newline is no line.
PAGE_LINES = """
    WITH v_file AS (SELECT page_id, url, string_split(CASE WHEN right(html, 1) = chr(10)
                           THEN left(html, length(html) - 1) ELSE html END, chr(10)) AS parts FROM pages),
    v_line AS (SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 2) AS repo,
                      generate_subscripts(parts, 1) AS line_no, unnest(parts) AS text FROM v_file)
"""


def _pages(t):
    segment = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    return t.pages.select("page_id", F.try_element_at(segment, F.lit(2)).alias("repo"),
                          F.col("html").alias("text"))


@query("q26_ref_scan", PAGE_LINES + f"""
    SELECT page_id, line_no, text, replace(text, '{REF}', '{NEW_REF}') AS replaced
    FROM v_line WHERE contains(text, '{REF}')""")
def ref_scan(t):
    return textscan.find_literal(_pages(t).drop("repo"), REF, NEW_REF)


@query("q26b_replaced_files", f"""
    SELECT page_id, replace(html, '{REF}', '{NEW_REF}') AS text FROM pages
    WHERE contains(html, '{REF}')""")
def replaced_files(t):
    return textscan.replace_in_files(_pages(t).drop("repo"), REF, NEW_REF)


@query("q27_ref_sweep", PAGE_LINES + f""",
    v_count AS (SELECT repo, count(*) FILTER (WHERE contains(text, '{REF}')) AS matches,
                       count(DISTINCT page_id) FILTER (WHERE contains(text, '{REF}')) AS files
                FROM v_line GROUP BY repo)
    SELECT r.repo, coalesce(matches, 0) AS matches, coalesce(files, 0) AS files,
           CASE WHEN matches IS NULL THEN 'skip' WHEN matches = 0 THEN 'ok' ELSE 'hit' END AS outcome
    FROM (SELECT DISTINCT lang AS repo FROM documents UNION ALL SELECT 'xx' UNION ALL
          SELECT DISTINCT source FROM documents) r LEFT JOIN v_count c ON r.repo = c.repo""")
def ref_sweep(t):
    listed = t.documents.select(F.explode(F.array("lang", "source", F.lit("xx"))).alias("repo"))
    return textscan.sweep(_pages(t), listed, REF)


@query("q27b_scan_totals", PAGE_LINES + f"""
    SELECT count(*) AS matches, count(DISTINCT page_id) AS files FROM v_line WHERE contains(text, '{REF}')""")
def scan_totals(t):
    return textscan.scan_totals(_pages(t), REF)


@query("q28_line_count", """
    WITH v_file AS (SELECT doc_id, lang, string_split(CASE WHEN right(text, 1) = chr(10)
                           THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts FROM documents),
    v_line AS (SELECT doc_id, lang, unnest(parts) AS text FROM v_file),
    v_kind AS (SELECT doc_id, lang, trim(text) = '' AS is_blank,
                      CASE lang WHEN 'en' THEN starts_with(trim(text), 'Th') WHEN 'de' THEN starts_with(trim(text), 'Ei')
                           WHEN 'fr' THEN starts_with(trim(text), 'Le') WHEN 'es' THEN starts_with(trim(text), 'Ci')
                           ELSE FALSE END AS is_comment FROM v_line)
    SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS language,
           count(DISTINCT doc_id) AS files, count(*) FILTER (WHERE is_blank) AS blank,
           count(*) FILTER (WHERE is_comment) AS comment,
           count(*) FILTER (WHERE NOT is_blank AND NOT is_comment) AS code
    FROM v_kind GROUP BY ROLLUP (lang)""")
def line_count(t):
    return textscan.line_counts(views.docs(t), LANG_MARKS, language="lang")


@query("q28b_wanted_files", """
    SELECT doc_id, source || '/' || lang || '/f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.min.js'
           WHEN doc_id % 3 = 1 THEN '.py' ELSE '.yml' END AS path,
           CASE WHEN doc_id % 3 = 1 THEN 'Python' ELSE 'YAML' END AS language
    FROM documents WHERE doc_id % 3 <> 0 AND lang <> 'de'""")
def wanted_files(t):
    """Folder, extension and language filters on paths made from the documents."""
    end = F.when(F.col("doc_id") % 3 == 0, ".min.js").when(F.col("doc_id") % 3 == 1, ".py").otherwise(".yml")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("f"), "doc_id", end))
    files = t.documents.select("doc_id", path.alias("path"))
    wanted = textscan.outside_dirs(F.col("path"), ["de"]) & textscan.lacks_extension(
        F.col("path"), textscan.COUNT_EXCLUDED_EXTENSIONS)
    return files.where(wanted).withColumn("language", textscan.language_of(F.col("path")))


# Source files made of the tables: texts inside and beside comments, marks inside strings, and the pages as they are.
SOURCE_SQL = r"""
    WITH v_doc AS (SELECT doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10)) AS t FROM documents),
    v_file AS (
        SELECT CASE doc_id % 3 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'CSS' ELSE 'YAML' END AS language,
               CASE doc_id % 3
               WHEN 0 THEN '/* ' || t || ' */ let a = 1 // /*' || chr(10) || chr(10) || 'let s = "/* ";' || chr(10) || t || chr(10) || '/* open' || chr(10) || t
               WHEN 1 THEN 'a { content: "/*" }' || chr(10) || t || '/* ' || t || '*/' || chr(10)
               ELSE '# ' || t END AS text FROM v_doc
        UNION ALL SELECT 'HTML', CASE WHEN page_id % 2 = 0 THEN '<!-- ' ELSE '' END || replace(coalesce(html, ''), '><', '>' || chr(10) || '<') FROM pages),
    v_piece AS (SELECT language, text, CASE language
        WHEN 'JavaScript' THEN regexp_extract_all(text, '/[*].*?(?:[*]/|\z)|//[^\n]*|"(?:[^"\\\n]|\\.)*"?|\x27(?:[^\x27\\\n]|\\.)*\x27?|`(?:[^`\\]|\\.)*`?|[^/"\x27`]+|.', 0, 's')
        WHEN 'CSS' THEN regexp_extract_all(text, '/[*].*?(?:[*]/|\z)|"(?:[^"\\\n]|\\.)*"?|\x27(?:[^\x27\\\n]|\\.)*\x27?|[^/"\x27]+|.', 0, 's')
        WHEN 'HTML' THEN regexp_extract_all(text, '<!--.*?(?:-->|\z)|[^<]+|.', 0, 's')
        ELSE regexp_extract_all(text, '#[^\n]*|[^#]+', 0, 's') END AS pieces FROM v_file),
    v_bare AS (SELECT language, text, array_to_string(list_transform(pieces, lambda p:
        CASE WHEN CASE language WHEN 'JavaScript' THEN starts_with(p, '/*') OR starts_with(p, '//') WHEN 'CSS' THEN starts_with(p, '/*')
                                WHEN 'HTML' THEN starts_with(p, '<!--') ELSE starts_with(p, '#') END
             THEN regexp_replace(p, '[^\n]+', '', 'g') ELSE p END), '') AS bare FROM v_piece),
    v_count AS (SELECT language,
        len(list_filter(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> '')) AS filled,
        CASE WHEN text = '' THEN 0 ELSE len(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) END AS lines,
        len(list_filter(string_split(bare, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> '')) AS code FROM v_bare)
    SELECT CASE WHEN grouping(language) = 1 THEN 'TOTAL' ELSE language END AS language, count(*) AS files,
           CAST(sum(lines - filled) AS BIGINT) AS blank, CAST(sum(filled - code) AS BIGINT) AS comment, CAST(sum(code) AS BIGINT) AS code
    FROM v_count GROUP BY ROLLUP (language)"""


@query("q28c_block_comments", SOURCE_SQL)
def block_comments(t):
    """Line counts of source files with block comments, strings and pages."""
    doc, page = F.col("doc_id") % 3, F.coalesce("html", F.lit(""))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))
    script = F.concat(F.lit("/* "), body, F.lit(' */ let a = 1 // /*\n\nlet s = "/* ";\n'), body, F.lit("\n/* open\n"), body)
    style = F.concat(F.lit('a { content: "/*" }\n'), body, F.lit("/* "), body, F.lit("*/\n"))
    sources = t.documents.select(
        F.when(doc == 0, "JavaScript").when(doc == 1, "CSS").otherwise("YAML").alias("language"),
        F.when(doc == 0, script).when(doc == 1, style).otherwise(F.concat(F.lit("# "), body)).alias("text"))
    html = F.replace(page, F.lit("><"), F.lit(">\n<"))
    pages = t.pages.select(F.lit("HTML").alias("language"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<!-- "), html)).otherwise(html).alias("text"))
    return linecount.source_line_counts(sources.union(pages))
