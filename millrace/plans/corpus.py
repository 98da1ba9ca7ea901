"""Corpus preparation, bound to pages as markdown and to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import corpus
from millrace.plans.registry import query
from millrace.sources.readers import table

# (pattern, replacement) from HTML to markdown lines, in order; groups are written for Spark.
_REWRITES = [
    ("<h1[^>]*>([^<]*)</h1>", "\n# $1\n"),
    ("<h2[^>]*>([^<]*)</h2>", "\n## $1\n"),
    ("<h3[^>]*>([^<]*)</h3>", "\n### $1\n"),
    ("<li>(?:<a[^>]*>)?([^<]*)(?:</a>)?</li>", "\n| $1 |"),
    ("</ul>|</p>|<br>|</tr>", "\n"),
    ("<[^>]*>", " "),
]


def _markdown(html: Column) -> Column:
    for pattern, by in _REWRITES:
        html = F.regexp_replace(html, pattern, by)
    return html


def _markdown_sql(html: str) -> str:
    for pattern, by in _REWRITES:
        literal = by.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        html = f"regexp_replace({html}, '{pattern}', '{literal}', 'g')"
    return html


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), _markdown(F.col("html")).alias("text"))


MD = f"""WITH md AS (SELECT page_id AS doc_id, {_markdown_sql('html')} AS text FROM pages),
ln AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM md)))
"""
_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query(
    "C1",
    MD.rstrip() + f""", h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN len(regexp_extract(line, '^(#+)', 1)) END AS lvl,
    trim(regexp_extract(line, '^#{{1,6}}\\s+(.*)$', 1)) AS title FROM ln),
  s AS (SELECT *, count(lvl) OVER w AS sec FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
  b AS (SELECT doc_id, sec, {_TRIM.format(x="coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (lvl IS NULL), '')")} AS text,
    max(lvl) AS lvl, max(title) FILTER (lvl IS NOT NULL) AS title FROM s GROUP BY 1, 2),
  p AS (SELECT b.*, (SELECT string_agg(x.title, ' > ' ORDER BY x.lvl) FROM b x WHERE x.doc_id = b.doc_id AND x.sec <= b.sec AND x.lvl IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.sec > x.sec AND y.sec <= b.sec AND y.lvl <= x.lvl)) AS section FROM b)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS place, coalesce(section, '') AS section, md5(text) AS text_md5
  FROM p WHERE text <> ''""",
)
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    found = corpus.sections(pages(spark, sf))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no"))
    return found.select(
        "doc_id", place.cast("bigint").alias("place"), "section", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


@query("C2 X22 D6")
def page_windows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.windows(corpus.sections(pages(spark, sf)))


@query("C2 C6 X22 X27")
def manual_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a frontmatter block made from their own columns."""
    head = F.concat(
        F.lit("---\ntitle: "), F.concat(F.lit("Doc "), "doc_id"), F.lit("\nsource_type: "), "source",
        F.lit("\nequipment: "), F.upper("lang"), F.lit("\n---\n"),
    )
    docs = table(spark, sf, "documents").select(
        F.concat("doc_id", F.lit(".md")).alias("document"),
        F.col("doc_id").cast("string").alias("stem"),
        F.lit("manuals").alias("folder"),
        F.concat(head, F.col("text")).alias("text"),
    )
    return corpus.manual_chunks(docs)


_CONTRACT = """'---' || chr(10) || 'contract_id: C-' || doc_id || chr(10) || 'product: ' || source || chr(10) || '---' || chr(10) || text"""


@query(
    "C3 C6 X22",
    """SELECT 'C-' || doc_id || '::ART-' || n AS clause_id, 'ART-' || n AS article, source AS product, lang AS heading,
      md5(source || ' (C-' || doc_id || ', version n/a)' || chr(10) || 'ART-' || n || ' - ' || lang || chr(10) || chr(10) || body) AS context_md5
    FROM (SELECT doc_id, source, lang, unnest(range(1, len(l) + 1)) AS n, l, regexp_replace(l[unnest(range(1, len(l) + 1))], '^\\s+|\\s+$', '', 'g') AS body
      FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)) WHERE body <> ''""",
)
def contract_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as contracts: every line becomes a numbered clause."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(F.lit("### ART-"), i + 1, F.lit(" — "), F.col("lang"), F.lit("\n"), line),
    )
    head = F.concat(F.lit("---\ncontract_id: C-"), "doc_id", F.lit("\nproduct: "), "source", F.lit("\n---\n"))
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("stem"), F.concat(head, F.array_join(lines, "\n")).alias("text")
    )
    found = corpus.clauses(docs)
    return found.select(
        "clause_id", "article", "product", "heading",
        F.md5(corpus.clause_context(found).cast("binary")).alias("context_md5"),
    )


@query(
    "C4",
    MD.rstrip() + f""", k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,3}}\\s') THEN 'heading' WHEN ltrim(line) LIKE '|%' THEN 'table' ELSE 'text' END AS kind,
    trim(regexp_replace(line, '^[# ]+|[# ]+$', '', 'g')) AS title FROM ln),
  k2 AS (SELECT *, count(*) FILTER (kind = 'heading') OVER w AS hno, count(*) FILTER (kind = 'text') OVER w AS tno FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
  hd AS (SELECT doc_id, hno, title FROM k2 WHERE kind = 'heading'),
  nx AS (SELECT doc_id, tno, hno FROM k2 WHERE kind = 'text'),
  lasth AS (SELECT doc_id, max(hno) AS hno FROM k2 GROUP BY 1),
  -- a text block is one heading number between tables; a table block is one count of text lines
  kk AS (SELECT k2.*, CASE WHEN kind = 'table' THEN coalesce(nx.hno, lasth.hno) ELSE k2.hno END AS h,
    count(*) FILTER (kind = 'table') OVER (PARTITION BY k2.doc_id ORDER BY line_no) AS tb
    FROM k2 LEFT JOIN nx ON kind = 'table' AND nx.doc_id = k2.doc_id AND nx.tno = k2.tno + 1 JOIN lasth ON lasth.doc_id = k2.doc_id WHERE kind <> 'heading'),
  bl AS (SELECT doc_id, kind, h, CASE WHEN kind = 'table' THEN tno ELSE tb END AS g, min(line_no) AS ln0, string_agg(line, chr(10) ORDER BY line_no) AS raw
    FROM kk GROUP BY 1, 2, 3, 4),
  tx AS (SELECT *, CASE WHEN kind = 'table' THEN raw ELSE {_TRIM.format(x='raw')} END AS text FROM bl),
  wd AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM tx WHERE text <> ''),
  parts AS (SELECT *, unnest(CASE WHEN kind = 'table' OR len(w) <= 60 THEN [0] ELSE range(0, len(w), 10) END) AS s FROM wd)
  SELECT parts.doc_id, coalesce(hd.title, 'Intro') AS heading, kind AS type,
    md5(CASE WHEN kind = 'table' OR len(w) <= 60 THEN text ELSE array_to_string(w[s + 1:s + 60], ' ') END) AS text_md5
  FROM parts LEFT JOIN hd ON hd.doc_id = parts.doc_id AND hd.hno = h""",
)
def table_aware_chunks(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.table_aware_chunks(pages(spark, sf), max_tokens=60)
    return found.select("doc_id", "heading", "type", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "C5",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT *, unnest(range(0, len(w), 425)) AS s FROM w)
    SELECT doc_id, s // 425 AS window_no, md5(array_to_string(w[s + 1:s + 500], ' ')) AS text_md5 FROM p""",
)
def fixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.fixed_windows(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


@query(
    "X21",
    """SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*')) AS hyphen_tokens,
    len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-.][a-z0-9]+)*')) AS dotted_tokens,
    len(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) AS word_tokens FROM documents""",
)
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda p: F.size(t.tokens(F.col("text"), p)).cast("bigint")
    return table(spark, sf, "documents").select(
        "doc_id",
        count(t.HYPHEN_TOKENS).alias("hyphen_tokens"),
        count(t.DOTTED_TOKENS).alias("dotted_tokens"),
        count(t.WORD_TOKENS).alias("word_tokens"),
    )


@query(
    "A23",
    """SELECT coalesce(source, 'total') AS source_type, count(DISTINCT lang) AS documents, count(*) AS chunks
    FROM documents GROUP BY GROUPING SETS ((source), ())""",
)
def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.ingest_stats(table(spark, sf, "documents"), "lang", "source")


@query(
    "A22",
    """SELECT source AS contract_id, arg_min(lang, doc_id) AS product, 'std' AS product_line, '1' AS version, 'active' AS status,
    false AS applies_to_all, count(*) AS clauses FROM documents GROUP BY 1""",
)
def contract_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("contract_id"), F.col("lang").alias("product"), F.lit("std").alias("product_line"),
        F.lit("1").alias("version"), F.lit("active").alias("status"), F.lit(False).alias("applies_to_all"),
        F.col("doc_id").alias("piece_no"),
    )
    return corpus.contract_index(rows)


@query(
    "X23 X24 X22 C8",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE source || ' > ' || lang END AS citation,
    CASE source WHEN 'manual' THEN 'CONTROLLED MANUAL' ELSE upper(source) END AS label,
    TRY_CAST(nullif(regexp_extract(text, '[0-9]+'), '') AS DOUBLE) AS first_number, md5(substr(text, 1, 1500)) AS passage_md5,
    'Source ' || source || ' in ' || lang || '.' AS filled FROM documents""",
)
def passage_labels(spark: SparkSession, sf: str) -> DataFrame:
    section = F.when(F.col("lang") != "en", F.col("lang"))
    return table(spark, sf, "documents").select(
        "doc_id",
        t.citation(F.col("source"), section).alias("citation"),
        t.source_label(F.col("source")).alias("label"),
        t.first_integer(F.col("text")).alias("first_number"),
        F.md5(F.substring("text", 1, 1500).cast("binary")).alias("passage_md5"),
        corpus.fill_template("Source {source} in {lang}.", ["source", "lang"]).alias("filled"),
    )
