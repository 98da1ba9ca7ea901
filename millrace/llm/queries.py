"""The registered queries of the operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, collocations, decontamination, html_text, lexical_search, lines, near_duplicates, personal_data, quality_model, quality_rules, repeats, url_filter, warc
from millrace.llm.frames import table

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, '.' || host AS dotted, CASE
      WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN contains(dotted, 'spam-farm') OR contains(path, 'spam-farm')
      OR contains(dotted, 'cheap-pills') OR contains(path, 'cheap-pills')
      OR contains(dotted, 'free-casino') OR contains(path, 'free-casino')
      OR contains(dotted, '.doubleclick.') OR contains(path, '.doubleclick.')
      OR contains(path, '/wp-login.php') OR contains(path, '/cgi-bin/')
      OR regexp_matches(dotted, '.xxx\.', 's') OR regexp_matches(path, '.xxx\.', 's') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


@query(OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query()
def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), TOKENIZER, ("n_tokens", "ids_sha256", "decoded_sha256"))


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_duplicate_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
  FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""


@query(OP10_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM cut
), f1 AS (
  SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(ws) AS w1 FROM pieces) GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), f2 AS (
  SELECT lang, p[1] AS w1, p[2] AS w2, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS p FROM pieces)
  GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, p[1] AS w1, p[2] AS w2, p[3] AS w3, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS p FROM pieces)
  GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), two AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r,
         (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN longer g ON g.lang = c.lang AND g.w1 = c.w1 AND g.w2 = c.w2
  WHERE g.f IS NULL OR 100 * g.f < 50 * c.f
), cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, x1.f AS l1, y1.f AS r1, x2.f AS l2, y2.f AS r2,
         (1000000::HUGEINT * c.f * c.f) // (x1.f::HUGEINT * y1.f) AS s1, (1000000::HUGEINT * c.f * c.f) // (x2.f::HUGEINT * y2.f) AS s2
  FROM f3 c JOIN f1 x1 ON x1.lang = c.lang AND x1.w1 = c.w1 JOIN f2 y1 ON y1.lang = c.lang AND y1.w1 = c.w2 AND y1.w2 = c.w3
  JOIN f2 x2 ON x2.lang = c.lang AND x2.w1 = c.w1 AND x2.w2 = c.w2 JOIN f1 y2 ON y2.lang = c.lang AND y2.w1 = c.w3
), scored AS (
  SELECT * FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, s.n, k.score::BIGINT AS score
FROM ranked k JOIN sizes s ON s.lang = k.lang WHERE k.rank <= 2000
"""


@query(OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), totals AS (
  SELECT count(*) FILTER (len(ws) > 0) AS docs, sum(len(ws))::BIGINT AS terms FROM worded
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), occurring AS (
  SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM worded
), postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM occurring WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings CROSS JOIN totals GROUP BY term
), parts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS part
  FROM postings CROSS JOIN totals
), scores AS (
  SELECT item_id, doc_id, sum(w * part)::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN parts USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query(OP12_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


@query()
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents"))
    plain = F.filter("found", lambda s: s["plain"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    others = [F.array_remove(F.transform(plain, lambda s: s["kind"]), k) for k in personal_data.KINDS]
    counts = [(F.size(plain) - F.size(rest)).cast("long").alias(f"n_{k}") for k, rest in zip(personal_data.KINDS, others)]
    return found.select("doc_id", *counts, F.sha2(written(plain), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
