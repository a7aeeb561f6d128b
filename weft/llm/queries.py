"""The registered queries over the corpus tables, each a thin call of its operator, beside their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import dedup, html, language, matroska, mixing, neighbours, pieces, quality, sentencepiece_scan, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- 8: URL filters

#: The rules that the query reports by name.
HOST_RULES = [
    urls.host_rule("org/", "allow"),
    urls.host_rule("example.org/es/", "block"),
    urls.host_rule("example.org/en/1", "block"),
    urls.host_rule("com/fr/", "allow"),
    urls.host_rule("com/de/", "block"),
]

#: Patterns for pages that no host rule covers; they block what is no article.
PAGE_RULES = [
    urls.Rule(p, p, "block")
    for p in (
        "/ads/",
        "/adserver/",
        "/banners/",
        "/cart/",
        "/casino/",
        "/checkout/",
        "/cgi-bin/",
        "/login^",
        "/logout^",
        "/porn/",
        "/register^",
        "/search?*q=",
        "/signin^",
        "/signup^",
        "/wp-admin/",
        "||doubleclick.net^",
    )
]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES + PAGE_RULES)
    shown = F.when(F.col("rule").isin([r.name for r in HOST_RULES]), F.col("rule"))
    return judged.select("page_id", "host", "path", shown.alias("rule"), "verdict")


def _op8_sql() -> str:
    fits = lambda r: f"regexp_matches(t, '{r.regex()}')"
    best = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in best)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in best)
    pages = " OR ".join(fits(r) for r in PAGE_RULES)
    return rf"""
WITH p AS (
  SELECT page_id, contains(url, '://') AS has,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS pa,
    regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1) AS rest
  FROM pages),
u AS (SELECT page_id, coalesce(h, '') AS host, coalesce(pa, '') AS path, CASE WHEN has THEN h || rest END AS t FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {pages} THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""


QUERIES["op8_url_rules"] = op8_url_rules
ORACLES["op8_url_rules"] = _op8_sql()


# --- 7: media columns


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(_table(spark, sf_dir, "documents"))


QUERIES["op7_matroska"] = op7_matroska


# --- 6: near duplicates


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op6_minhash"] = op6_minhash
ORACLES["op6_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5
      THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
co AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM co JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id,
  least(w.doc_id, coalesce(c.m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""


# --- 3: quality


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score; labels come only from rows that are not held out."""
    model = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"), 4, 2)), "quality")
    return quality.score(docs, model)


def op3_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, _table(spark, sf_dir, "labels"))
    held = F.coalesce(quality.held_out(F.col("doc_id"), 4, 2), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES["op3_quality_ftrl"] = op3_quality_ftrl


# --- 4: toxicity


def toxicity_scores(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with score; labels come only from rows that are not held out, their texts from ``labelled`` (or ``docs``)."""
    lexicon = toxicity.learn(docs if labelled is None else labelled, labels.filter(~quality.held_out(F.col("doc_id"), 5, 0)), "toxic")
    return toxicity.score(docs, lexicon)


def op4_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, _table(spark, sf_dir, "labels"))
    held = F.coalesce(quality.held_out(F.col("doc_id"), 5, 0), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op4_toxicity_lexicon"] = op4_toxicity_lexicon


# --- 9: language


def op9_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(quality.held_out(F.col("doc_id"), 4, 2), F.lit(False))
    table = pieces.load()
    model = language.train(docs.filter(~held), table)
    return language.predict(docs.select("doc_id", "text"), table, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES["op9_language_pieces"] = op9_language_pieces


# --- 10: SentencePiece


def encoded(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, and whether decoding them gives the text back; then ``more`` columns of ``docs``."""
    made = sentencepiece_scan.encode(docs.select("doc_id", "text", *more), pieces.load(), check_col="round_trip")
    return made.select(
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "ids",
        "round_trip",
        *more,
    )


def op10_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"))


QUERIES["op10_sentencepiece_scan"] = op10_sentencepiece_scan


# --- 5: mixing


def op5_mixing_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "position")


QUERIES["op5_mixing_pfair"] = op5_mixing_pfair


# --- 2: nearest neighbours


def op2_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, F.col("vec_id") % 100 == 0)


QUERIES["op2_rotated_codes"] = op2_rotated_codes


# --- 1: HTML extraction


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.train())


QUERIES["op1_html_blocks"] = op1_html_blocks
