"""Input tables of the scoring operators, derived from the given tables.

Each is one SELECT that Spark and DuckDB both run, so that queries and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark import config
from riskspark.session import spread


def _text(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple] | tuple, names: str) -> str:
    """A VALUES table; the text is free of backslashes (they differ in meaning between engines)."""
    body = ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


SNIPPETS = [
    (0, "Деньги на автопилоте: 500 000 тенге за вечер! Ставь плюс и стучись в телегу, последние 5 кресел. Успей до полуночи, плачу 300 и плачу 900", "#деньгизавечер, #КухняДома #деньгизавечер", "https://www.instagram.com/p/1", None, "my_first-clip.mp4", None),
    (1, "Крутим барабаны без риска: промокод WIN777, код ABC123, тапай сюда t.me/casino_lux_kz", "#фартит #quickcash", "vm.tiktok.com/xyz", "TikTok", None, "Слушай: крутим барабаны весь день"),
    (2, "Зови 3 и получи бонус за каждого друга. Зови 7! Whatsapp: +7 701 123 45 67. Вход по коду: cutt.ly/abc123", "", "https://youtu.be/abc", "Unknown", None, None),
    (3, "Сегодня готовим борщ по бабушкиному рецепту (#борщ) «#ужин»", None, None, None, "C:/video/borsch.mov", None),
    (4, "Осторожно мошенники! Берегитесь обмана: разбор уловок, финансовая грамотность для всех", "#финграмотность", "https://vk.com/w", None, None, None),
    (5, "Double your cash today, money while you sleep, offer ends tonight! Text me @fast_money_team", "#QuickCash,#quickcash,#invest", "https://t.me/some", None, None, "Double your cash every day"),
    (6, "б а р а б а н ы б3з вложений, д0ход. Капает на карту, капает на карту", None, None, "Telegram", None, None),
    (7, "Тек бүгін ақша табу оңай, telegram арнамызға жазыл @tez_aqsha", "#Без_вложений", "http://example.com/a", None, None, ""),
    (8, "", None, "", "", "", ""),
    (9, None, None, None, None, None, None),
]
SPOKEN = [(0, "деньги на автопилоте"), (1, None), (2, "тапай сюда и зови 2 друзей"), (3, "крутим барабаны, берегитесь обмана"), (4, "")]
SHOWN = [(0, "промокод WIN777"), (1, "lucky wheel"), (2, "зови 9")]

POSTS = f"""SELECT d.doc_id AS case_id, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE substr(d.text, 1, 40) END AS title,
 concat_ws(chr(10), d.text, v.snippet) AS description, v.tags AS tags, v.url AS url, v.platform AS platform, v.filename AS filename,
 v.spoken AS provided_transcript, CAST('2024-01-01' AS DATE) + CAST(d.doc_id % 28 AS INT) AS created
 FROM documents d JOIN {values(SNIPPETS, "k, snippet, tags, url, platform, filename, spoken")} ON d.doc_id % 10 = v.k"""
SEGMENTS = f"""SELECT c.conv_id AS case_id, c.turn AS seg_no, CAST(5 * c.turn AS DOUBLE) AS start_s, CAST(5 * c.turn + 4 AS DOUBLE) AS end_s,
 CASE WHEN c.turn = 3 THEN ' ' ELSE concat_ws(' ', c.text, v.phrase) END AS text
 FROM conversations c JOIN {values(SPOKEN, "k, phrase")} ON (c.conv_id + c.turn) % 5 = v.k"""
OCR = f"""SELECT CAST(floor(b.item_id / 8) AS BIGINT) AS case_id, CAST(b.item_id % 7 * 3 AS DOUBLE) AS time_s, b.item_id AS frame, concat_ws(' ', b.text, v.phrase) AS text,
 CAST(40 + b.item_id % 60 AS DOUBLE) AS confidence FROM benchmark b JOIN {values(SHOWN, "k, phrase")} ON b.item_id % 3 = v.k"""
VISUAL = f"""SELECT CAST(floor(e.vec_id / 4) AS BIGINT) AS case_id, CAST(e.vec_id % 90 AS DOUBLE) AS time_s, e.vec_id AS frame, v.label AS label, v.dim AS dim,
 CAST(e.vec_id * 37 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS score FROM embeddings e JOIN {values([(k, *p) for k, p in enumerate(config.PROMPTS)], "k, label, dim")} ON e.label = v.k"""
MEDIA = "SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 200 AS DOUBLE) END AS duration_s FROM documents"
#: Scores of a model and of the rules against a label, with ties.
SCORED = """SELECT l.doc_id AS id, CAST(l.toxic AS INT) AS y,
 CAST((d.n_chars * 7 + d.doc_id * 13 + 400 * l.toxic) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p_model,
 CAST((d.n_chars * 3 + d.doc_id * 5 + 150 * l.toxic) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS p_rule,
 d.doc_id % 3 = 0 AS obfuscated, CAST(d.doc_id % 7 AS INT) AS category, CAST((d.doc_id * 11 + l.quality) % 7 AS INT) AS category_pred
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
LEXICON = "SELECT * FROM " + values([(k, d, p, w, r, lab) for k, (d, p, w, r, lab) in enumerate(config.LEXICON)], "ord, dim, pattern, weight, is_regex, label")
NEGATIVES = "SELECT * FROM " + values([(k, p, w) for k, (p, w) in enumerate(config.NEGATIVES)], "ord, pattern, weight")
FUNNEL = "SELECT * FROM " + values(config.FUNNEL, "kind, dim, confidence, signal")
DIMS = "SELECT * FROM " + values(list(enumerate(config.DIMENSIONS)), "dim_no, dim")

SQL = {"posts": POSTS, "segments": SEGMENTS, "ocr": OCR, "visual": VISUAL, "media": MEDIA, "scored": SCORED, "lexicon": LEXICON, "negatives": NEGATIVES, "funnel": FUNNEL, "dims": DIMS}
INPUTS = {"posts": ("documents",), "segments": ("conversations",), "ocr": ("benchmark",), "visual": ("embeddings",), "media": ("documents",), "scored": ("labels", "documents")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or one of the given tables."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = spark.sql(_bound(SQL[name], INPUTS.get(name, ())), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in INPUTS.get(name, ())})
    return spread(found) if name == "posts" else found


def _bound(sql: str, tables: tuple[str, ...]) -> str:
    """Table names as parameters of ``spark.sql``, so that no temporary view is registered."""
    for t in tables:
        sql = sql.replace(f" {t} ", " {" + t + "} ") if f" {t} " in sql else sql.replace(f" {t}", " {" + t + "}")
    return sql


def with_(*names: str, **more: str) -> str:
    """A WITH clause for DuckDB of fixtures by name, then further parts."""
    parts = {n: SQL[n] for n in names} | more
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts.items()) + "\n"
