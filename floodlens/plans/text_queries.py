"""Bulletin texts, over whole pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions import text as tx
from floodlens.operators import bulletins
from floodlens.operators.needles import first_mentions
from floodlens.plans import views as v
from floodlens.plans.registry import query

_BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


def _tags_sql(x: str) -> str:
    return _strip_sql(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


def _letters_sql(x: str) -> str:
    spaced = rf"regexp_replace({x}, '[^{tx.LETTERS}{_BLANK}]', ' ', 'g')"
    return _strip_sql(rf"regexp_replace({spaced}, '[{_BLANK}]+', ' ', 'g')")


def _common_sql(x: str) -> str:
    for entity, char in tx.COMMON_ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


# Besides the common set the pages hold only `&amp` cut off before its semicolon.
_EXACT_SQL = "html"
for _entity, _char in tx.COMMON_ENTITIES[:-1]:
    _quoted = _char.replace("'", "''")
    _EXACT_SQL = f"replace({_EXACT_SQL}, '{_entity}', '{_quoted}')"
_EXACT_SQL = f"replace(replace(replace({_EXACT_SQL}, '&amp;', chr(1)), '&amp', chr(1)), chr(1), '&')"


@query("html_strip", f"SELECT page_id, {_tags_sql('html')} AS body FROM pages")
def html_strip(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", tx.html_strip("html").alias("body"))


@query("html_unescape_common", f"SELECT page_id, {_common_sql('html')} AS body FROM pages")
def html_unescape_common(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", tx.html_unescape_common("html").alias("body"))


@query("html_unescape", f"SELECT page_id, {_EXACT_SQL} AS body FROM pages")
def html_unescape(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", tx.html_unescape("html").alias("body"))


@query("letters_only", f"SELECT doc_id, {_letters_sql('text')} AS words FROM documents")
def letters_only(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.letters_only("text").alias("words"))


_WORDS = ("heron", "sobre", "nach", "maison", "ouea")


@query("keyword_relevance", "SELECT doc_id, " + " OR ".join(
    f"contains(lower(text), '{w}')" for w in _WORDS) + " AS relevant FROM documents")
def keyword_relevance(spark, sf):
    lowered = v.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return lowered.select("doc_id", tx.mentions_any("text", _WORDS).alias("relevant"))


# Sentences put in front of each document's whole text, by document number.
_NUMBER = "CAST(70 + doc_id % 20 AS VARCHAR)"
LEVEL_SENTENCES = (
    ("El embalse se encuentra en los ", ",5 m.s.n.m. "),
    ("La cota del embalse alcanzó los ", ".25 msnm. "),
    ("La cota del embalse se ubica en ", " m.s.n.m. Su nivel máximo es 85,1 m.s.n.m. "),
    ("El embalse se encuentra en los ", " metros. "),
    ("Embalse Daule-Peripa: su nivel máximo es ", ",9 (m.s.n.m.) "),
    ("Sin novedades ", ". "),
    ("EL EMBALSE SE ENCUENTRA EN ", ",9 metros sobre el nivel del mar (msnm). "),
)
_BULLETIN = "CASE doc_id % 7 " + " ".join(
    f"WHEN {i} THEN '{a}' || {_NUMBER} || '{b}'" for i, (a, b) in enumerate(LEVEL_SENTENCES)) + " END"


# What the twins look for, written out here: patterns of the level, of the maximum, reservoir words, cantons, events, severities.
_UNIT_SQL = r"\(?m\.?\s*s\.?\s*n\.?\s*m\.?\)?"
_LEVELS_SQL = (
    r"embalse\s+se\s+encuentra\s+en\s+(?:los|el)?\s*(\d{1,3}(?:[.,]\d{1,2})?)\s*(?:metros(?:\s+sobre\s+el\s+nivel\s+del\s+mar)?\s*)?" + _UNIT_SQL,
    r"cota\s+del\s+embalse[^.]{0,120}?alcanz[oó]\s+(?:su\s+m[aá]ximo\s+nivel\s+normal\s+de\s+operaci[oó]n\s*,?\s*)?(?:es\s+decir\s+|los\s+|el\s+)?"
    r"(\d{1,3}(?:[.,]\d{1,2})?)\s*" + _UNIT_SQL,
    r"cota\s+del\s+embalse[^.]{0,80}?(?:se\s+ubic[ao]|se\s+registr[ao]|registr[ao]|se\s+encuentra)\s+en\s+(\d{1,3}(?:[.,]\d{1,2})?)\s*" + _UNIT_SQL,
)
_MAXIMUM_SQL = r"nivel\s+m[aá]ximo\s+es\s+(\d{1,3}(?:[.,]\d{1,2})?)\s*" + _UNIT_SQL
_RESERVOIR_SQL = ("embalse", "daule", "peripa", "cota", "compuertas", "descarga")
_CANTON_SQL = """CASE WHEN contains(b, 'guayaquil') THEN 'Guayaquil' WHEN contains(b, 'daule') THEN 'Daule' WHEN contains(b, 'samborondón') THEN 'Samborondón'
    WHEN contains(b, 'durán') THEN 'Durán' WHEN contains(b, 'nobol') THEN 'Nobol' WHEN contains(b, 'salitre') THEN 'Salitre'
    WHEN contains(b, 'santa lucía') THEN 'Santa Lucía' WHEN contains(b, 'palestina') THEN 'Palestina' WHEN contains(b, 'balzar') THEN 'Balzar'
    WHEN contains(b, 'colimes') THEN 'Colimes' WHEN contains(b, 'el empalme') THEN 'El Empalme' END"""
_EVENT_SQL = """CASE WHEN contains(b, 'inundaci') THEN 'inundacion' WHEN contains(b, 'desliz') THEN 'deslizamiento' WHEN contains(b, 'desbord') THEN 'desbordamiento_rio'
    WHEN contains(b, 'alcantarill') THEN 'colapso_alcantarillado' ELSE 'inundacion' END"""
_SEVERITY_SQL = "CASE WHEN contains(b, 'roja') THEN 'critica' WHEN contains(b, 'naranja') THEN 'alta' ELSE 'media' END"


def _level_sql(pattern: str) -> str:
    return f"try_cast(replace(nullif(regexp_extract(t, '(?i){pattern}', 1), ''), ',', '.') AS DOUBLE)"


@query("level_extract", f"""
    SELECT doc_id, description, level_m, max_level_m FROM (
      SELECT doc_id, description, coalesce({', '.join(map(_level_sql, _LEVELS_SQL))}) AS level_m,
             {_level_sql(_MAXIMUM_SQL)} AS max_level_m
      FROM (SELECT doc_id, {_tags_sql(_common_sql('title'))} AS description,
                   {_tags_sql(_common_sql('title'))} || ' ' || {_tags_sql(_common_sql('lead'))} || ' ' || {_tags_sql(_common_sql('text'))} AS t
            FROM (SELECT doc_id, '<b>' || source || '</b> &amp; ' || lang AS title, '<p>' || {_BULLETIN} || '</p>' AS lead, text FROM documents))
      WHERE {' OR '.join(f"contains(lower({_letters_sql('t')}), '{w}')" for w in _RESERVOIR_SQL)})
    WHERE level_m IS NOT NULL OR max_level_m IS NOT NULL""")
def level_extract(spark, sf):
    number = (F.col("doc_id") % 20 + 70).cast("string")
    sentences = F.array(*[F.concat(F.lit("<p>" + a), number, F.lit(b + "</p>")) for a, b in LEVEL_SENTENCES])
    posts = v.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("<b>"), F.col("source"), F.lit("</b> &amp; "), F.col("lang")).alias("title"),
        F.get(sentences, (F.col("doc_id") % 7).cast("int")).alias("lead"), "text",
    )
    return bulletins.reservoir_levels(posts, F.col("title"), F.col("lead"), F.col("text"), ["doc_id"])


ALERT_SENTENCES = (
    "Alerta roja por inundación en GUAYAQUIL", "Alerta naranja: deslizamiento en Daule y Guayaquil",
    "Desbordamiento de río en Samborondón, alerta amarilla", "Colapso de alcantarillado en Durán",
    "Lluvias en Samborondon", "Lluvias fuertes en El Empalme; alerta roja y naranja", "Reunión en Quito",
    "Balzar en alerta", "Santa Lucía: desliz y desborde",
)


@query("alert_classify", f"""
    SELECT doc_id, canton, event_type, severity, description FROM (
      SELECT doc_id, description, lower(body) AS b FROM (
        SELECT doc_id, {_tags_sql('title')} AS description,
               {_letters_sql(_tags_sql('title') + " || ' ' || '' || ' ' || " + _tags_sql('text'))} AS body
        FROM (SELECT doc_id, '<h1>' || (CASE doc_id % 9 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ALERT_SENTENCES))} END) || '</h1>' AS title, text FROM documents))),
      LATERAL (SELECT {_CANTON_SQL} AS canton, {_EVENT_SQL} AS event_type, {_SEVERITY_SQL} AS severity)
    WHERE canton IS NOT NULL""")
def alert_classify(spark, sf):
    titles = F.array(*[F.lit(f"<h1>{s}</h1>") for s in ALERT_SENTENCES])
    posts = v.table(spark, sf, "documents").select(
        "doc_id", F.get(titles, (F.col("doc_id") % 9).cast("int")).alias("title"), "text"
    )
    return bulletins.alerts(posts, F.col("title"), F.lit(None).cast("string"), F.col("text"), ["doc_id"]).select(
        "doc_id", "canton", "event_type", "severity", "description"
    )


# A long list: ten cuts out of every document's text, in lower case, each with a rank and a label.
_CUTS = 10
_CUT_SQL = f"""
    cuts AS (SELECT lower(substr(text, (1 + (doc_id * 31 + k * 97) % length(text))::INTEGER, (6 + (doc_id + k) % 9)::INTEGER)) AS needle,
                    (doc_id * 7919 + k * 104729) % 1000003 AS rank
             FROM documents, (SELECT unnest(range({_CUTS})) AS k) WHERE length(text) > 0),
    needles AS (SELECT needle, min(rank) AS rank FROM cuts GROUP BY needle),
    hits AS (SELECT doc_id, min(rank) AS rank FROM (SELECT doc_id, lower(text) AS t FROM documents) JOIN needles ON contains(t, needle) GROUP BY doc_id)"""


@query("first_mentions_long_list", f"""WITH {_CUT_SQL}
    SELECT d.doc_id, rank, coalesce('n' || (rank % 50), 'none') AS label FROM documents d LEFT JOIN hits USING (doc_id)""")
def first_mentions_long_list(spark, sf):
    """Ten needles a document, all against all texts."""
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    k = F.explode(F.sequence(F.lit(0), F.lit(_CUTS - 1)))
    cuts = docs.where(F.length("text") > 0).select("doc_id", "text", k.alias("k"))
    start = (1 + (F.col("doc_id") * 31 + F.col("k") * 97) % F.length("text")).cast("int")
    rank = (F.col("doc_id") * 7919 + F.col("k") * 104729) % 1000003
    cut = F.substring("text", start, (6 + (F.col("doc_id") + F.col("k")) % 9).cast("int"))
    needles = cuts.select(F.lower(cut).alias("needle"), rank.alias("rank"), F.concat(F.lit("n"), (rank % 50).cast("string")).alias("label"))
    return first_mentions(docs.select("doc_id", F.lower("text").alias("text")), "doc_id", "text", needles, "none")
