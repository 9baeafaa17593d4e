"""Bulletin rules against the standard library."""

import html
import re

from pyspark.sql import functions as F

from floodlens.functions import text as tx
from floodlens.operators import bulletins

SAMPLES = [
    "<p>Hola&nbsp;<b>mundo</b></p>\t ", "&amp;lt; &lt;b&gt; &eacute; &#233; &#xe9; &notin; &amp &bogus; a & b", "", "  x  ",
    "Ñandú 123 – ¡río!\nDurán\x1c", "a<b", "<<x>>", "&copy &AMP; &quot;q&quot;", "línea\r\nuno",
]


def values(spark, column, rows=SAMPLES):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i INT, s STRING")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_unescape_of_rare_references(spark):
    """Numbers, every name with and without its end, prefixes of names, and mixtures."""
    import random
    from html.entities import html5

    rng = random.Random(2)
    numbers = [*range(160), 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**12, 128512]
    texts = [f"&#{n};" for n in numbers] + [f"&#x{n:x}" for n in [*numbers, 2**70]] + ["&#;", "&#x0000041;", "&&", "&ampb", "&notit;", "&ltx", "&l;t", "&" + "a" * 40]
    texts += [f"&{name}" for name in html5] + [f"x&{name.rstrip(';')}{rng.choice(['', 'z', ';z', ' z'])}" for name in html5]
    parts = ["&", "#", "x", "amp", "lt", ";", "6", "41", "é", "not", "in", " ", "quot", "frac12", "<", "😀"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(1000)]
    assert values(spark, tx.html_unescape("s"), texts) == [html.unescape(t) for t in texts]


def test_strip_unescape_letters(spark):
    assert values(spark, tx.html_strip("s")) == [re.sub(r"<[^>]+>", " ", s).strip() for s in SAMPLES]
    assert values(spark, tx.html_unescape("s")) == [html.unescape(s) for s in SAMPLES]
    words = [re.sub(r"\s+", " ", re.sub(r"[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ\s]", " ", s)).strip() for s in SAMPLES]
    assert values(spark, tx.letters_only("s")) == words
    assert values(spark, tx.html_unescape("s"), [None]) == [None]


def test_levels(spark):
    rows = [
        "El embalse se encuentra en los 84,5 m.s.n.m.", "EMBALSE SE ENCUENTRA EN 84.25 metros sobre el nivel del mar (msnm)",
        "La cota del embalse Daule alcanzó su máximo nivel normal de operación, es decir 85 m.s.n.m.",
        "cota del embalse hoy se registra en 79,9 msnm; nivel máximo es 88 m.s.n.m.", "embalse se encuentra en 84,5 metros",
        "cota del embalse alcanzó 70 msnm. El embalse se encuentra en los 71 msnm",
    ]
    assert values(spark, tx.reservoir_level("s"), rows) == [84.5, 84.25, 85.0, 79.9, None, 71.0]
    assert values(spark, tx.reservoir_max_level("s"), rows) == [None, None, None, 88.0, None, None]


def test_reservoir_bulletins(spark):
    rows = [
        (1, "T", None, "El embalse se encuentra en los 80 msnm"), (2, None, None, "Su nivel máximo es 85 msnm del embalse"),
        (3, "x", "y", "nivel máximo es 85 msnm"), (4, "embalse", "", "sin dato"),
    ]
    df = spark.createDataFrame(rows, "id INT, t STRING, e STRING, c STRING")
    got = {r.id: (r.level_m, r.max_level_m) for r in bulletins.reservoir_levels(df, F.col("t"), F.col("e"), F.col("c"), ["id"]).collect()}
    assert got == {1: (80.0, None), 2: (None, 85.0)}


def test_alerts_order_and_accents(spark):
    rows = [
        (1, "Daule y Guayaquil: alerta naranja y roja", "deslizamiento e inundación"), (2, "Samborondon", "x"), (3, "DURÁN", "alcantarillado"),
        (4, "nada", "nada"), (5, "Nobol", None),
    ]
    df = spark.createDataFrame(rows, "id INT, t STRING, c STRING")
    got = {r.id: (r.canton, r.event_type, r.severity, r.description) for r in bulletins.alerts(df, F.col("t"), F.lit(None).cast("string"), F.col("c"), ["id"]).collect()}
    assert got == {
        1: ("Guayaquil", "inundacion", "critica", "Daule y Guayaquil: alerta naranja y roja"),
        3: ("Durán", "colapso_alcantarillado", "media", "DURÁN"),
        5: ("Nobol", "inundacion", "media", "Nobol"),
    }
    assert values(spark, tx.canton_of("s", fold_accents=True), ["samborondon", "santa lucia"]) == ["Samborondón", "Santa Lucía"]


def test_join_keeps_separators(spark):
    assert values(spark, tx.join_parts(F.lit("a"), F.lit(None).cast("string"), F.lit("c")), ["x"]) == ["a  c"]


def test_keywords(spark):
    assert values(spark, tx.mentions_any(F.lower("s")), ["La COTA", "nada", "descargas"]) == [True, False, True]
