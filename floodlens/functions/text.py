"""Text rules for bulletins: tags, entities, letters, keywords, levels, classes."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodlens.functions.scalars import ColumnLike, as_col

# Unicode blanks: what scripting languages strip. Java's bare \s knows the ASCII ones only.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Letters that survive `letters_only`.
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"

# Words that make a bulletin relevant for the reservoir.
RESERVOIR_WORDS = ("embalse", "daule", "peripa", "cota", "compuertas", "descarga")

# Cantons in order of priority.
CANTONS = (
    "Guayaquil", "Daule", "Samborondón", "Durán", "Nobol", "Salitre",
    "Santa Lucía", "Palestina", "Balzar", "Colimes", "El Empalme",
)

# Word -> severity and stem -> event type, in order of priority, with the defaults.
SEVERITY_WORDS = (("roja", "critica"), ("naranja", "alta"), ("amarilla", "media"))
SEVERITY_DEFAULT = "media"
EVENT_STEMS = (
    ("inundaci", "inundacion"),
    ("desliz", "deslizamiento"),
    ("desbord", "desbordamiento_rio"),
    ("alcantarill", "colapso_alcantarillado"),
)
EVENT_DEFAULT = "inundacion"

# Patterns of the reservoir level, in order of priority, and of the maximum level.
_UNIT = r"\(?m\.?\s*s\.?\s*n\.?\s*m\.?\)?"
_NUMBER = r"(\d{1,3}(?:[.,]\d{1,2})?)\s*"
LEVEL_PATTERNS = (
    r"embalse\s+se\s+encuentra\s+en\s+(?:los|el)?\s*" + _NUMBER
    + r"(?:metros(?:\s+sobre\s+el\s+nivel\s+del\s+mar)?\s*)?" + _UNIT,
    r"cota\s+del\s+embalse[^.]{0,120}?alcanz[oó]\s+"
    r"(?:su\s+m[aá]ximo\s+nivel\s+normal\s+de\s+operaci[oó]n\s*,?\s*)?(?:es\s+decir\s+|los\s+|el\s+)?"
    + _NUMBER + _UNIT,
    r"cota\s+del\s+embalse[^.]{0,80}?(?:se\s+ubic[ao]|se\s+registr[ao]|registr[ao]|se\s+encuentra)\s+en\s+"
    + _NUMBER + _UNIT,
)
MAX_LEVEL_PATTERN = r"nivel\s+m[aá]ximo\s+es\s+" + _NUMBER + _UNIT

# Entities decoded inside the JVM; `&amp;` comes last so that `&amp;lt;` stays `&lt;`.
COMMON_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#039;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"),
    ("&ntilde;", "ñ"), ("&uuml;", "ü"), ("&#8211;", "–"), ("&#8217;", "’"), ("&#8220;", "“"), ("&#8221;", "”"),
    ("&amp;", "&"),
)
_COMMON_NAMES = "|".join(re.escape(e[1:-1]) for e, _ in COMMON_ENTITIES)


def strip_blanks(text: ColumnLike) -> Column:
    return F.btrim(as_col(text), F.lit(BLANKS))


def html_strip(text: ColumnLike) -> Column:
    """Tags become one blank, then both ends are trimmed. NULL counts as empty text."""
    return strip_blanks(F.regexp_replace(F.coalesce(as_col(text), F.lit("")), r"<[^>]+>", " "))


def html_unescape_common(text: ColumnLike) -> Column:
    """Entities of the common set only; everything else is left as it is."""
    text = as_col(text)
    expr = text
    for entity, char in COMMON_ENTITIES:
        expr = F.replace(expr, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), expr).otherwise(text)


# The names of HTML5, with their semicolon; those that also stand without one, longest first.
_NAMED = json.dumps(html5)
_UNENDED = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# Numbers 128 to 159 mean characters of the Windows code page, or themselves where it has none.
_C1 = [bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(0x80, 0xA0)]
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


def _code_point(number: Column) -> Column:
    """Character of a numeric reference; nothing for the numbers that HTML5 calls no character."""
    nothing = (
        number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF) | (number % 0x10000 >= 0xFFFE)
    )
    return (
        F.when(number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), _REPLACEMENT)
        .when(number.between(0x80, 0x9F), F.get(F.array(*map(F.lit, _C1)), (number - 0x80).cast("int")))
        .when(nothing, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def _decode_reference(piece: Column, named: Column) -> Column:
    """Text after an ampersand, its reference decoded; with the ampersand if it is none."""
    found = F.regexp_extract(piece, _REFERENCE, 1)
    rest = F.substring(piece, F.length(found) + 1, F.length(piece))
    # More digits than these are beyond the last code point.
    hexadecimal = F.conv(F.nullif(F.regexp_extract(found, "^#[xX]0*([0-9a-fA-F]{1,8});?$", 1), F.lit("")), 16, 10)
    decimal = F.nullif(F.regexp_extract(found, "^#0*([0-9]{1,10});?$", 1), F.lit(""))
    number = F.coalesce(hexadecimal, decimal).try_cast("bigint")
    whole = F.try_element_at(named, found)
    start = F.regexp_extract(found, f"^(?:{_UNENDED})", 0)
    begun = F.concat(F.try_element_at(named, start), F.substring(found, F.length(start) + 1, F.length(found)))
    name = F.coalesce(whole, F.when(start != "", begun), F.concat(F.lit("&"), found))
    return F.concat(F.when(F.startswith(found, F.lit("#")), _code_point(number)).otherwise(name), rest)


def html_unescape(text: ColumnLike) -> Column:
    """Exact HTML5 unescaping.

    Texts whose ampersands all belong to the common set are decoded by plain replacement; only in
    the others is every reference looked at on its own.
    """
    text = as_col(text)
    leftover = F.regexp_replace(text, f"&(?:{_COMMON_NAMES});", "")
    rare = F.contains(text, F.lit("&")) & leftover.rlike("&[#A-Za-z]")
    pieces = F.split(text, "&")
    named = F.from_json(F.lit(_NAMED), "map<string, string>")
    decoded = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: _decode_reference(p, named))
    return F.when(rare, F.concat(F.get(pieces, F.lit(0)), F.array_join(decoded, ""))).otherwise(html_unescape_common(text))


def letters_only(text: ColumnLike) -> Column:
    """Letters kept, every run of anything else turned into one blank, both ends trimmed."""
    return F.trim(F.regexp_replace(as_col(text), f"[^{LETTERS}]+", " "))


def join_parts(*parts: ColumnLike) -> Column:
    """Parts separated by one blank; a missing part keeps its separators."""
    return F.concat_ws(" ", *[F.coalesce(as_col(p), F.lit("")) for p in parts])


def mentions_any(text: ColumnLike, words: Sequence[str] = RESERVOIR_WORDS) -> Column:
    """True if any of ``words`` is a substring of a text already in lower case.

    Words made of plain letters are found in a raw text exactly when they are found in its
    :func:`letters_only` form, which therefore need not be built.
    """
    text, hit = as_col(text), F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def first_mention(text: ColumnLike, table: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first entry of ``table`` whose needle occurs in a text already in lower case."""
    lowered = as_col(text)
    expr = F.when(lowered.isNull(), F.lit(default).cast("string"))
    for needle, label in table:
        expr = expr.when(F.contains(lowered, F.lit(needle)), F.lit(label))
    return expr.otherwise(F.lit(default).cast("string"))


def canton_of(text: ColumnLike, fold_accents: bool = False) -> Column:
    """Canton named in a lower-case text; accents matter unless ``fold_accents``."""
    if not fold_accents:
        return first_mention(text, [(c.lower(), c) for c in CANTONS])
    plain = F.translate(as_col(text), "áéíóúüñ", "aeiouun")
    folded = str.maketrans("áéíóúüñ", "aeiouun")
    return first_mention(plain, [(c.lower().translate(folded), c) for c in CANTONS])


def severity_of(text: ColumnLike) -> Column:
    return first_mention(text, SEVERITY_WORDS, SEVERITY_DEFAULT)


def event_type_of(text: ColumnLike) -> Column:
    return first_mention(text, EVENT_STEMS, EVENT_DEFAULT)


def _level(text: Column, pattern: str) -> Column:
    found = F.nullif(F.regexp_extract(text, "(?iU)" + pattern, 1), F.lit(""))
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def reservoir_level(text: ColumnLike) -> Column:
    """Level in metres above sea: the first pattern that matches wins.

    All patterns need the word they share, so texts without it skip the expressions. The stem
    leaves out letters with unusual case pairs.
    """
    text = as_col(text)
    found = F.coalesce(*[_level(text, p) for p in LEVEL_PATTERNS])
    return F.when(text.rlike("(?i)embal"), found)


def reservoir_max_level(text: ColumnLike) -> Column:
    text = as_col(text)
    return F.when(text.rlike("(?i)vel"), _level(text, MAX_LEVEL_PATTERN))
