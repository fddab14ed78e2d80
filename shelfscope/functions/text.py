"""Text expressions: accents, normal form, volume, type, container, pack."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.numbers import filled, let, truthy

RAW = "(?iU)"  # raw text: ignore case, Unicode word boundaries


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that later filters and projections cannot copy them.

    Catalyst substitutes a column by its expression when it pushes a filter down; for
    the long alias expressions that copies them many times. They are computed in a
    projection of their own and passed through a one-row ``inline_outer`` that stops the copying (plain ``inline`` would
    add a filter that computes them a second time).
    """
    fields = F.struct(*[column.alias(name) for name, column in columns.items()])
    packed = df.withColumn("_once", F.array(fields))
    return packed.select("*", F.inline_outer("_once")).drop("_once")


HANGUL = (0xAC00, 0xD7A3)  # syllables, taken apart by arithmetic as the Unicode standard says
BLOCK = 256


@cache
def _decompositions() -> tuple[str, str, dict[int, str]]:
    """The compatibility decomposition of every code point but Hangul, without combining marks.

    Pairs for a one-to-one translation (characters that vanish go last), and code points that become several.
    """
    source, target, dropped, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or HANGUL[0] <= code <= HANGUL[1]:
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if not plain:
            dropped.append(char)
        elif plain != char:
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
            else:
                several[code] = plain
    return "".join(source + dropped), "".join(target), several


@cache
def _several_table() -> tuple[str, str]:
    """Two-level table of what becomes several: per block of code points its place, and per place 256 texts ('' for none)."""
    several = _decompositions()[2]
    blocks = sorted({code // BLOCK for code in several})
    places = ["-1"] * (sys.maxunicode // BLOCK + 1)
    for place, block in enumerate(blocks):
        places[block] = str(place)
    texts = [several.get(block * BLOCK + i, "") for block in blocks for i in range(BLOCK)]
    return ",".join(places), "\n".join(texts)


def _as_ranges(codes: list[int]) -> str:
    """Body of a character class, neighbours joined to ranges."""
    parts = []
    start = last = codes[0]
    for code in [*codes[1:], 0]:
        if code != last + 1:
            parts.append(f"{chr(start)}-{chr(last)}")
            start = code
        last = code
    return "".join(parts)


def _apart(char: Column) -> Column:
    """What one character becomes if it becomes several, else itself."""
    places, texts = _several_table()
    code = F.ascii(char)
    place = F.get(F.split(F.lit(places), ",").cast("array<int>"), F.floor(code / BLOCK).cast("int"))
    plain = F.get(F.split(F.lit(texts), "\n"), place * BLOCK + code % BLOCK)
    syllable = code - HANGUL[0]
    lead, vowel, tail = F.floor(syllable / 588).cast("int"), F.floor(syllable % 588 / 28).cast("int"), syllable % 28
    letters = F.concat(_letter(lead + 0x1100), _letter(vowel + 0x1161), F.when(tail > 0, _letter(tail + 0x11A7)).otherwise(F.lit("")))
    return F.when(code.between(*HANGUL), letters).when((place >= 0) & (plain != ""), plain).otherwise(char)


def _letter(code: Column) -> Column:
    """The character of a code point of three bytes."""
    parts = [F.shiftright(code, 12) + 0xE0, F.shiftright(code, 6) % 64 + 0x80, code % 64 + 0x80]
    return F.decode(F.unhex(F.concat(*[F.lpad(F.hex(p), 2, "0") for p in parts])), "UTF-8")


def strip_accents(text: Column) -> Column:
    """Compatibility form without combining marks, for texts of any script.

    Plain ASCII is passed through; only texts holding a character that becomes several
    (a ligature, a fraction or a Hangul syllable, say) are taken apart, by the table's place of each code point.
    """
    source, target, several = _decompositions()
    single = F.translate(text, source, target)
    listed = _as_ranges(sorted(several)) + f"{chr(HANGUL[0])}-{chr(HANGUL[1])}"
    apart = lambda t: F.array_join(F.transform(F.split(t, ""), _apart), "")
    return F.when(~text.rlike(r"[^\x00-\x7F]"), text).otherwise(
        let(single, lambda t: F.when(t.rlike(f"[{listed}]"), apart(t)).otherwise(t))
    )


def norm_text(text: Column) -> Column:
    """Lower case, no accents, only [a-z0-9] words with single spaces; null gives ''."""
    plain = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def whole_number(digits: Column, kind: str = "int") -> Column:
    """Number of a text of digits, null for ''. Failing casts are costly, so none is tried."""
    return F.when(digits != "", digits).try_cast(kind)


def title_words(words: Column) -> Column:
    """Title case of [a-z0-9 ] text; a letter after a digit is a capital too."""
    marked = F.regexp_replace(words, "([0-9])([a-z])", "$1~ $2")
    return F.replace(F.initcap(marked), F.lit("~ "), F.lit(""))


def to_ml(value: Column, unit: Column) -> Column:
    """Quantity and unit to whole millilitres, null if there is no quantity."""
    name = F.trim(F.lower(F.coalesce(unit, F.lit(""))))
    factor = (
        F.when(name.isin(fixed.MILLILITRE_UNITS), 1.0)
        .when(name.isin(fixed.LITRE_UNITS), 1000.0)
        .when(name.isin(fixed.CENTILITRE_UNITS), 10.0)
        .otherwise(1.0)
    )
    return F.when(truthy(value), F.rint(value * factor).cast("int"))


def volume_from_name(name: Column) -> Column:
    """First volume in a name, null if there is none or it is zero."""

    def parts(found: Column) -> Column:
        digits = F.regexp_extract(found, r"^[0-9.,]+", 0)
        number = whole_number(F.replace(digits, F.lit(","), F.lit(".")), "double")
        unit = F.regexp_extract(found, r"(?i)(cm3|[a-z]+)$", 1)
        return F.struct(number.alias("number"), unit.alias("unit"))

    found = F.regexp_extract(name, RAW + fixed.VOLUME_IN_NAME, 0)
    return let(
        found,
        lambda f: F.when(f != "", let(parts(f), lambda p: to_ml(p["number"], p["unit"]))),
    )


def type_text(name: Column, brand: Column, color: Column = None, style: Column = None) -> Column:
    """What is left of a name without 'Cerveza', brand and volumes."""
    fallbacks = [F.when(filled(c), c) for c in (style, color) if c is not None]

    def clean(text: Column) -> Column:
        text = F.regexp_replace(text, RAW + r"\bCerveza\b", "")
        text = F.regexp_replace(text, RAW + fixed.VOLUME_TOKEN, "")
        return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" ,-"))

    start = F.regexp_replace(F.coalesce(name, F.lit("")), RAW + r"^Cerveza\s+", "")
    quoted = F.concat(
        F.lit(RAW + r"\b\Q"), F.replace(brand, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b")
    )
    # Most names do not hold the brand's letters at all: no pattern to build then.
    holds = filled(brand) & F.contains(F.lower(name), F.lower(brand))
    rest = F.when(F.coalesce(holds, F.lit(False)), F.regexp_replace(start, quoted, F.lit(""))).otherwise(start)
    return let(
        clean(rest), lambda t: F.coalesce(F.when(t != "", t), *fallbacks, F.lit(""))
    )


def mentions_zero_alcohol(type_raw: Column, name_raw: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(type_raw, F.lit("")), F.coalesce(name_raw, F.lit("")))
    return text.rlike(RAW + fixed.ZERO_ALCOHOL)


def container(normal: Column) -> Column:
    return F.when(normal.rlike(fixed.CAN), F.lit("lata")).when(
        normal.rlike(fixed.BOTTLE), F.lit("botella")
    )


def pack_quantity(normal: Column) -> Column:
    """Units per pack. A first-form hit out of range is final: no second try."""
    low, high = fixed.PACK_RANGE
    before = F.regexp_extract(normal, fixed.PACK_BEFORE, 1)
    digits = let(
        before, lambda b: F.when(b != "", b).otherwise(F.regexp_extract(normal, fixed.PACK_AFTER, 1))
    )
    return let(
        whole_number(digits), lambda n: F.when(n.between(low, high), n).otherwise(F.lit(1))
    )


def normal_gtin(gtin: Column) -> Column:
    return F.ltrim(F.btrim(F.coalesce(gtin, F.lit(""))), F.lit("0"))
