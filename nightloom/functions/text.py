"""Markup and claim text, all of it on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import bind

# Named character references that occur around statistics.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "plusmn": "±", "minus": "−", "times": "×",
    "middot": "·", "deg": "°", "sup2": "²", "sup3": "³", "micro": "µ", "frac12": "½", "le": "≤", "ge": "≥", "ne": "≠",
    "asymp": "≈", "infin": "∞", "radic": "√", "sum": "∑", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "Delta": "Δ",
    "mu": "μ", "rho": "ρ", "sigma": "σ", "tau": "τ", "chi": "χ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "hellip": "…", "larr": "←", "rarr": "→", "uarr": "↑", "darr": "↓", "copy": "©", "reg": "®",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "oslash": "ø", "aring": "å", "aelig": "æ",
}
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,7});"


def unescape(text: Column) -> Column:
    """Named and numeric character references in one pass over the text."""
    table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    keys = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    plain = F.split(text, REFERENCE, -1)

    def resolve(k: Column) -> Column:
        hexa = F.conv(F.substring(k, 3, 10), 16, 16)
        code = F.when(k.rlike("^#[xX]"), hexa).when(k.startswith("#"), F.conv(F.substring(k, 2, 10), 10, 16))
        valid = F.conv(code, 16, 10).cast("bigint").between(1, 0x10FFFF) & ~F.conv(code, 16, 10).cast("bigint").between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        return F.coalesce(char, F.element_at(table, k), F.concat(F.lit("&"), k, F.lit(";")))

    chars = F.concat(F.transform(keys, resolve), F.array(F.lit("")))
    joined = F.array_join(F.flatten(F.zip_with(plain, chars, lambda a, b: F.array(a, b))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def strip_markup(html: Column | str) -> Column:
    """Tags become blanks, escaped angle brackets of embedded JSON count as tags, references are decoded."""
    html = F.col(html) if isinstance(html, str) else html
    opened = F.replace(F.replace(html, F.lit("\\u003c"), F.lit("<")), F.lit("\\u003e"), F.lit(">"))
    # the text is bound once: decoding looks at it several times
    return bind(F.regexp_replace(opened, "<[^>]+>", " "), unescape)


def matches_with_position(text: Column, pattern: str) -> Column:
    """array<struct<at, match>>: every match with its 1-based position."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,match:string>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        at = acc["next"] + z["gap"]
        return F.struct((at + F.length(z["m"])).alias("next"), F.array_append(acc["out"], F.struct(at.alias("at"), z["m"].alias("match"))).alias("out"))

    pair = lambda g, m: F.struct(g.alias("gap"), m.alias("m"))
    zipped = F.zip_with(F.slice(before, F.lit(1), F.size(found)), found, pair)
    return F.aggregate(zipped, start, step)["out"]


def squeeze(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
