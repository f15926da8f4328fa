"""Parsing of names, packed ids, seasons, clocks and event texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters that look like Latin ones, and their Latin form.
HOMOGLYPHS = {
    "а": "a", "е": "e", "ё": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C",
}
# Generational suffixes dropped at the end of a name.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


# Letters that decompose to several: Latin blocks, Roman numerals, ligatures.
_LETTER_BLOCKS = (range(0x80, 0x250), range(0x2160, 0x2180), range(0xFB00, 0xFB07))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Character tables that apply compatibility decomposition and keep a-z and blank."""
    src, dst, multi = [], [], {}
    for cp in range(0x80, 0xFFFF):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        plain = unicodedata.normalize("NFKD", HOMOGLYPHS.get(ch, ch)).encode("ascii", "ignore").decode().lower()
        plain = "".join(c for c in plain if c == " " or "a" <= c <= "z")
        if len(plain) == 1:
            src.append(ch)
            dst.append(plain)
        elif plain and any(cp in r for r in _LETTER_BLOCKS):
            multi[ch] = plain
    return "".join(src), "".join(dst), multi


_SRC, _DST, _MULTI = _fold_tables()


def normalize_name(name, aliases: dict[str, str] | None = None) -> Column:
    """Letters-only lower-case form of a person name, without generational suffix.

    Everything is a JVM string expression; accents and look-alike letters are
    folded with ``translate`` tables. ``aliases`` maps folded forms to others.
    """
    c = F.col(name) if isinstance(name, str) else name
    folded = c
    for ch, plain in _MULTI.items():
        folded = F.replace(folded, F.lit(ch), F.lit(plain))
    c = F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(folded, _SRC, _DST)).otherwise(c))  # plain names skip the folding
    c = F.regexp_replace(c, "[^a-z ]", "")
    c = F.regexp_replace(F.trim(c), r"\b(" + "|".join(SUFFIXES) + r")$", "")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    if not aliases:
        return c
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def parse_group_ids(packed) -> Column:
    """``-7-3-`` -> sorted array of ids."""
    c = F.col(packed) if isinstance(packed, str) else packed
    pieces = F.filter(F.split(c, "-"), lambda x: x != "")
    return F.array_sort(F.transform(pieces, lambda x: x.cast("bigint")))


def parse_pair_ids(packed) -> Column:
    """Ids of a packed pair in text order; raises unless there are exactly two."""
    c = F.col(packed) if isinstance(packed, str) else packed
    pieces = F.filter(F.split(c, "-"), lambda x: x != "")
    ids = F.transform(pieces, lambda x: x.cast("bigint"))
    return F.when(F.size(ids) == 2, ids).otherwise(
        F.raise_error(F.concat(F.lit("a pair id must hold two members: "), c)).cast("array<bigint>")
    )


def pack_group_ids(ids) -> Column:
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.lit("-"), F.concat_ws("-", F.transform(c, lambda x: x.cast("string"))), F.lit("-"))


def season_label(start_year) -> Column:
    """1999 -> ``1999-00``."""
    y = F.col(start_year) if isinstance(start_year, str) else start_year
    y = y.cast("int")
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def season_start_year(season) -> Column:
    s = F.col(season) if isinstance(season, str) else season
    return F.split(s, "-")[0].try_cast("int")


def season_end_year(season) -> Column:
    """``2024-25`` -> 2025."""
    return season_start_year(season) + 1


def season_from_game_id(game_id) -> Column:
    """Season of a regular-season game id (prefix 0022, then two digits of the start year)."""
    g = F.col(game_id) if isinstance(game_id, str) else game_id
    year = F.lit(2000) + F.substring(g, 5, 2).try_cast("int")
    return F.when(g.startswith("0022"), season_label(year))


def clock_minutes(raw) -> Column:
    """``mm:ss`` -> decimal minutes; text without a colon counts as 0."""
    c = F.col(raw) if isinstance(raw, str) else raw
    bits = F.split(c, ":")
    return F.when(
        F.contains(c, F.lit(":")), bits[0].cast("double") + bits[1].cast("double") / 60.0
    ).otherwise(F.lit(0.0))


# Fixed patterns of the play-by-play texts.
SUBSTITUTION_TEXT = r"^SUB:\s*(.+?)\s+FOR\s+(.+)$"
ASSIST_TEXT = r"\(([^()]+?)\s+\d+\s+AST\)\s*$"
INITIAL_TEXT = r"^([A-Za-z]+)\.\s+(.+)$"
FREE_THROW_TEXT = r"^Free Throw (\d+) of (\d+)"
COMBINED_TEAM = r"^\dTM$"


def _group(text, pattern: str, idx: int) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, idx), F.lit(""))


def substitution_names(text) -> tuple[Column, Column]:
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    return _group(c, SUBSTITUTION_TEXT, 1), _group(c, SUBSTITUTION_TEXT, 2)


def assist_name(text) -> Column:
    return _group(text, ASSIST_TEXT, 1)


def split_initial(name) -> tuple[Column, Column]:
    """``F. Wagner`` -> ("f", "Wagner"); no initial -> (null, name)."""
    c = F.trim(F.col(name) if isinstance(name, str) else name)
    family = _group(c, INITIAL_TEXT, 2)
    return F.lower(_group(c, INITIAL_TEXT, 1)), F.coalesce(F.trim(family), c)


def is_last_free_throw(subtype) -> Column:
    c = F.coalesce(F.col(subtype) if isinstance(subtype, str) else subtype, F.lit(""))
    a, b = F.regexp_extract(c, FREE_THROW_TEXT, 1), F.regexp_extract(c, FREE_THROW_TEXT, 2)
    return (a != "") & (a == b)


def home_code(matchup) -> Column:
    """``AAA @ BBB`` -> ``BBB``; other texts -> null."""
    return _group(matchup, r"@\s*(\w+)", 1)


def height_inches(text) -> Column:
    """``6-11`` -> 83."""
    c = F.col(text) if isinstance(text, str) else text
    bits = F.split(c, "-")
    return bits[0].try_cast("int") * 12 + bits[1].try_cast("int")


def meaning_base(column) -> Column:
    """Column name without trailing rank markers."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(c, r"(_RANK)+$", "")
