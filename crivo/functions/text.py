"""Text cleaning as column expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a CSV reader of the reference's kind takes as missing.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Hangul syllables decompose by arithmetic, so they need no table.
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3


def strip_accents_text(text: str) -> str:
    """Compatibility-decompose ``text`` and drop combining marks (for names, on the driver)."""
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch))


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Per-character results of `strip_accents_text`, for every character it changes.

    Decomposition works on one character at a time and only reorders marks that are
    dropped anyway, so a per-character table is exact.
    """
    deleted, replaced, expanded = [], [], []
    for point in range(0x80, 0x110000):
        if 0xD800 <= point <= 0xDFFF or _HANGUL_FIRST <= point <= _HANGUL_LAST:
            continue
        ch = chr(point)
        plain = strip_accents_text(ch)
        if plain == ch:
            continue
        if not plain:
            deleted.append(ch)
        elif len(plain) == 1:
            replaced.append((ch, plain))
        else:
            expanded.append((ch, plain))
    # translate() deletes a character that has no counterpart, so those go last.
    source = "".join(ch for ch, _ in replaced) + "".join(deleted)
    target = "".join(plain for _, plain in replaced)
    return source, target, expanded


def _ranges(points: list[int]) -> str:
    """A regex class of code points, in as few ranges as possible."""
    ranges, start = [], points[0]
    for here, following in zip(points, [*points[1:], None]):
        if following != here + 1:
            ranges.append(f"\\x{{{start:X}}}-\\x{{{here:X}}}")
            start = following
    return "[" + "".join(ranges) + "]"


@lru_cache(maxsize=1)
def _expanding_class() -> str:
    """A regex class of exactly the characters that become more than one."""
    points = {ord(ch) for ch, _ in _accent_tables()[2]} | set(range(_HANGUL_FIRST, _HANGUL_LAST + 1))
    return _ranges(sorted(points))


@lru_cache(maxsize=1)
def _latin_tables() -> tuple[str, str, str]:
    """A short translation for Latin letters, and a regex class of all it does not cover.

    It covers everything below the first expanding character past Latin-1, so that the
    common case needs a few hundred characters of plan text instead of thousands.
    """
    expanded = [ord(ch) for ch, _ in _accent_tables()[2]]
    limit = min(p for p in expanded if p >= 0x100)
    pairs = [(chr(p), strip_accents_text(chr(p))) for p in range(0x80, limit) if p not in expanded]
    changed = [(ch, plain) for ch, plain in pairs if plain != ch]
    # translate() deletes a character that has no counterpart, so those go last.
    changed.sort(key=lambda pair: not pair[1])
    beyond = [p for p in expanded if p < limit] + list(range(limit, 0x110000))
    return "".join(ch for ch, _ in changed), "".join(plain for _, plain in changed), _ranges(beyond)


def _expand_hangul(c: Column) -> Column:
    def letters(first: int, count: int) -> Column:
        return F.split(F.lit("".join(chr(first + i) for i in range(count))), "")

    leads, vowels, tails = letters(0x1100, 19), letters(0x1161, 21), letters(0x11A8, 27)

    def syllable(ch: Column) -> Column:
        index = F.ascii(ch) - F.lit(_HANGUL_FIRST)
        spelled = F.concat(
            F.get(leads, F.floor(index / 588).cast("int")),
            F.get(vowels, F.floor(F.pmod(index, F.lit(588)) / 28).cast("int")),
            F.coalesce(F.get(tails, F.pmod(index, F.lit(28)) - 1), F.lit("")),
        )
        is_syllable = ch.between(F.lit(chr(_HANGUL_FIRST)), F.lit(chr(_HANGUL_LAST)))
        return F.when(is_syllable, spelled).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), syllable), "")


def _expand(c: Column) -> Column:
    pairs = F.from_json(F.lit(json.dumps(_accent_tables()[2])), "array<array<string>>")
    spelled = F.aggregate(pairs, c, lambda text, p: F.replace(text, F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    return _expand_hangul(spelled)


def is_ascii(c: Column) -> Column:
    """Told by the byte length alone."""
    return F.octet_length(c) == F.char_length(c)


def beyond_latin(c: Column) -> Column:
    """Does the text hold a character that `strip_latin_accents` does not cover?"""
    return F.coalesce(~is_ascii(c) & c.rlike(_latin_tables()[2]), F.lit(False))


def strip_latin_accents(c: Column) -> Column:
    """Strip accents from Latin letters; exact for texts that are not `beyond_latin`."""
    source, target, _ = _latin_tables()
    return F.when(is_ascii(c), c).otherwise(F.translate(c, source, target))


def strip_accents(c: Column) -> Column:
    """Strip accents (compatibility decomposition without combining marks), JVM-side.

    Exact for all of Unicode. Plain ASCII passes untouched, and other text goes through
    one `translate`. Characters that become several (ligatures, fractions, Hangul) take
    a slower branch, which only texts holding one of them enter.
    """
    source, target, _ = _accent_tables()
    expanded = F.when(c.rlike(_expanding_class()), F.translate(_expand(c), source, target))
    return F.when(is_ascii(c), c).otherwise(F.coalesce(expanded, F.translate(c, source, target)))


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_name(name: str) -> str:
    """A column name without accents and outer space."""
    return strip_accents_text(name).strip()


def na_to_null(c: Column, na_values: tuple[str, ...] = NA_VALUES) -> Column:
    """Read missing-value tokens as null."""
    return F.when(c.isin(*na_values), F.lit(None)).otherwise(c)


def base_name(c: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def day_first_epoch(c: Column) -> Column:
    """Parse a day-first date and give its epoch second; unreadable or missing gives 0.

    The text carries no zone, so it is read as UTC whatever the session's zone is.
    """
    patterns = ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d H:m:s", "yyyy-M-d")
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in patterns])
    wall = F.from_utc_timestamp(parsed, F.current_timezone())
    return F.coalesce(F.unix_timestamp(wall), F.lit(0))
