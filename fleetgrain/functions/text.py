"""Text, number and date-text normalisation."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITESPACE = " \t\n\r\f\x0b"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Accented Latin letters and their plain forms.
_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def text_or_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(stripped(c.cast("string")), F.lit("")) == ""


def number_text(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal number is null."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def decimal_comma(c: Column) -> Column:
    return number_text(F.replace(stripped(c), F.lit(","), F.lit(".")))


def locale_number(c: Column) -> Column:
    """Whichever of ',' and '.' comes last is the decimal mark."""
    s = F.replace(stripped(c), F.lit(" "), F.lit(""))
    comma, dot = F.instr(s, ","), F.instr(s, ".")
    last_comma = F.instr(F.reverse(s), ",")
    last_dot = F.instr(F.reverse(s), ".")
    plain = (
        F.when((comma > 0) & (dot == 0), F.replace(s, F.lit(","), F.lit(".")))
        .when(
            (comma > 0) & (last_comma < last_dot),
            F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
        )
        .when(comma > 0, F.replace(s, F.lit(","), F.lit("")))
        .otherwise(s)
    )
    return number_text(plain)


def canonical_text(c: Column) -> Column:
    """Accents off, compatibility forms resolved, blanks collapsed, case folded.

    Plain text and Latin accents stay inside code generation. Other text goes letter by
    letter through tables made from the Unicode data: letters with one plain letter are
    translated, combining marks dropped, letters with several replaced. Only Korean
    syllables are left whole, which keeps equal texts equal.
    """
    text = F.coalesce(stripped(c), F.lit(""))
    plain = F.lower(F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\s+", " "))
    one_from, one_to, several = _letter_tables()
    forms = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    spread = F.transform(F.split(text, ""), lambda x: F.coalesce(F.when(x.rlike(_FEW), None).otherwise(F.try_element_at(forms, x)), x))
    folded = F.translate(F.array_join(spread, ""), one_from, one_to)
    full = F.btrim(F.regexp_replace(folded, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "))
    return F.when(text.rlike(f"^[\\x00-\\x7F{_ACCENTED}]*$"), plain).otherwise(full)


_FEW = r"^[\x00-\x7F]$"


@lru_cache(maxsize=1)
def _letter_tables() -> tuple[str, str, dict[str, str]]:
    """Letters with one plain form, those forms, and letters with several, by rule.

    Letters without any, such as combining marks, stand last in the first table, past
    the end of the second, where translation drops them.
    """
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    dropped: list[str] = []
    for code in range(1, 0x20000):
        letter = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or letter.isspace():
            continue
        kept = "".join(x for x in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(x)).casefold()
        if kept == letter:
            continue
        if not kept:
            dropped.append(letter)
        elif len(kept) == 1:
            one[letter] = kept
        else:
            several[letter] = kept
    return "".join(one) + "".join(dropped), "".join(one.values()), several


@F.pandas_udf(StringType())
def canonical_text_unicode(values: pd.Series) -> pd.Series:
    """Full compatibility decomposition with combining marks removed."""

    def canon(value: str | None) -> str:
        decomposed = unicodedata.normalize("NFKD", (value or "").strip())
        kept = "".join(ch for ch in decomposed if not unicodedata.combining(ch))
        return " ".join(kept.split()).casefold()

    return values.map(canon)


def normalize_line(c: Column) -> Column:
    return F.nullif(F.replace(stripped(c), F.lit("."), F.lit("")), F.lit(""))


def service_time(c: Column) -> Column:
    """First H:MM[:SS] not preceded by a digit, as HH:MM:SS."""
    pattern = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2}))?"
    hour = F.regexp_extract(c, pattern, 1)
    second = F.regexp_extract(c, pattern, 3)
    return F.when(
        hour != "",
        F.concat_ws(
            ":",
            F.lpad(hour, 2, "0"),
            F.regexp_extract(c, pattern, 2),
            F.when(second == "", F.lit("00")).otherwise(second),
        ),
    )


def optional_number(c: Column, kind: str = "double") -> Column:
    return F.nullif(c, F.lit("")).try_cast(kind)


def date_format_class(c: Column) -> Column:
    s = stripped(c)
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("iso"))
        .when(s.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.lit("dd/mm/yyyy"))
        .when(s != "", F.lit("other"))
    )


def contains_filter(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """All filters AND-ed: case-insensitive substring; a blank filter passes all."""
    for column, wanted in filters.items():
        wanted = wanted.strip()
        if wanted:
            shown = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
            df = df.filter(F.contains(shown, F.lit(wanted.lower())))
    return df
