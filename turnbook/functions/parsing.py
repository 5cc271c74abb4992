"""Column expressions that turn report text into typed values.

Everything here is a built-in expression, so ingest jobs stay inside
generated code; nothing raises on bad input, it yields null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = "decimal(28,6)"

# A common share has four ASCII digits and does not start with 0.
COMMON_STOCK_PATTERN = r"^[1-9][0-9]{3}\z"

# Separators, wide blanks and plus signs carry no meaning in a number.
IGNORED_IN_NUMBERS = ",　+"

# Wording and digits used in disposition notices.
MATCHING_INTERVAL_PATTERN = "約每([0-9０-９一二三四五六七八九十]+)分鐘"
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
CHINESE_DIGITS = "零一二三四五六七八九"
CHINESE_TEN = "十"


def is_code(ticker: Column, pattern: str) -> Column:
    return F.coalesce(ticker.rlike(pattern), F.lit(False))


def is_common_stock(ticker: Column) -> Column:
    return is_code(ticker, COMMON_STOCK_PATTERN)


def number(text: Column) -> Column:
    """Report number to decimal; blanks and dashes are null."""
    return F.trim(F.translate(text, IGNORED_IN_NUMBERS, "")).try_cast(NUMBER)


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0).cast(NUMBER))


def whole(text: Column) -> Column:
    """Non-null integer, fraction cut off."""
    return number_or_zero(text).cast("bigint")


def cell(row: Column, index) -> Column:
    """Cell of a positional row, null beyond its end."""
    return F.get(row, index if isinstance(index, Column) else F.lit(index))


def field_index(fields: Column, *names: str) -> Column:
    """Zero-based position of the first header equal to one of ``names``; null if none."""
    hits = F.filter(
        F.transform(fields, lambda f, i: F.when(f.isin(*names), i)),
        lambda i: i.isNotNull(),
    )
    return F.get(hits, F.lit(0))


def best_level(levels: Column) -> Column:
    """First price of an underscore-joined order book side."""
    return number(F.substring_index(levels, "_", 1))


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(
        year.isNotNull() & month.isNotNull() & day.isNotNull(),
        F.try_to_date(text, "yyyy-MM-dd"),
    )


def _piece(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def roc_date_compact(text: Column) -> Column:
    """``1150812`` or ``115/08/12`` (year counted from 1911)."""
    digits = F.replace(F.trim(text), F.lit("/"), F.lit(""))
    year = (F.substring(digits, 1, 3).try_cast("int") + 1911).cast("string")
    dashed = F.concat_ws("-", year, F.substring(digits, 4, 2), F.substring(digits, 6, 2))
    return F.when(digits.rlike(r"^[0-9]{7}\z"), dashed.try_cast("date"))


def roc_date_parts(text: Column) -> Column:
    """``115年08月12日`` or ``115/08/12``; parts need no leading zeros."""
    plain = F.replace(F.regexp_replace(text, "[年月]", "/"), F.lit("日"), F.lit(""))
    pattern = r"^\s*/*\s*([0-9]+)\s*/+\s*([0-9]+)\s*/+\s*([0-9]+)\s*/*\s*\z"
    return _date(_piece(plain, pattern, 1) + 1911, _piece(plain, pattern, 2), _piece(plain, pattern, 3))


def roc_or_common_date(text: Column) -> Column:
    """Date with ``/`` or ``-``; years below 1911 are counted from 1911."""
    pattern = r"^\s*([0-9]+)\s*[/-]\s*([0-9]+)\s*[/-]\s*([0-9]+)\s*\z"
    year = _piece(text, pattern, 1)
    year = F.when(year < 1911, year + 1911).otherwise(year)
    return _date(year, _piece(text, pattern, 2), _piece(text, pattern, 3))


def roc_month(text: Column) -> Column:
    """``11507`` to the first day of 2026-07."""
    pattern = r"^([0-9]{3,4})([0-9]{2})\z"
    clean = F.trim(text)
    return _date(_piece(clean, pattern, 1) + 1911, _piece(clean, pattern, 2), F.lit(1))


def thousands(text: Column) -> Column:
    """Amount in thousands to whole units."""
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("bigint") * 1000


def compact_date(text: Column) -> Column:
    """``yyyyMMdd``."""
    pattern = r"^([0-9]{4})([0-9]{2})([0-9]{2})\z"
    return _date(_piece(text, pattern, 1), _piece(text, pattern, 2), _piece(text, pattern, 3))


def _chinese_digit(char: Column) -> Column:
    at = F.instr(F.lit(CHINESE_DIGITS), char) - 1
    return F.when((F.length(char) == 1) & (at >= 0), at)


def chinese_number(text: Column) -> Column:
    """二, 十, 二十, 二十五 to integers; null for anything else."""
    ten = F.instr(text, CHINESE_TEN)
    high = F.when(ten == 1, F.lit(1)).otherwise(_chinese_digit(F.substr(text, ten - 1, F.lit(1))))
    low = F.when(ten == F.length(text), F.lit(0)).otherwise(
        _chinese_digit(F.substr(text, ten + 1, F.lit(1)))
    )
    return F.when(ten == 0, _chinese_digit(F.substr(text, F.lit(1), F.lit(1)))).otherwise(high * 10 + low)


def matching_minutes(content: Column) -> Column:
    """Matching interval named in the free text of a disposition notice."""

    def minutes(found: Column) -> Column:
        arabic = F.translate(found, FULL_WIDTH_DIGITS, ASCII_DIGITS).try_cast("int")
        return F.when(F.length(found) > 0, F.coalesce(arabic, chinese_number(found)))

    # As the variable of a lambda the text is searched once, however often it is used.
    return F.get(F.transform(F.array(F.regexp_extract(content, MATCHING_INTERVAL_PATTERN, 1)), minutes), F.lit(0))
