"""Column functions: parsing, padding, dates, safe arithmetic. None of them needs Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no value (fixed values).
BLANKS = ["", "-", "--", "N/A"]
STRICT_BLANKS = ["", "-", "nan", "None"]
#: Texts of a boolean (fixed values).
TRUE_TEXTS, FALSE_TEXTS = ["true", "1", "y", "yes"], ["false", "0", "n", "no"]


def divided(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def number(text: Column) -> Column:
    """A double from text with thousands separators and percent signs; blanks and bad texts are null."""
    bare = F.trim(F.regexp_replace(F.trim(text), "[,%]", ""))
    return F.when(~bare.isin(*BLANKS), bare.try_cast("double"))


def number_strict(text: Column) -> Column:
    """As number(), also without plus signs; a bad text raises."""
    bare = F.trim(F.regexp_replace(F.trim(text), "[,%+]", ""))
    return F.when(~bare.isin(*STRICT_BLANKS), bare.cast("double"))


def whole(x: Column) -> Column:
    """Rounded half to even, as a long."""
    return F.bround(x, 0).cast("long")


def day(text: Column) -> Column:
    """A date from YYYYMMDD, YYYY-MM-DD or YYYY/MM/DD; anything else, and days that no calendar has, are null."""
    digits = F.regexp_replace(F.trim(text), "[-/]", "")
    return F.when(digits.rlike("^[0-9]{8}$"), F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def dotted_day(text: Column) -> Column:
    """A date from YYYY.MM.DD, null for other shapes."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.try_to_timestamp(bare, F.lit("yyyy.MM.dd")).cast("date"))


def truth(text: Column) -> Column:
    """A boolean from the known texts, any case; others are null."""
    bare = F.lower(F.trim(text))
    return F.when(bare.isin(*TRUE_TEXTS), True).when(bare.isin(*FALSE_TEXTS), False)


def padded(code: Column, width: int = 6) -> Column:
    """Zeros before a shorter code; a longer one stays whole."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def available_at(date: Column, days: int, hour: int) -> Column:
    """The UTC instant of an hour in Seoul (UTC+9, without summer time), some days after a date."""
    return (F.date_add(date, days).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour - 9))).cast("timestamp_ntz")


def availability_basis(date: Column, basis: Column) -> Column:
    return F.greatest(date, F.coalesce(basis, date))


def row_sum(*columns: Column) -> Column:
    """The sum of columns, nulls as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def finite(x: Column) -> Column:
    """x, null where it is infinite or not a number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clipped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def redacted(text: Column) -> Column:
    """Long digit runs and key=value secrets masked."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)(token|key|secret)=[^&\s]+", "$1=***"), r"\d{6,}", "***")


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1] from the sha-256 of the parts joined by a bar."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def label_seed(text: Column) -> Column:
    """The sum of the code points of an ASCII label."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii), F.lit(0), lambda a, b: a + b)


def business_day_after(date: Column, k: int) -> Column:
    """The k-th Monday-to-Friday day after a date."""
    ahead = F.sequence(F.date_add(date, 1), F.date_add(date, 7 * (k // 5 + 2)))
    return F.element_at(F.filter(ahead, lambda d: F.weekday(d) < 5), k)


def html_escaped(text: Column) -> Column:
    """The five characters that mark up HTML as entities, the ampersand first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


#: Ranges of characters that take two columns of a terminal (East Asian wide and full-width ones).
WIDE = "\\u1100-\\u115f\\u2e80-\\u303e\\u3041-\\u33ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\ua000-\\ua4cf\\uac00-\\ud7a3\\uf900-\\ufaff\\ufe30-\\ufe6f\\uff00-\\uff60\\uffe0-\\uffe6"


def display_width(text: Column) -> Column:
    """Columns of a terminal that a text takes."""
    return F.length(text) + F.length(F.regexp_replace(text, f"[^{WIDE}]", ""))


def display_padded(text: Column, width: int) -> Column:
    """Spaces after a text up to a display width; a longer one stays whole."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - display_width(text))))
