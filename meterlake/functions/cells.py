"""Reading untyped text cells: missing values, numbers and timestamps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mean "no value" in a text cell (trimmed, lower case).
MISSING_WORDS = ["", "na", "nat", "none", "nan"]

# Cell texts the reader itself turns into NULL (exact match).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Texts that can be a date: year first, three numbers, or a month name.
_DATE = r"^(\d{4}[-/.]\d|(19|20)\d{6}([T\s]|$)|\d{1,2}[-/.]\d{1,2}[-/.]\d{2}|\d{1,2}[-/ ][A-Za-z]{3}|[A-Za-z]{3,9}\.? \d)"
# Left out before a date: a weekday with a comma, and the ending of a day's number. An hour alone
# before AM or PM gets minutes.
_AROUND = r"^[A-Za-z]{3,9}, *(?=\d)|(?<=\d)(?:st|nd|rd|th)\b"
_HOUR_ALONE = r"(\s\d{1,2})\s*(?=[AaPp][Mm]$)"
_YEAR_20XX = r"^(\d{1,2}(?:[-/.]\d{1,2}[-/.]|[-/ ][A-Za-z]{3,9}[-/ ]))([0-6]\d)(?=\s|T|$)"
_YEAR_19XX = r"^(\d{1,2}(?:[-/.]\d{1,2}[-/.]|[-/ ][A-Za-z]{3,9}[-/ ]))([7-9]\d)(?=\s|T|$)"
_COMPACT = r"^((?:19|20)\d{2})(0[1-9]|1[0-2])([0-2]\d|3[01])(?=[T\s]|$)"
_ISO_DATE = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[T\s]*"
_SEPT = r"(?i)\bsept\b"
_DAY_MONTH = r"^(\d{1,2})[-/ ]([A-Za-z]{3,9})[-/, ]+(\d{4})"
_MONTH_DAY = r"^([A-Za-z]{3,9})\.? +(\d{1,2}),? +(\d{4})"
_THREE_PARTS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})[T\s]*"
_TWELVE = r"\b12((?::\d+)+(?:\.\d+)?\s*[AaPp][Mm])$"
_AM_PM = r"\s*[AaPp][Mm]$"
_PM = r"\d\s*[Pp][Mm]$"
_NO_HALF_DAY_HOUR = r"\s(1[3-9]|2\d)(:\d+)+(\.\d+)?\s*[AaPp][Mm]$"
_LETTER = "[A-Za-z]"
# Rewriting in this order; those of the first list need no letter in the text, all others do.
_NUMERIC_STEPS = ((_YEAR_20XX, "$120$2"), (_YEAR_19XX, "$119$2"), (_COMPACT, "$1-$2-$3"), (_ISO_DATE, "$1-$2-$3 "))
_LETTER_STEPS = ((_SEPT, "Sep"), (_DAY_MONTH, "$1 $2 $3"), (_MONTH_DAY, "$1 $2, $3"), (_TWELVE, "00$1"), (_AM_PM, ""))
_AROUND_STEPS = ((_AROUND, ""), (_HOUR_ALONE, "$1:00"))
TIME_ONLY = r"^\s*\d{1,2}(:\d{2}){1,2}(\.\d+)?\s*$"

# Dates with a month name, in any of these orders, with a clock of up to six places.
_NAMED_MONTH = (
    "[d MMM yyyy][d MMMM yyyy][MMM d, yyyy][MMMM d, yyyy]"
    "[ H:m[:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]]]"
)


def is_missing(c: Column) -> Column:
    """NULL, or text that only says that there is no value."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(MISSING_WORDS)


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def fill_missing(c: Column, other: Column) -> Column:
    return F.when(is_missing(c), other).otherwise(c)


def number(c: Column) -> Column:
    """Text to double; anything that is not a plain number is NULL."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def number_or_zero(c: Column) -> Column:
    """A numeric column with NULL and NaN counted as zero."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def text_number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rewritten(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, into in steps:
        text = F.regexp_replace(text, pattern, into)
    return text


def timestamp(c: Column) -> Column:
    """Text to timestamp. Year-first text is ISO; other numeric dates are read day first and,
    where that is no calendar date, month first.

    Texts are rewritten to ISO step by step and cast, which stays cheap for cells that do not fit;
    only dates with a month name go through a format. A text without letters takes only the steps
    that it can fit. Each step is worked out once, and the expression stays small where Spark copies
    it into a filter."""
    return _bound(F.trim(c), lambda text: F.when(text.rlike(_LETTER), _bound(_rewritten(text, _AROUND_STEPS), _lettered)).otherwise(_numeric(text)))


def _numeric(text: Column) -> Column:
    return F.when(text.rlike(_DATE), _bound(_rewritten(text, _NUMERIC_STEPS), _cast))


def _lettered(text: Column) -> Column:
    def moment(iso: Column) -> Column:
        return F.coalesce(_cast(iso), F.when(iso.rlike(_LETTER), F.try_to_timestamp(iso, F.lit(_NAMED_MONTH))))

    afternoon = F.when(text.rlike(_PM), F.lit(12)).otherwise(F.lit(0))
    read = F.timestamp_add("HOUR", afternoon, _bound(_rewritten(text, _NUMERIC_STEPS + _LETTER_STEPS), moment))
    return F.when(text.rlike(_DATE) & ~text.rlike(_NO_HALF_DAY_HOUR), read)


def _cast(iso: Column) -> Column:
    return F.coalesce(
        F.regexp_replace(iso, _THREE_PARTS, "$3-$2-$1 ").try_cast("timestamp"),
        F.regexp_replace(iso, _THREE_PARTS, "$3-$1-$2 ").try_cast("timestamp"),
    )


def with_timestamps(df: DataFrame, cells: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({name: timestamp(c) for name, c in cells.items()})


def with_full_start(df: DataFrame, name: str, start: Column, dates: list[Column], run_date: Column) -> DataFrame:
    """Adds the timestamp of a start cell. A cell with a clock time only takes the date of the
    first of ``dates`` (timestamps) that has one, else the date of the import."""
    day = F.coalesce(*[F.to_date(d) for d in dates], run_date)
    on_day = F.concat_ws(" ", day.cast("string"), F.trim(start)).try_cast("timestamp")
    return df.withColumn(name, F.when(start.rlike(TIME_ONLY), on_day).otherwise(timestamp(start)))
