"""Text-to-value parsing that yields NULL for anything unreadable, never an error."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelytics.contract import DATE_FORMATS, ISO, MISSING_TOKENS, TWO_DIGIT_PIVOT

# Spark's text-to-double cast also takes Java literals (1d, 1f, hexadecimal floats); a data file means no number by
# them. Their letters occur in no other number but infinity.
_JAVA_LETTERS = "[dDfFxX]"
_INFINITY = r"(?i)^\s*[+-]?inf"


def blank_to_null(text: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """NULL where the cell is exactly one of the missing-value tokens."""
    return F.when(~text.isin(*tokens), text)


def parse_number(text: Column) -> Column:
    """DOUBLE from text; unreadable text becomes NULL, ``inf`` stays infinite, ``nan`` is left to ``nan_to_null``."""
    return F.when(~text.rlike(_JAVA_LETTERS) | text.rlike(_INFINITY), text.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


#: What the letters of a layout stand for in a text, as narrowly as it can be said without the calendar.
_FIELDS = {
    "M": "0*(?:1[0-2]|[1-9])",
    "MM": "(?:1[0-2]|0[1-9])",
    "MMM": "[A-Za-z]{3}",
    "MMMM": "[A-Za-z]{3,9}",
    "d": "0*(?:[12][0-9]|3[01]|[1-9])",
    "dd": "(?:0[1-9]|[12][0-9]|3[01])",
    "yy": "[0-9]{2}",
    "yyyy": "[0-9]{4}",
    "H": "[0-9]+",
    "HH": "[0-9]{2}",
    "mm": "[0-9]{2}",
    "ss": "[0-9]{2}",
}
_LAYOUT_PARTS = re.compile(r"([A-Za-z])\1*|[^A-Za-z]+")
_ISO_SHAPE = "^[+-]?[0-9]{4,7}(?:-[0-9]{1,2}(?:-[0-9]{1,2}(?:[ T](?s:.*))?)?)?$"
#: What a text may have before its date.
_WEEKDAY = "^(?i:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?i:day)?[.,]?\\s+"


def _shape(layout: str) -> tuple[str, str | None]:
    """A pattern that every text of ``layout`` matches, and what the text has between its letters and digits; None if
    the layout has parts unknown here."""
    pattern, between, known = "", "", True
    for part in _LAYOUT_PARTS.finditer(layout):
        if part[1] is None:
            pattern, between = pattern + re.escape(part[0]), between + part[0]
        else:
            known = known and part[0] in _FIELDS
            pattern += _FIELDS.get(part[0], "(?s:.+)")
    if not known or set(layout) & set("'[]{}#"):
        return "", None
    return f"^{pattern}$", between


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """DATE from the first layout that reads the text; a weekday before it is passed over.

    What stands between a text's letters and digits tells which layouts can read it at all, and of those it has to match
    the shape of one before that is tried; so nearly every text is parsed once, and one that is no date hardly ever. Years
    have no sign, but for ISO.
    """
    # Each step sees the one before as a variable. Written out, what a step uses more than once would be worked out as
    # often, in one generated method that is too long for Java's compiler.
    bare = F.trim(text)
    begins_with_letter = F.substring(bare, 1, 1).rlike("[A-Za-z]")
    plain = F.when(begins_with_letter, F.regexp_replace(bare, _WEEKDAY, "")).otherwise(bare)
    between = lambda x: F.translate(x, string.ascii_letters + string.digits, "")
    return _let(_let(plain, lambda x: F.struct(x.alias("text"), between(x).alias("between"))), lambda x: _read(x, formats))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _read(known: Column, formats: Sequence[str]) -> Column:
    text = known["text"]

    def read(layout: str) -> Column:
        if layout == ISO:
            return F.when(text.rlike(_ISO_SHAPE), text.try_cast("date"))
        day = F.try_to_date(text, layout)
        if "yy" in layout.replace("yyyy", ""):
            day = F.when(F.year(day) >= 2000 + TWO_DIGIT_PIVOT, F.add_months(day, -1200)).otherwise(day)
        shape = _shape(layout)[0]
        return F.when(text.rlike(shape), day) if shape else day

    kinds = {layout: None if layout == ISO else _shape(layout)[1] for layout in formats}
    anywhere = [layout for layout in formats if kinds[layout] is None]
    result = F.coalesce(*map(read, anywhere), F.lit(None).cast("date"))
    for kind in reversed(dict.fromkeys(k for k in kinds.values() if k is not None)):
        # a layout beyond these tells nothing of its texts and keeps its place in the order
        chain = [layout for layout in formats if kinds[layout] in (kind, None)]
        result = F.when(known["between"] == kind, F.coalesce(*map(read, chain), F.lit(None).cast("date"))).otherwise(result)
    return result


def iso_text(day: Column | str) -> Column:
    """DATE as ``yyyy-MM-dd`` text, for export only."""
    return F.date_format(day, "yyyy-MM-dd")
