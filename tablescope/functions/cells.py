"""Cell rules as column expressions: missing markers, tolerant numbers, dates, booleans, text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

NUMERIC_TYPES = ("number", "currency", "percent", "integer")
STRICT_TYPES = (*NUMERIC_TYPES, "date", "boolean")  # soft markers such as "-" are missing only here


def is_missing(c: Column, strict: bool) -> Column:
    """NULL, blank or a textual missing marker; soft markers count only in numeric, date and boolean columns."""
    words = fixed.STRONG_NULL + (fixed.SOFT_NULL if strict else [])
    return c.isNull() | F.lower(F.trim(c)).isin(words)


# the decimal comma: the last separator after some dot, or the only separator unless three digits follow it
_DECIMAL_COMMA = r"^(?:(?=[^.]*\.)(?=.*,[^.]*$)([^,]*),|([^.,]*),(?![^.,]{3}$)(?=[^.,]*$))"


def parse_number(c: Column) -> Column:
    """Number in any usual notation; the last of both separators is the decimal one. NULL when there is none.

    Each step uses the one before it once or twice only, so that the expression stays small. Cells without a comma or a bracket, which are most,
    pass no pattern that needs one.
    """
    core = F.regexp_replace(c, r"[^0-9.,\-]+", "")
    marked = F.regexp_replace(core, _DECIMAL_COMMA, "$1$2;")
    with_comma = F.translate(F.regexp_replace(marked, r"\.(?=.*;)", ""), ";,", ".")
    grouped_by_dots = F.length(core) - F.length(F.replace(core, F.lit("."))) > 1
    plain = F.when(core.contains(","), with_comma).when(grouped_by_dots, F.replace(core, F.lit("."))).otherwise(core)
    value = F.regexp_extract(plain, r"-?[0-9]+(\.[0-9]+)?", 0).try_cast("double")
    sign = F.when(c.contains("(") & c.rlike(r"^\s*\([^-]*\)\s*$"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return value * sign + F.lit(0.0)


def day_first_vote(c: Column) -> Column:
    """1 when the cell can only be day-first, 0 when it can only be month-first, NULL when it tells nothing."""
    f1 = F.regexp_extract(F.trim(c), _SLASH, 1).try_cast("int")
    f2 = F.regexp_extract(F.trim(c), _SLASH, 2).try_cast("int")
    return F.when((f1 > 12) & (f2 <= 12), 1).when((f2 > 12) & (f1 <= 12), 0)


_SLASH = r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{2,4})"
_ISO_DAY = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_ISO_TIME = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T]([0-9]{1,2}):([0-9]{2})"


def canonical_date(c: Column, day_first: bool = False) -> Column:
    """'yyyy-MM-dd' or 'yyyy-MM-dd HH:mm'; NULL when the cell is no real date.

    The format is chosen by pattern before parsing, as a failed parse is slow.
    """
    text = F.trim(c)

    def read(fmt: str, x: Column = text) -> Column:
        return F.try_to_date(x, fmt)

    slashed = F.replace(F.regexp_extract(text, _SLASH, 0), F.lit("."), F.lit("/"))
    orders = ["d/M", "M/d"] if day_first else ["M/d", "d/M"]  # a field over 12 falls through to the other order
    named = F.regexp_replace(text, r"[,\s]+", " ")
    day = (F.when(text.rlike(_ISO_DAY), read("yyyy-M-d", F.regexp_extract(text, _ISO_DAY, 0)))
           .when(text.rlike(r"^[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}"),
                 F.coalesce(*[read(f"{o}/yyyy", slashed) for o in orders]))
           .when(text.rlike(_SLASH), F.coalesce(*[read(f"{o}/yy", slashed) for o in orders]))
           .when(text.rlike(r"^[0-9]{1,2}\s+[A-Za-z]{3}\s+[0-9]{4}$"), read("d MMM yyyy", named))
           .when(text.rlike(r"^[0-9]{1,2}\s+[A-Za-z]{4,}\s+[0-9]{4}$"), read("d MMMM yyyy", named))
           .when(text.rlike(r"^[A-Za-z]{3}\s+[0-9]{1,2},?\s+[0-9]{4}$"), read("MMM d yyyy", named))
           .when(text.rlike(r"^[A-Za-z]{4,}\s+[0-9]{1,2},?\s+[0-9]{4}$"), read("MMMM d yyyy", named)))
    clock = F.when(text.rlike(_ISO_TIME), F.concat(F.lit(" "), F.lpad(F.regexp_extract(text, _ISO_TIME, 1), 2, "0"),
                                                   F.lit(":"), F.regexp_extract(text, _ISO_TIME, 2)))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.coalesce(clock, F.lit("")))


def parse_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(fixed.TRUE_WORDS), F.lit(True)).when(word.isin(fixed.FALSE_WORDS), F.lit(False))


def collapse(c: Column) -> Column:
    """Trim, and turn each run of whitespace into one space."""
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def normalize(c: Column, semantic_type: str, day_first: bool = False) -> Column:
    """The cleaned cell of a text column for its semantic type; dates stay canonical text until `typed`."""
    missing = is_missing(c, semantic_type in STRICT_TYPES)
    if semantic_type in NUMERIC_TYPES:
        value = parse_number(c)
        value = F.floor(value + 0.5).cast("long") if semantic_type == "integer" else value
    elif semantic_type == "date":
        value = canonical_date(c, day_first)
    elif semantic_type == "boolean":
        value = parse_boolean(c)
    else:
        value = collapse(c)
    return F.when(~missing, value)


def typed(c: Column, semantic_type: str) -> Column:
    return c.try_cast("timestamp_ntz") if semantic_type == "date" else c


def spreadsheet_safe(c: Column) -> Column:
    """Cell text that a spreadsheet will not run as a formula and shows left to right."""
    text = F.regexp_replace(c, "[‎‏‪-‮⁦-⁩]", "")
    rtl = text.rlike("[֐-ࣿיִ-﷿ﹰ-ﻼ]")
    shown = F.when(rtl, F.concat(F.lit("‎"), text)).otherwise(text)
    lead = F.substring(c, 1, 1)
    number = c.try_cast("double")
    formula = lead.isin("\t", "\r") | (lead.isin("=", "+", "-", "@") & (number.isNull() | F.isnan(number)))
    return F.when(formula, F.concat(F.lit("'"), shown)).otherwise(shown)
