"""Scalar harmonisation as native columns. What can't be read is null, or stays as it was where said so; nothing throws per row."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def standardize_name(name: Column, trim: bool = True, case: str = "upper", remove_numbers: bool = True) -> Column:
    """Letters, digits and blanks only; without digits, trimmed, in upper, lower or title case."""
    if case not in ("upper", "lower", "title"):
        raise ValueError(f"case is upper, lower or title, not {case}")
    out = F.regexp_replace(name, r"[^\p{L}\p{N} ]", "")
    if remove_numbers:
        out = F.regexp_replace(out, r"\p{N}", "")
    if trim:
        out = F.trim(out)
    if case == "title":
        return _title(out) if not remove_numbers else F.initcap(out)
    return F.upper(out) if case == "upper" else F.lower(out)


@F.pandas_udf(StringType())
def _title(s: pd.Series) -> pd.Series:
    # A letter after a digit starts a word here, other than in initcap.
    return s.map(lambda x: x.title(), na_action="ignore")


def standardize_names(names: Column, **options) -> Column:
    return F.transform(names, lambda n: standardize_name(n, **options))


def standardize_birth_date(value: Column, fmt: str = "%Y-%m-%d", future: bool = False) -> Column:
    """y-m-d from a date in a strptime-like format, parts as they are written (not padded). Null if it isn't a date, or in the future."""
    order = [c for c in fmt if c in "Ymd"]
    if sorted(order) != sorted("Ymd"):
        raise ValueError(f"the format needs %Y, %m and %d once each: {fmt}")
    parts = F.split(F.trim(value), "[^0-9]")
    part = {c: F.get(parts, F.lit(i)) for i, c in enumerate(order)}
    text = F.concat_ws("-", part["Y"], part["m"], part["d"])
    real = F.try_make_date(*[F.expr("0") if c is None else c for c in [F.try_to_number(part[k], F.lit("9999")).cast("int") for k in "Ymd"]]) if hasattr(F, "try_make_date") else F.try_to_timestamp(text, F.lit("y-M-d")).cast("date")
    fine = (F.size(parts) == 3) & part["Y"].rlike("^[0-9]{4}$") & part["m"].rlike("^[0-9]{1,2}$") & part["d"].rlike("^[0-9]{1,2}$") & real.isNotNull()
    if not future:
        fine = fine & (real <= F.current_date())
    return F.when(F.coalesce(fine, F.lit(False)), text)


def date_text(value: Column, with_time: bool = False) -> Column:
    """A date or timestamp as text; text that isn't a date stays."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss" if with_time else "yyyy-MM-dd")


def hash_identifier(value: Column, salt: Column | str) -> Column:
    """SHA-256 of value and salt, in hex."""
    return F.sha2(F.concat(value, F.lit(salt) if isinstance(salt, str) else salt), 256)


def patient_plain_text(given: Column, family: Column, birth_date: Column, address: Column) -> Column:
    """What a patient's linking identifier is the hash of: names, birth date and one-line address, joined by dashes."""
    return F.concat_ws("-", F.array_join(F.concat(given, F.array(family)), "-"), birth_date, address)


def one_line_address(line: Column, city: Column, state: Column, postal_code: Column) -> Column:
    """"lines city, state zip"; empty if all parts are missing."""
    text = F.concat(F.coalesce(F.array_join(line, " "), F.lit("")), F.lit(" "), F.coalesce(city, F.lit("")), F.lit(", "), F.coalesce(state, F.lit("")), F.lit(" "), F.coalesce(postal_code, F.lit("")))
    return F.when(F.coalesce(F.array_join(line, ""), city, state, postal_code).isNull(), F.lit("")).otherwise(text)


def list_text(values: Column) -> Column:
    return F.array_join(values, ",")


# Display forms of the viewer.
def display_name(use: Column, prefix: Column, given: Column, family: Column, suffix: Column) -> Column:
    """Name parts that aren't empty, with blanks between; a use stands before, with a colon."""
    words = F.concat(F.coalesce(prefix, F.array()), F.coalesce(given, F.array()), F.array(family), F.coalesce(suffix, F.array()))
    name = F.array_join(F.filter(F.array_compact(words), lambda w: w != ""), " ")
    return F.when(F.coalesce(use, F.lit("")) == "", name).otherwise(F.concat(F.initcap(use), F.lit(": "), name))


def display_address(line: Column, city: Column, state: Column, postal_code: Column, country: Column) -> Column:
    full = lambda cols, sep: F.array_join(F.filter(F.array_compact(cols), lambda w: w != ""), sep)
    below = full(F.array(city, state), ", ")
    return full(F.array(full(F.coalesce(line, F.array()), "\n"), full(F.array(below, postal_code), " "), country), "\n")


def display_datetime(value: Column) -> Column:
    """ISO date and time as MM/DD/YYYY h:mm AM with its offset (UTC where none is told); anything else stays."""
    p = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
    x = lambda i: F.regexp_extract(value, p, i)
    hour = x(4).try_cast("int")
    zone = F.when(x(6).isin("", "Z"), F.lit("UTC")).otherwise(x(6))
    text = F.concat(x(2), F.lit("/"), x(3), F.lit("/"), x(1), F.lit(" "), F.when(hour % 12 == 0, F.lit("12")).otherwise((hour % 12).cast("string")), F.lit(":"), x(5), F.when(hour < 12, F.lit(" AM ")).otherwise(F.lit(" PM ")), zone)
    return F.when(value.rlike(p), text).otherwise(value)


def display_date(value: Column) -> Column:
    """MM/DD/YYYY of an ISO date (a time may follow) or YYYYMMDD; null if it is neither."""
    iso, plain = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")), F.when(value.rlike("^[0-9]{8}"), F.try_to_timestamp(F.substring(value, 1, 8), F.lit("yyyyMMdd")))
    return F.date_format(F.coalesce(plain, iso), "MM/dd/yyyy")


def display_phone(value: Column) -> Column:
    """NNN-NNN-NNNN of ten digits, +1 and signs dropped; null otherwise."""
    digits = F.regexp_replace(F.regexp_replace(value, r"^\+1", ""), "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.regexp_replace(digits, r"^(...)(...)(....)$", "$1-$2-$3"))


def phone_search_forms(value: Column) -> Column:
    """The ways a ten-digit number may be stored; other values: their first blank as a plus."""
    d = F.regexp_replace(value, "[^0-9]", "")
    parts = r"^(...)(...)(....)$"
    # The stored forms that searches try.
    forms = F.array(d, *[F.regexp_replace(d, parts, f) for f in ("$1-$2-$3", "$1+$2+$3", "($1)$2-$3", "($1)+$2-$3", "+1$1$2$3", "+1+$1-$2-$3")])
    return F.when(F.length(d) == 10, forms).otherwise(F.array(F.regexp_replace(value, "^([^ ]*) ", "$1+")))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"\s+", "-"), "[^a-z0-9-]", "")


def vital(value: Column, unit: Column) -> Column:
    # Coded units and what is shown for them.
    shown = F.create_map(*[F.lit(x) for pair in (("[in_i]", "in"), ("[lb_av]", "lb"), ("cm", "cm"), ("kg", "kg"), ("kg/m2", "kg/m2")) for x in pair])
    return F.concat(value, F.lit(" "), F.coalesce(F.try_element_at(shown, unit), F.lit("")))


def age_years(born: Column, at: Column) -> Column:
    return F.floor(F.months_between(at, born) / 12).cast("int")


def patient_age(born: Column, deceased: Column, today: Column | None = None) -> Column:
    """Whole years today; null for the dead, whose age is age_at_death."""
    return F.when(deceased.isNull(), age_years(born, F.current_date() if today is None else today))


def choice_text(text: Column, quantity: Column, unit: Column, display: Column, concept: Column) -> Column:
    """A value of unknown kind as text: string or number, quantity with unit (a blank before a word), concept's display or text."""
    measured = F.concat(quantity.cast("string"), F.when(unit.rlike("^[A-Za-z]"), F.lit(" ")).otherwise(F.lit("")), F.coalesce(unit, F.lit("")))
    return F.coalesce(text, measured, display, concept)


def ordered_distinct(values: Column, separator: str = ", ") -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array_compact(values), lambda x: x != "")), separator)


def sanitized_codes(value: Column) -> Column:
    """A list cut at the first of comma, bar and semicolon that occurs, trimmed, without empties."""
    cut = F.when(F.contains(value, F.lit(",")), F.split(value, ",")).when(F.contains(value, F.lit("|")), F.split(value, r"\|")).when(F.contains(value, F.lit(";")), F.split(value, ";")).otherwise(F.array(value))
    return F.filter(F.transform(cut, lambda c: F.trim(c)), lambda c: c != "")


def select_value(values: Column, criteria: str = "first", seed: int | None = None) -> Column:
    """The first, last or a random one of an array, or all of it; null for empty ones."""
    if criteria == "all":
        return values
    if criteria == "random":
        return F.try_element_at(F.shuffle(values, seed) if seed is not None else F.shuffle(values), F.lit(1))
    if criteria not in ("first", "last"):
        raise ValueError(f'selection criteria are "first", "last", "random" and "all", not {criteria}')
    return F.try_element_at(values, F.lit(1 if criteria == "first" else -1))


def nicknames(lines: Sequence[str]) -> dict[str, str]:
    """Nickname to name, from lines "name:nick,nick"; the last line that has a nickname wins."""
    found = {}
    for line in lines:
        name, _, nicks = line.strip().partition(":")
        found |= {n.strip(): name.strip() for n in nicks.split(",") if n.strip()}
    return found
