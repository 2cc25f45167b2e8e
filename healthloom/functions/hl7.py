"""HL7v2 messages as text: segments end with CR, fields with |, components with ^."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that hold dates and times, by segment.
DATETIME_FIELDS = {"MSH": (7,), "PID": (7, 29, 33), "PV1": (44, 45), "ORC": (9, 15, 27), "OBR": (7, 8, 22, 36), "OBX": (12, 14, 19), "TQ1": (7, 8), "SPM": (18, 19), "RXA": (3, 4, 16, 22)}
_BATCH_SEGMENTS = ("FHS", "BHS", "BTS", "FTS")


def normalize_datetime(value: Column) -> Column:
    """Up to 14 digits, a fraction of 4, and an offset of 4; what doesn't start with 8 digits stays."""
    p = r"^(\d{8}\d*)(\.\d+)?([+-]\d+)?"
    base, fraction, zone = F.regexp_extract(value, p, 1), F.regexp_extract(value, p, 2), F.regexp_extract(value, p, 3)
    text = F.concat(F.substring(base, 1, 14), F.substring(fraction, 1, 5), F.when(F.length(zone) >= 5, F.substring(zone, 1, 5)).otherwise(F.lit("")))
    return F.when(value.rlike(p), text).otherwise(value)


def _place(segment: str, field: int) -> int:
    # The field separator itself is MSH-1.
    return field - 1 if segment == "MSH" else field


def _lines(message: Column) -> Column:
    return F.split(message, "[\r\n]+")


def _normalized(line: Column, places: Column) -> Column:
    """The line with the fields at places normalised in their first components."""

    def first_component(f: Column) -> Column:
        return F.concat(normalize_datetime(F.split_part(f, F.lit("^"), F.lit(1))), F.regexp_extract(f, r"^[^^]*(\^.*)?$", 1))

    return F.array_join(F.transform(F.split(line, r"\|"), lambda f, i: F.when((f != "") & F.array_contains(places, i), first_component(f)).otherwise(f)), "|")


def normalize_datetime_segment(line: Column, segment: str, fields: tuple[int, ...]) -> Column:
    """A line with its date fields normalised, if it is such a segment."""
    return F.when(F.startswith(line, F.lit(f"{segment}|")), _normalized(line, F.array(*[F.lit(_place(segment, f)) for f in fields]))).otherwise(line)


def standardize_datetimes(message: Column) -> Column:
    """The message with all its known date fields normalised; its lines end with LF."""
    known = F.create_map(*[x for s, fields in DATETIME_FIELDS.items() for x in (F.lit(s), F.array(*[F.lit(_place(s, f)) for f in fields]))])

    def one(line: Column) -> Column:
        places = F.try_element_at(known, F.split_part(line, F.lit("|"), F.lit(1)))
        return F.when(places.isNotNull(), _normalized(line, places)).otherwise(line)

    return F.array_join(F.transform(_lines(message), one), "\n")


def default_value(message: Column, segment: str, field: int, value: str) -> Column:
    """The message with a field of the first such segment set, if it is blank. Without the segment, unchanged."""
    lines = _lines(message)
    at = F.array_position(F.transform(lines, lambda x: F.split_part(x, F.lit("|"), F.lit(1))), segment)
    place = _place(segment, field)

    def filled(line: Column) -> Column:
        parts = F.split(line, r"\|")
        padded = F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(place + 1) - F.size(parts), F.lit(0))))
        return F.array_join(F.transform(padded, lambda f, i: F.when((i == place) & (F.trim(f) == ""), F.lit(value)).otherwise(f)), "|")

    return F.when(at == 0, message).otherwise(F.array_join(F.transform(lines, lambda x, i: F.when(i + 1 == at, filled(x)).otherwise(x)), "\n"))


def batch_messages(batch: Column) -> Column:
    """The messages of a batch file: one from each MSH on; batch and file segments go, each line ends with CR."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(batch), "[\r\n]+", "\n"), "[\u000b\u001c]", "")
    lines = F.filter(F.split(clean, "\n"), lambda x: ~F.substring(x, 1, 3).isin(*_BATCH_SEGMENTS) & (x != ""))
    whole = F.concat(F.array_join(lines, "\r"), F.lit("\r"))
    return F.when(F.size(lines) > 0, F.split(whole, "(?<=\r)(?=MSH)")).otherwise(F.array().cast("array<string>"))


def explode_batches(files: DataFrame, content: str = "value") -> DataFrame:
    """One row a message, with its place in the file."""
    return files.select(*[c for c in files.columns if c != content], F.posexplode(batch_messages(F.col(content))).alias("position", "message"))


def message_kind(message: Column) -> Column:
    """hl7v2 for messages that begin with MSH, else xml for markup, else null."""
    return F.when(F.startswith(message, F.lit("MSH")), "hl7v2").when(F.ltrim(message).startswith("<"), "xml")


def message_structure(message: Column) -> Column:
    """The structure from MSH-9, such as ADT_A01."""
    nine = F.split_part(F.element_at(_lines(message), 1), F.lit("|"), F.lit(9))
    third = F.split_part(nine, F.lit("^"), F.lit(3))
    return F.when(third != "", third).otherwise(F.concat_ws("_", F.split_part(nine, F.lit("^"), F.lit(1)), F.nullif(F.split_part(nine, F.lit("^"), F.lit(2)), F.lit(""))))


def patient(message: Column) -> Column:
    """The Patient that the first PID segment tells of: id (PID-3), name, birthDate, gender, address and phone; null without PID.

    Empty parts are null, of repeated fields the first counts, given names are those of PID-5.2 and 5.3.
    """
    pid = F.get(F.filter(_lines(message), lambda x: F.startswith(x, F.lit("PID|"))), F.lit(0))
    field = lambda n: F.split_part(F.split_part(pid, F.lit("|"), F.lit(n + 1)), F.lit("~"), F.lit(1))
    part = lambda n, k: F.nullif(F.trim(F.split_part(field(n), F.lit("^"), F.lit(k))), F.lit(""))
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    # The codes of administrative sex.
    sex = F.upper(part(8, 1))
    gender = F.when(sex == "M", "male").when(sex == "F", "female").when(sex.isin("O", "A"), "other").when(sex.isNotNull(), "unknown")
    return F.when(
        pid.isNotNull(),
        F.struct(
            part(3, 1).alias("id"), part(5, 1).alias("family"), some(part(5, 2), part(5, 3)).alias("given"),
            F.date_format(F.try_to_timestamp(F.left(part(7, 1), F.lit(8)), F.lit("yyyyMMdd")), "yyyy-MM-dd").alias("birthDate"), gender.alias("gender"),
            F.struct(some(part(11, 1), part(11, 2)).alias("line"), part(11, 3).alias("city"), part(11, 4).alias("state"), part(11, 5).alias("postalCode"), part(11, 6).alias("country")).alias("address"),
            part(13, 1).alias("phone"),
        ),
    )
