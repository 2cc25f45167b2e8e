"""Patients as structs: harmonised names, phones, dates and countries, linking identifiers, phonetic codes, geocodes.

A patient is a struct as in FHIR: name array<struct<family, given, use>>, telecom, address, birthDate. Columns are immutable,
so there is nothing to overwrite: functions return the changed field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fhirpath import field_by_use
from ..functions.phone import standardize_phone
from ..functions.phonetic import double_metaphone_codes


def names(patient: Column, **options) -> Column:
    return F.transform(patient["name"], lambda n: n.withField("family", text.standardize_name(n["family"], **options)).withField("given", text.standardize_names(n["given"], **options)))


def phones(patient: Column, countries: tuple[str, ...] = ()) -> Column:
    """telecom with its phone entries in E.164; others stay."""
    return F.transform(patient["telecom"], lambda t: F.when(t["system"] == "phone", t.withField("value", standardize_phone(t["value"], countries))).otherwise(t))


def birth_date(patient: Column, fmt: str = "%Y-%m-%d") -> Column:
    return text.standardize_birth_date(patient["birthDate"], fmt)


def address_countries(patient: Column) -> Column:
    """Countries that a patient's addresses name, in order: what phone numbers are read by."""
    return F.array_distinct(F.filter(F.transform(patient["address"], lambda a: a["country"]), lambda c: c.isNotNull()))


def harmonised(patient: Column, **options) -> Column:
    return patient.withField("name", names(patient, **options)).withField("telecom", phones(patient)).withField("birthDate", birth_date(patient))


def linking_identifier(patient: Column, salt: str) -> Column:
    """Hash of the names, birth date and address (home or first) of a patient."""
    name, address = F.get(patient["name"], F.lit(0)), field_by_use(patient["address"], "home")
    line = text.one_line_address(address["line"], address["city"], address["state"], address["postalCode"])
    return text.hash_identifier(text.patient_plain_text(name["given"], name["family"], patient["birthDate"], line), salt)


def with_identifier(patient: Column, salt: str, system: str = "urn:ietf:rfc:3986") -> Column:
    entry = F.struct(linking_identifier(patient, salt).alias("value"), F.lit(system).alias("system"), F.lit("temp").alias("use"))
    return F.concat(patient["identifier"], F.array(entry))


def name_codes(patients: DataFrame, patient: str = "patient") -> DataFrame:
    """patients with family_codes and given_codes of the first name: primary and secondary Double Metaphone."""
    name = F.get(F.col(patient)["name"], F.lit(0))
    return patients.withColumn("family_codes", double_metaphone_codes(name["family"])).withColumn("given_codes", double_metaphone_codes(F.array_join(name["given"], " ")))


def data_source(resources: DataFrame, source: str) -> DataFrame:
    """resources (with meta_source) that name where they came from."""
    return resources.withColumn("meta_source", F.lit(source))


def add_person(entries: Column, person_id: Column, patient_id: Column) -> Column:
    """A bundle's entries (structs of JSON text) with a Person that links the patient."""
    made = F.to_json(F.struct(F.struct(F.lit("Person").alias("resourceType"), person_id.alias("id"), F.array(F.struct(F.struct(F.concat(F.lit("Patient/"), patient_id).alias("reference")).alias("target"))).alias("link")).alias("resource")))
    return F.array_append(entries, made)


def patients_from_seed(rows: DataFrame) -> DataFrame:
    """Bundles of one patient from flat rows (id, first_name, last_name, middle_name, dob, sex, mrn, address, city, state, zip).

    Names are cut at white space, dates like 01Jan1980:00:00:00.000 are read, and nulls stay nulls.
    """
    born = F.date_format(F.coalesce(F.try_to_timestamp(F.initcap(F.substring("dob", 1, 9)), F.lit("ddMMMyyyy")), F.try_to_timestamp("dob", F.lit("yyyy-MM-dd"))), "yyyy-MM-dd")
    given = F.filter(F.split(F.trim(F.concat_ws(" ", "first_name", "middle_name")), r"\s+"), lambda x: x != "")
    patient = F.struct(
        F.lit("Patient").alias("resourceType"), F.col("id").cast("string").alias("id"), born.alias("birthDate"), F.lower("sex").alias("gender"),
        F.array(F.struct(F.trim("last_name").alias("family"), given.alias("given"), F.lit("official").alias("use"))).alias("name"),
        F.array(F.struct(F.array("address").alias("line"), F.col("city").alias("city"), F.col("state").alias("state"), F.col("zip").alias("postalCode"), F.lit("home").alias("use"))).alias("address"),
        F.array(F.struct(F.col("mrn").alias("value"), F.struct(F.array(F.struct(F.lit("MR").alias("code"))).alias("coding")).alias("type"))).alias("identifier"),
    )
    return rows.select(F.col("id").cast("string").alias("bundle_id"), F.parse_json(F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.array(F.struct(F.struct(F.lit("match").alias("mode")).alias("search"), patient.alias("resource"))).alias("entry")))).alias("bundle"))


def address_text(address: Column) -> Column:
    """What a geocoder is asked: street, city, state and postal code, without the missing ones."""
    return F.concat_ws(" ", F.array_join(address["line"], " "), address["city"], address["state"], address["postalCode"])


def geocode(patients: DataFrame, places: DataFrame, key: Column) -> DataFrame:
    """patients joined to a table of geocoded places (address_key, lat, lng, county_fips, state_fips, census_tract, ...), left.

    An online geocoder fills that table; joined like this each address is looked up once, whatever repeats it.
    """
    return patients.withColumn("address_key", F.upper(F.regexp_replace(F.trim(key), r"\s+", " "))).join(places, "address_key", "left")


def in_polygon(lng: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of structs x, y): edges crossed to its right are odd in number."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, nxt, lambda a, b: F.when((a["y"] > lat) != (b["y"] > lat), lng < (b["x"] - a["x"]) * (lat - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def points_by_area(points: DataFrame, areas: DataFrame, cell: float = 1.0) -> DataFrame:
    """points (id, lng, lat) in areas (area, ring): met by grid cells of an area's bounding box, then tested. An equi-join."""
    at = lambda c: F.floor(c / cell).cast("long")
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    cells = areas.withColumn("gx", F.explode(F.sequence(at(F.array_min(xs)), at(F.array_max(xs))))).withColumn("gy", F.explode(F.sequence(at(F.array_min(ys)), at(F.array_max(ys)))))
    placed = points.withColumn("gx", at(F.col("lng"))).withColumn("gy", at(F.col("lat")))
    return placed.join(cells, ["gx", "gy"]).where(in_polygon(F.col("lng"), F.col("lat"), F.col("ring"))).select(*points.columns, "area")
