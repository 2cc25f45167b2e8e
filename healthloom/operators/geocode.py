"""Geocoding by service: the requests that a service is asked, its answers as columns, and the extensions that they become.

A caller fetches the answers (see sources) once for each distinct address; everything here is native. An answer that can't be
read, or holds no match, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The census service's address and settings, and the addresses of the extensions.
CENSUS = "https://geocoding.geo.census.gov/geocoder/geographies/"
CENSUS_SETTINGS = "&benchmark=Public_AR_Census2020&vintage=Census2020_Census2020&layers=[10]&format=json"
GEOLOCATION = "http://hl7.org/fhir/StructureDefinition/geolocation"
CENSUS_TRACT = "http://hl7.org/fhir/StructureDefinition/iso21090-ADXP-censusTract"

PLACE = (
    "line array<string>, city string, state string, postal_code string, county_fips string, county_name string, lat double, lng double, "
    "precision string, geoid string, census_tract string, census_block string"
)


def _asked(part: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(part, F.lit("")), " ", "+"), ",", "%2C")


def census_url(street: Column, city: Column | None = None, state: Column | None = None, postal_code: Column | None = None) -> Column:
    """The census request for an address in parts; a street alone is asked as one line. Null without a street."""
    named = {"city": city, "state": state, "zip": postal_code}
    rest = F.concat(F.lit(""), *[F.when(_asked(c) != "", F.concat(F.lit(f"&{k}="), _asked(c))).otherwise("") for k, c in named.items() if c is not None])
    path = F.when(rest == "", F.concat(F.lit("onelineaddress?address="), _asked(street))).otherwise(F.concat(F.lit("address?street="), _asked(street), rest))
    return F.when(_asked(street) != "", F.concat(F.lit(CENSUS), path, F.lit(CENSUS_SETTINGS)))


def census_place(answer: Column) -> Column:
    """PLACE of the first match of a census answer (JSON text, with or without its outer result)."""
    whole = F.try_parse_json(answer)
    get = lambda path, kind="string": F.coalesce(*[F.try_variant_get(whole, f"$.{outer}addressMatches[0].{path}", kind) for outer in ("result.", "")])
    text = lambda path: F.coalesce(get(path), F.lit(""))
    block, tract, county = "geographies['Census Blocks'][0]", "geographies['Census Tracts'][0]", "geographies['Counties'][0]"
    line = F.array(F.trim(F.substring_index(get("matchedAddress"), ",", 1)))
    parts = {
        "line": line, "city": text("addressComponents.city"), "state": text("addressComponents.state"), "postal_code": text("addressComponents.zip"),
        "county_fips": F.concat(text(f"{block}.STATE"), text(f"{block}.COUNTY")), "county_name": text(f"{county}.BASENAME"),
        "lat": get("coordinates.y", "double"), "lng": get("coordinates.x", "double"), "precision": F.lit(None).cast("string"),
        "geoid": text(f"{block}.GEOID"), "census_tract": text(f"{tract}.BASENAME"), "census_block": text(f"{block}.BASENAME"),
    }
    return F.when(get("matchedAddress").isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))


def street_place(answer: Column) -> Column:
    """PLACE of the first candidate of a street-address service's answer (a JSON array of candidates); null without a latitude."""
    whole = F.try_parse_json(answer)
    get = lambda path, kind="string": F.try_variant_get(whole, f"$[0].{path}", kind)
    none = F.lit(None).cast("string")
    second = F.nullif(get("delivery_line_2"), F.lit(""))
    line = F.filter(F.array(get("delivery_line_1"), second), lambda x: x.isNotNull())
    parts = {
        "line": line, "city": get("components.city_name"), "state": get("components.state_abbreviation"), "postal_code": get("components.zipcode"),
        "county_fips": get("metadata.county_fips"), "county_name": get("metadata.county_name"), "lat": get("metadata.latitude", "double"),
        "lng": get("metadata.longitude", "double"), "precision": get("metadata.precision"), "geoid": none, "census_tract": none, "census_block": none,
    }
    return F.when(F.coalesce(get("metadata.latitude", "double"), F.lit(0.0)) != 0, F.struct(*[c.alias(n) for n, c in parts.items()]))


def geolocation(place: Column) -> Column:
    """The extension that holds a place's latitude and longitude; null without them."""
    part = lambda name, c: F.struct(F.lit(name).alias("url"), c.alias("valueDecimal"))
    made = F.struct(F.lit(GEOLOCATION).alias("url"), F.array(part("latitude", place["lat"]), part("longitude", place["lng"])).alias("extension"))
    return F.when(place["lat"].isNotNull() & place["lng"].isNotNull(), made)


def tract_lines(line: Column, tract: Column) -> Column:
    """The extension of the census tract for each line of an address, in their order; null without a tract."""
    one = F.struct(F.array(F.struct(F.lit(CENSUS_TRACT).alias("url"), tract.alias("valueString"))).alias("extension"))
    return F.when(F.coalesce(tract, F.lit("")) != "", F.transform(line, lambda _: one))


def placed(address: Column, place: Column) -> Column:
    """An address (line, city, state, postalCode) with what a place tells in its stead, its extension and _line; null place: as it was."""
    kept = lambda new, old: F.when(place.isNotNull(), new).otherwise(old)
    return F.struct(
        kept(place["line"], address["line"]).alias("line"), kept(place["city"], address["city"]).alias("city"), kept(place["state"], address["state"]).alias("state"), kept(place["postal_code"], address["postalCode"]).alias("postalCode"),
        F.filter(F.array(geolocation(place)), lambda x: x.isNotNull()).alias("extension"), tract_lines(place["line"], place["census_tract"]).alias("_line"),
    )
