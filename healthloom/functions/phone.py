"""Phone numbers and country codes, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Calling code, prefix that is dropped before the national number, and national lengths, by country.
PLANS = {
    "US": ("1", "1", (10,)), "CA": ("1", "1", (10,)), "MX": ("52", "01", (10,)), "GB": ("44", "0", (9, 10)), "IE": ("353", "0", (7, 8, 9)), "IN": ("91", "0", (10,)),
    "FR": ("33", "0", (9,)), "DE": ("49", "0", (7, 8, 9, 10, 11)), "ES": ("34", "", (9,)), "IT": ("39", "", (8, 9, 10, 11)), "PT": ("351", "", (9,)), "NL": ("31", "0", (9,)),
    "BE": ("32", "0", (8, 9)), "CH": ("41", "0", (9,)), "AT": ("43", "0", (7, 8, 9, 10, 11)), "SE": ("46", "0", (7, 8, 9)), "NO": ("47", "", (8,)), "DK": ("45", "", (8,)),
    "PL": ("48", "", (9,)), "BR": ("55", "0", (10, 11)), "AU": ("61", "0", (9,)), "NZ": ("64", "0", (8, 9, 10)), "JP": ("81", "0", (9, 10)), "CN": ("86", "0", (11,)),
    "PH": ("63", "0", (10,)), "ZA": ("27", "0", (9,)), "NG": ("234", "0", (8, 10)), "KE": ("254", "0", (9,)), "IL": ("972", "0", (8, 9)), "TR": ("90", "0", (10,)),
}


def _national(digits: Column, country: str) -> Column:
    """E.164 of digits dialled in a country; null if they can't be one."""
    code, trunk, lengths = PLANS[country]
    fits = lambda d: F.char_length(d).isin(*lengths)
    out = F.when(fits(digits), F.concat(F.lit(f"+{code}"), digits))
    if trunk:
        bare = F.regexp_replace(digits, f"^{trunk}", "")
        out = F.when(F.startswith(digits, F.lit(trunk)) & fits(bare), F.concat(F.lit(f"+{code}"), bare)).otherwise(out)
    whole = F.regexp_replace(digits, f"^{code}", "")
    return F.when(out.isNull() & F.startswith(digits, F.lit(code)) & fits(whole), F.concat(F.lit("+"), digits)).otherwise(out)


def standardize_phone(value: Column, countries: tuple[str, ...] = ()) -> Column:
    """E.164, or empty: as an international number, then as one of each country given, then of the US."""
    if unknown := set(countries) - set(PLANS):
        raise ValueError(f"no numbering plan for {sorted(unknown)}")
    digits = F.regexp_replace(value, "[^0-9]", "")
    known = [F.when(F.startswith(digits, F.lit(code)) & (F.char_length(digits) - len(code)).isin(*lengths), F.concat(F.lit("+"), digits)) for code, _, lengths in PLANS.values()]
    abroad = F.when(F.startswith(F.trim(value), F.lit("+")), F.coalesce(*known))
    clean = F.when(value.rlike(r"^[0-9+(). /-]*(?:(?:x|ext\.?) ?[0-9]+)?$"), F.coalesce(abroad, *[_national(digits, c) for c in dict.fromkeys((*countries, "US"))]))
    return F.when(value.isNotNull(), F.coalesce(clean, F.lit("")))


# Numeric codes and official names of common countries; codes and English names come from the Java locale data.
NUMERIC = {"US": "840", "CA": "124", "MX": "484", "GB": "826", "IE": "372", "IN": "356", "FR": "250", "DE": "276", "ES": "724", "IT": "380", "PT": "620", "NL": "528", "BE": "056", "CH": "756", "AT": "040", "SE": "752", "NO": "578", "DK": "208", "FI": "246", "PL": "616", "BR": "076", "AR": "032", "CL": "152", "CO": "170", "AU": "036", "NZ": "554", "JP": "392", "CN": "156", "KR": "410", "PH": "608", "VN": "704", "ZA": "710", "NG": "566", "KE": "404", "IL": "376", "TR": "792", "RU": "643", "UA": "804"}
OFFICIAL = {"US": "United States of America", "GB": "United Kingdom of Great Britain and Northern Ireland", "FR": "French Republic", "DE": "Federal Republic of Germany", "IN": "Republic of India", "CA": "Canada", "MX": "United Mexican States"}


def country_table(spark: SparkSession) -> DataFrame:
    """alpha_2, alpha_3, numeric, name, official_name of all countries that the JVM knows."""
    locale = spark._jvm.java.util.Locale
    rows = []
    for code in locale.getISOCountries():
        one = locale("", code)
        rows.append((code, one.getISO3Country(), NUMERIC.get(code), one.getDisplayCountry(locale.ENGLISH), OFFICIAL.get(code)))
    return spark.createDataFrame(rows, "alpha_2 string, alpha_3 string, numeric string, name string, official_name string")


def standardize_country(rows: DataFrame, column: str, to: str = "alpha_2", countries: DataFrame | None = None, out: str = "country") -> DataFrame:
    """rows with ``out``: the country of a code of two or three characters, or of a name; null if it is none.

    The country table has a few hundred rows, so it is broadcast.
    """
    if to not in ("alpha_2", "alpha_3", "numeric"):
        raise ValueError(f"a country is told as alpha_2, alpha_3 or numeric, not {to}")
    table = country_table(rows.sparkSession) if countries is None else countries
    forms = table.select(F.col(to).alias(out), F.explode(F.array_distinct(F.array_compact(F.array(*[F.upper(c) for c in ("alpha_2", "alpha_3", "numeric", "name", "official_name")])))).alias("__form")).dropDuplicates(["__form"])
    return rows.withColumn("__form", F.upper(F.trim(column))).join(F.broadcast(forms), "__form", "left").drop("__form")
