"""Searches of a FHIR server for a person and their care: requests as columns, and which answers go on.

A patient is searched by what is known; only a request that finds exactly one patient is asked further. The encounters of the
patient's first condition are asked in a second round, after the conditions have come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phone_search_forms


def patient_search(first_name: Column, last_name: Column, dob: Column, mrn: Column, phone: Column) -> Column:
    """The request for a patient; parts that are null or empty aren't asked. Several phone numbers are separated by semicolons."""
    given = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}="), c, F.lit("&"))).otherwise("")
    phones = F.array_join(F.flatten(F.transform(F.split(F.coalesce(phone, F.lit("")), ";"), phone_search_forms)), ",")
    return F.concat(F.lit("Patient?"), given("given", first_name), given("family", last_name), given("birthdate", dob), given("identifier", mrn), given("phone", phones))


def only_patients(found: DataFrame, request: str = "request_id") -> DataFrame:
    """request, patient_id of the requests that found exactly one patient."""
    return found.groupBy(request).agg(F.count("*").alias("n"), F.min("patient_id").alias("patient_id")).where("n = 1").select(request, "patient_id")


def encounter_searches(patients: DataFrame, conditions: DataFrame, request: str = "request_id") -> DataFrame:
    """request and the search for the encounters of its patient's first condition; conditions has request, pos and condition_id."""
    first = conditions.withColumn("n", F.row_number().over(Window.partitionBy(request).orderBy("pos"))).where("n = 1")
    search = F.concat(F.lit("/Encounter?subject="), F.col("patient_id"), F.lit("&reason-reference="), F.col("condition_id"))
    return patients.join(first, request).select(request, search.alias("search"))
