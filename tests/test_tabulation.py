import json

import pytest
from pyspark.sql import functions as F

from healthloom.functions import fhirpath
from healthloom.operators import parsing, patients, tabulation, valuesets, viewer
from healthloom.plans import steps, tables
from healthloom.sources import readers, writers

BUNDLE = {
    "resourceType": "Bundle",
    "entry": [
        {"search": {"mode": "match"}, "resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1980-01-01", "name": [{"family": "Lopez", "given": ["Ana", "B"], "use": "official"}, {"family": "L", "given": ["A"], "use": "nickname"}], "address": [{"line": ["1 A St", "Apt 2"], "city": "C", "state": "NY", "postalCode": "10001", "use": "home"}], "generalPractitioner": [{"reference": "Practitioner/d1"}], "identifier": [{"value": "m1", "type": {"coding": [{"code": "MR"}]}}, {"value": "s1", "type": {"coding": [{"code": "SS"}]}}], "active": True}},
        {"search": {"mode": "match"}, "resource": {"resourceType": "Patient", "id": "p2", "name": [{"family": "Smith"}]}},
        {"search": {"mode": "include"}, "resource": {"resourceType": "Practitioner", "id": "d1", "name": [{"family": "Old"}]}},
        {"search": {"mode": "include"}, "resource": {"resourceType": "Practitioner", "id": "d1", "name": [{"family": "Doc"}]}},
        {"search": {"mode": "include"}, "resource": {"resourceType": "Observation", "id": "o2", "subject": {"reference": "Patient/p1"}, "code": {"coding": [{"code": "A-1"}]}, "valueInteger": 2}},
        {"search": {"mode": "include"}, "resource": {"resourceType": "Observation", "id": "o1", "subject": {"reference": "Patient/p1"}, "code": {"coding": [{"code": "B"}]}, "valueInteger": 1}},
        {"search": {"mode": "include"}, "resource": {"resourceType": "Observation", "id": "o3"}},
    ],
}
SCHEMA = {
    "metadata": {"results_per_page": 1000},
    "tables": {
        "Patients": {
            "resource_type": "Patient",
            "columns": {
                "id": {"fhir_path": "Patient.id", "selection_criteria": "first"},
                "last": {"fhir_path": "Patient.name.family", "selection_criteria": "last", "invalid_values": ["Smith", None]},
                "born": {"fhir_path": "Patient.birthDate"},
                "doctor": {"fhir_path": "Practitioner.name.family", "reference_location": "forward:Practitioner:generalPractitioner"},
                "codes": {"fhir_path": "Observation.code.coding.code", "reference_location": "reverse:Observation:subject"},
            },
        }
    },
}


@pytest.fixture(scope="module")
def bundle(spark):
    return spark.createDataFrame([("b1", json.dumps(BUNDLE))], "bundle_id string, text string").select("bundle_id", F.parse_json("text").alias("bundle"))


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("Patient.name.given", ["Ana", "B", "A"]),
        ("Patient.name.where(use='official').given.first()", ["Ana"]),
        ("Patient.name.where(use = 'official' and family = 'Lopez').given.join(' ')", ["Ana B"]),
        ("Patient.name[1].family", ["L"]),
        ("Patient.identifier.where(type.coding.code='MR').value", ["m1"]),
        ("Patient.name.given.last()", ["A"]),
        ("Patient.name.use.distinct()", ["official", "nickname"]),
        ("Patient.name.select(family)", ["Lopez", "L"]),
        ("Patient.name.where(use='x').exists()", ["false"]),
        ("iif(Patient.active.exists(), Patient.id, Patient.birthDate)", ["p1"]),
        ("Patient.active.ofType(boolean)", ["true"]),
        ("Patient.name.all(use.exists())", ["true"]),
        ("Patient.name.where(use != 'official').family", ["L"]),
        ("Patient.nothing.here", []),
        ("Patient.name.count()", ["2"]),
    ],
)
def test_paths(spark, path, want):
    patient = spark.createDataFrame([(json.dumps(BUNDLE["entry"][0]["resource"]),)], "t string").select(F.parse_json("t").alias("r"))
    assert patient.select(fhirpath.texts(F.col("r"), path).alias("x")).first()["x"] == want


def test_bad_path():
    with pytest.raises(ValueError):
        fhirpath.parsed("Patient..name(")


def test_tables(spark, bundle):
    table = tables.checked(SCHEMA)["Patients"]
    rows = tabulation.tabulate(tabulation.explode_bundles(bundle), table)
    assert {tuple(r) for r in tabulation.flat(rows).collect()} == {("p1", "L", "1980-01-01", "Doc", "A-1,B"), ("p2", "Smith", None, None, None)}
    assert [r["id"] for r in tabulation.drop_invalid(rows, table).collect()] == ["p1"]
    whole = tabulation.tabulate(tabulation.explode_bundles(bundle), table, whole_reference=True)
    assert whole.where("doctor IS NOT NULL").count() == 0


def test_searches_and_schema_errors():
    url = tables.search_urls(tables.checked(SCHEMA))["Patients"]
    assert url == "Patient?_include=Patient:general-practitioner&_revinclude=Observation:subject&_count=1000"
    for bad in ({}, {"tables": {"a": {"columns": {}}}}, {"tables": {"a": {"resource_type": "X", "columns": {"c": {}}}}}, {"tables": {"a": {"resource_type": "X", "columns": {"c": {"fhir_path": "x", "selection_criteria": "some"}}}}}):
        with pytest.raises(ValueError):
            tables.checked(bad)


def test_sinks(spark, bundle, tmp_path):
    table = tables.checked(SCHEMA)["Patients"]
    rows = tabulation.tabulate(tabulation.explode_bundles(bundle), table)
    for kind in ("csv", "parquet"):
        for _ in range(2):
            writers.write_table(rows, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("id = 'p2' AND doctor IS NULL").count() == 2
    with pytest.raises(ValueError):
        writers.write_table(rows, "x", "xlsx")
    many = spark.range(1000).select(F.lit("b").alias("bundle_id"), F.col("id").alias("pos"), F.lit("Patient").alias("resource_type"), F.col("id").cast("string").alias("id"), F.parse_json(F.lit("{}")).alias("resource"))
    assert sorted(len(json.loads(r["bundle"])["entry"]) for r in writers.batches(many).collect()) == [500, 500]


def test_search_source(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            more = "page2" not in self.path
            body = {"entry": BUNDLE["entry"][: 2 if more else 1], "link": [{"relation": "next", "url": f"http://127.0.0.1:{self.server.server_port}/page2"}] if more else []}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    rows = readers.fhir_search(spark, f"http://127.0.0.1:{server.server_port}", ["Patient?_count=2"])
    assert [(r["id"], r["pos"]) for r in rows.orderBy("pos").collect()] == [("p1", 0), ("p2", 1), ("p1", 2)]
    server.shutdown()


def test_export():
    answers = iter([(202, {"Content-Location": "u"}, b""), (202, {}, b""), (200, {}, json.dumps({"output": [{"type": "Patient", "url": "f"}]}).encode())])
    assert readers.export("http://s", lambda u: next(answers), lambda s: None, scope="Patient") == [("Patient", "f")]
    assert readers.export_url("http://s/", "Group/1", since="x") == "http://s/Group/1/$export?_since=x"
    with pytest.raises(ValueError):
        readers.export_url("http://s", "Thing")


def test_parser(spark, bundle):
    spec = {
        "first": {"fhir_path": "Bundle.entry.resource.where(resourceType = 'Patient').name.given"},
        "tests": {"fhir_path": "Bundle.entry.resource.where(resourceType = 'Observation')", "secondary_schema": {"code": {"fhir_path": "Observation.code.coding.code"}, "of": {"fhir_path": "Bundle.entry.resource.where(resourceType = 'Patient' and id = '#REF#').birthDate", "reference_lookup": "Observation.subject.reference"}}},
        "none": {"fhir_path": "Bundle.entry.resource.nothing"},
    }
    fields = parsing.schema_of(spec)
    row = parsing.parse(bundle, fields).first()
    assert row["first"] == "Ana,B,A" and row["none"] is None
    assert [(t["code"], t["of"]) for t in row["tests"]] == [("A-1", "1980-01-01"), ("B", "1980-01-01"), (None, None)]
    told = parsing.with_metadata(parsing.parse(bundle, fields), fields).first()
    assert told["first"]["resource_type"] == "Patient"
    with pytest.raises(ValueError):
        parsing.schema_of({"x": {"fhir_path": "Bundle.entry.where(id = '#REF#')"}})


def test_stamping(spark, bundle):
    listed = spark.createDataFrame([("c1", "lotc", "A1"), ("c2", "lotc", "B"), ("c3", "nope", "B")], "condition_id string, type string, code string")
    rows = {r["id"]: r["conditions"] for r in valuesets.stamp_resources(tabulation.explode_bundles(bundle).where("resource_type = 'Observation'"), listed).collect()}
    assert rows == {"o2": ["c1"], "o1": ["c2"], "o3": []}


def test_release_tables(spark):
    release = spark.createDataFrame([("v1", "1", "n", "a", "dxtc", 0, [("C1", "s", "Cond")], [("A-1", "x", "d")])], "value_set string, version string, name string, author string, type string, pos int, conditions array<struct<code:string,system:string,name:string>>, concepts array<struct<code:string,system:string,display:string>>")
    t = valuesets.release_tables(release, "3")
    assert t["valuesets"].first()["id"] == "v1_1" and t["concepts"].first()["gem_formatted_code"] == "A1"
    icd = valuesets.crosswalk(spark.createDataFrame([("A1  9.1 10000",), ("",)], "value string"))
    got = valuesets.concepts_for(t["conditions"], t["condition_to_valueset"], t["valuesets"], t["valueset_to_concept"], t["concepts"], icd)
    assert {(r["codes"], r["system"]) for r in valuesets.with_crosswalk_rows(got).collect()} == {("A-1", "x"), ("9.1", valuesets.ICD9_SYSTEM)}


def test_patients(spark, bundle):
    kind = "struct<name:array<struct<family:string,given:array<string>,use:string>>,telecom:array<struct<system:string,value:string>>,address:array<struct<line:array<string>,city:string,state:string,postalCode:string,country:string,use:string>>,birthDate:string,identifier:array<struct<value:string,system:string,use:string>>>"
    row = ({"name": [{"family": "o'neil ", "given": ["ana 1"], "use": None}], "telecom": [{"system": "phone", "value": "555-654-9876"}, {"system": "email", "value": "a@b"}], "address": [{"line": ["1 A"], "city": "C", "state": "NY", "postalCode": "1", "country": "US", "use": "home"}], "birthDate": "1980-01-01", "identifier": []},)
    p = spark.createDataFrame([row], f"patient {kind}").select(patients.harmonised(F.col("patient")).alias("p"))
    got = p.first()["p"]
    assert (got["name"][0]["family"], got["name"][0]["given"]) == ("ONEIL", ["ANA"])
    assert [t["value"] for t in got["telecom"]] == ["+15556549876", "a@b"]
    import hashlib

    assert p.select(patients.linking_identifier(F.col("p"), "s").alias("x")).first()["x"] == hashlib.sha256(b"ANA-ONEIL-1980-01-01-1 A C, NY 1s").hexdigest()


def test_steps(spark):
    rows = spark.range(4)
    done = steps.run(rows, [steps.Step("even", lambda d: d.withColumn("even", F.col("id") % 2 == 0), F.col("even")), steps.Step("twice", lambda d: d.withColumn("id", F.col("id") * 2))], ("twice",))
    assert [r["id"] for r in done.outputs["twice"].orderBy("id").collect()] == [0, 4]
    assert done.rejected["even"].count() == 2
    with pytest.raises(ValueError):
        steps.run(rows, [], ("none",))


def test_relevant_labs(spark):
    reports = spark.createDataFrame([("r1", ["c"], ["o1"]), ("r2", [], ["o1", "o2"]), ("r3", [], ["o9"])], "id string, conditions array<string>, results array<string>")
    obs = spark.createDataFrame([("o1", ["c"]), ("o2", [])], "id string, conditions array<string>")
    assert sorted(r["id"] for r in viewer.relevant_labs(reports, obs, "c").collect()) == ["r1", "r2"]


def test_tabulation_stream(spark, tmp_path):
    from healthloom.streaming.incremental import tabulate_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(BUNDLE))
    tabulate_stream(spark, str(tmp_path / "in"), tables.checked(SCHEMA)["Patients"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["p1"]


def test_generate_tables(spark, tmp_path):
    from healthloom.plans.tables import ColumnSpec, TableSpec
    from healthloom.sources import writers

    rows = spark.createDataFrame([("a", 1.5, True, "x"), ("b", None, False, "bad")], "id string, weight double, living boolean, kind string")
    resources = tabulation.resources_of(rows, "Patient", F.col("id"))
    schema = {
        "people": TableSpec("people", "Patient", (ColumnSpec("id", "Patient.id"), ColumnSpec("weight", "Patient.weight", data_type="number"), ColumnSpec("living", "Patient.living", data_type="boolean"))),
        "kinds": TableSpec("kinds", "Patient", (ColumnSpec("kind", "Patient.kind", invalid_values=("bad",)),)),
    }
    with pytest.raises(ValueError):
        writers.generate_tables(resources, schema, {"people": {"path": "x", "kind": "csv"}})
    got = writers.generate_tables(resources, schema, {"people": {"path": str(tmp_path / "p"), "kind": "parquet"}, "kinds": {"path": str(tmp_path / "k"), "kind": "csv"}})
    assert got == {"people": ["id", "weight", "living"], "kinds": ["kind"]}
    people = spark.read.parquet(str(tmp_path / "p"))
    assert dict(people.dtypes) == {"id": "string", "weight": "float", "living": "boolean"} and sorted(map(tuple, people.collect())) == [("a", 1.5, True), ("b", None, False)]
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "k")).collect()] == [("x",)]


def test_chunks_and_same_organization(spark):
    from healthloom.operators import viewer

    rows = spark.createDataFrame([(i, None if i % 50 == 0 else f"v{i * 7919 % 1000:04}") for i in range(1000)], "id int, v string")
    got = viewer.chunks(rows, "v", 30, 5).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1000)) and all(r["chunk"] == r["place"] // 30 for r in got)
    assert [r["v"] or "" for r in got] == sorted(r["v"] or "" for r in got) and viewer.chunks(rows.limit(0), "v").count() == 0
    places = [(1, 1, "t1", "a"), (2, 2, "t2", "a"), (3, 3, "t3", "a"), (4, 4, "t4", None), (5, 5, "t5", None), (6, 6, "t6", "b"), (2, 9, "t9", "a")]
    none = [F.lit(None).cast("string").alias(c) for c in ("city", "state", "postal_code", "country")]
    found = viewer.same_organization(spark.createDataFrame(places, "id int, pos int, telecom string, line string").select("*", *none))
    assert {tuple(r) for r in found.collect()} == {(1, "t9"), (2, "t3"), (3, "t9"), (4, "t5"), (5, "t4")}


def test_places_of_answers(spark):
    import json

    from healthloom.operators import geocode

    candidate = {"delivery_line_1": "1 Elm", "delivery_line_2": "Apt 2", "components": {"city_name": "C", "state_abbreviation": "S", "zipcode": "Z"}, "metadata": {"latitude": 1.5, "longitude": -2.5, "county_fips": "7", "county_name": "K", "precision": "Zip9"}}
    answers = [json.dumps([candidate]), "[]", "nothing", None, json.dumps([{**candidate, "metadata": {}}])]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string").select("i", geocode.street_place(F.col("a")).alias("p"), geocode.census_place(F.col("a")).alias("c"))
    got = {r["i"]: r for r in rows.select("i", "p", "c", geocode.geolocation(F.col("p")).alias("g")).collect()}
    assert got[0]["p"]["line"] == ["1 Elm", "Apt 2"] and (got[0]["p"]["lat"], got[0]["p"]["lng"], got[0]["p"]["city"]) == (1.5, -2.5, "C")
    assert [(e["url"], e["valueDecimal"]) for e in got[0]["g"]["extension"]] == [("latitude", 1.5), ("longitude", -2.5)]
    assert all(got[i]["p"] is None and got[i]["g"] is None for i in range(1, 5)) and all(r["c"] is None for r in got.values())
    one = spark.range(1).select(geocode.census_url(F.lit("1 Elm St, 2")).alias("u"), geocode.census_url(F.lit("")).alias("n"), geocode.tract_lines(F.array(F.lit("a"), F.lit("b")), F.lit("t")).alias("l")).first()
    assert "onelineaddress?address=1+Elm+St%2C+2&" in one["u"] and one["n"] is None and len(one["l"]) == 2
