import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import functions as F

from healthloom.operators import xml
from healthloom.sources import readers

ECR = """<ClinicalDocument xmlns="urn:hl7-org:v3"><id root="r1" extension="e1"/><code code="55751-2"/><versionNumber value="1"/>
<recordTarget><patientRole><patient><name use="L"><given>Ana</given><family>Lopez</family></name><name use="P"><given></given></name></patient></patientRole></recordTarget>
<component><structuredBody>
<component><section><code code="30954-2"/><text>old</text><entry><observation><templateId root="t1"/><code code="c1" displayName="One" codeSystemName="LOINC"/></observation></entry><entry><observation><code code="c2" displayName="Two"/></observation></entry></section></component>
<component><section><code code="11450-4"/><entry><observation><code code="c3"/></observation></entry></section></component>
<component><section><code code="00000-0"/><text ID="x">free</text></section></component>
</structuredBody></component></ClinicalDocument>"""
NAME = "//hl7:ClinicalDocument/hl7:recordTarget/hl7:patientRole/hl7:patient/hl7:name"
RULES = [
    {"fieldName": "Report", "cdaPath": "//hl7:ClinicalDocument/hl7:id", "errorType": "errors", "attributes": [{"attributeName": "extension"}]},
    {"fieldName": "Kind", "cdaPath": "//hl7:ClinicalDocument/hl7:code", "errorType": "fatal", "attributes": [{"attributeName": "code", "regEx": "^[0-9-]+$"}]},
    {"fieldName": "First Name", "cdaPath": f"{NAME}/hl7:given", "errorType": "fatal", "textRequired": "True", "relatives": [{"name": "name", "cdaPath": NAME, "attributes": [{"attributeName": "use", "regEx": "L"}]}]},
    {"fieldName": "Missing", "cdaPath": "//hl7:ClinicalDocument/hl7:nothing", "errorType": "warnings"},
]
SECTIONS = {"30954-2": {"t1"}, "11450-4": {"t9"}}


def test_validation(spark):
    rows = spark.createDataFrame([(ECR,), ("<broken",), (None,), (ECR.replace('code="55751-2"', 'code="x"'),)], "x string")
    good, broken, null, kind = (r["v"] for r in rows.select(xml.validate(F.col("x"), RULES).alias("v")).collect())
    assert good["message_valid"] and good["errors"] == [] and len(good["warnings"]) == 1 and good["message_ids"]["eicr"]["extension"] == "e1"
    assert good["information"] and not broken["message_valid"] and not null["message_valid"]
    assert broken["fatal"] and not kind["message_valid"] and not kind["information"]
    n = {r["severity"]: r["n"] for r in xml.roll_up(rows.select(xml.validate(F.col("x"), RULES).alias("result"))).collect()}
    assert n == {"fatal": 3, "warnings": 2, "information": 1}
    assert xml.validate_one(ECR, RULES, ("errors",))["warnings"] == []


def test_refinement():
    out = xml.refine_one(ECR, SECTIONS)
    assert "c1" in out and "c2" not in out and 'nullFlavor="NI"' in out and "00000-0" not in out
    assert "c2" in xml.refine_one(ECR, SECTIONS, services={"c2"})
    kept = xml.refine_one(ECR, SECTIONS, include=["30954-2"])
    assert "c2" in kept and "old" in kept
    both = xml.refine_one(ECR, SECTIONS, include=["11450-4"], services={"c2", "c3"})
    assert "c3" in both and 'code="c2"' not in both
    assert xml.refine_one("nope", SECTIONS) is None


RESPONSE = f"""<ClinicalDocument xmlns="urn:hl7-org:v3"><templateId root="t0"/><templateId root="t00"/><id root="rr"/><code code="88085-6"/><title>Response</title><effectiveTime value="2024"/><confidentialityCode code="N"/>
<component><structuredBody><component><section><templateId root="{xml.STATUS_SECTION}"/><title>Nested</title><id root="nested"/><entry><act><templateId root="{xml.STATUS_ACT}"/><code code="s1"/></act></entry><entry><act><templateId root="other"/></act></entry></section></component>
<component><section><entry typeCode="DRIV"><organizer classCode="CLUSTER" moodCode="EVN"><id root="one"/></organizer></entry><entry typeCode="DRIV"><organizer classCode="CLUSTER" moodCode="EVN"><id root="two"/></organizer></entry><entry typeCode="DRIV"><act/></entry></section></component></structuredBody></component></ClinicalDocument>"""


def test_merge():
    merged = xml.merge_response_one(RESPONSE, ECR)
    root = xml.document(merged).root
    section = root[-1]
    names = [xml.local(e.tag) for e in section]
    assert xml.local(section.tag) == "section" and names == ["templateId", "id", "code", "title", "effectiveTime", "confidentialityCode", "entry", "entry"]
    assert [section[0].get("root"), section[1].get("root"), section[3].text, section[4].get("value")] == ["t0", "rr", "Response", "2024"]
    assert 's1' in merged and 'root="two"' in merged and 'root="one"' not in merged and "Nested" not in merged
    assert len(root) == len(xml.document(ECR).root) + 1
    assert xml.merge_response_one(RESPONSE, merged) == merged
    assert xml.message_ids(xml.document(merged))["rr"]["root"] == "rr"
    # Without a decisive entry, or without XML, the report stays.
    for rr in (RESPONSE.replace("DRIV", "X"), "<a", None, ""):
        assert xml.merge_response_one(rr, ECR) == ECR
    assert xml.merge_response_one(RESPONSE, "<a") == "<a" and xml.merge_response_one(RESPONSE, None) is None
    bare = RESPONSE.replace("<title>Response</title>", "").replace(xml.STATUS_ACT, "no")
    assert [xml.local(e.tag) for e in xml.document(xml.merge_response_one(bare, ECR)).root[-1]] == ["templateId", "id", "code", "effectiveTime", "confidentialityCode", "entry"]


def test_references():
    out = xml.resolve_references_one('<a><text ID="x">free</text><code><reference value="#x"/></code><code><reference value="#y"/></code></a>')
    assert out == '<a><text ID="x">free</text><code>free</code><code><reference value="#y" /></code></a>'


def test_broken_messages_are_validated():
    for broken in (ECR.replace("</versionNumber>", "").replace("</patient>", ""), ECR.replace("<family>", "<family>A & B < C "), ECR.replace("</ClinicalDocument>", ""), ECR + "<more>", ECR.replace('root="r1"', 'root="r1" root="r2"')):
        got = xml.validate_one(broken, RULES)
        assert got["message_valid"] and got["message_ids"]["eicr"] == {"root": "r1", "extension": "e1"}, broken
    assert not xml.validate_one("no markup", RULES)["message_valid"]
    assert xml.mended("<a x='1' x='2'><b>1 < 2 & 3 &amp; 4</c><d/></a> tail") == "<a x='1'><b>1 &lt; 2 &amp; 3 &amp; 4<d/></b></a>"
    assert xml.refine_one(ECR.replace("</patient>", ""), SECTIONS) is None


def test_settings_and_zip(spark, tmp_path):
    rows = spark.createDataFrame([(ECR,), ("MSH|^~\\&|a|b|c|d|t||ORU^R01|x",)], "x string")
    got = [tuple(r["s"]) for r in rows.select(xml.conversion_settings(F.col("x")).alias("s")).collect()]
    assert got == [("ccda", "EICR"), ("hl7v2", "ORU_R01")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/CDA_eICR.xml", ECR)
    r = readers.case_zips(spark, str(tmp_path / "a.zip")).first()
    assert r["ecr"] == ECR and r["rr"] is None
    table = spark.createDataFrame([(ECR,)], "x string").select(F.explode(xml.observation_table(F.col("x"), {"t1"})).alias("o")).select("o.*").collect()
    assert [(o["section"], o["code"], o["is_trigger"]) for o in table] == [("30954-2", "c1", True), ("30954-2", "c2", False), ("11450-4", "c3", False)]


def test_written_is_what_the_library_writes():
    odd = '<a xmlns="urn:hl7-org:v3" xmlns:s="urn:hl7-org:sdtc" xmlns:q="urn:q" s:x="1" q:y="&quot;&#10;&#9;&#13;&lt;&gt;&amp;"><s:b q:z="é"/>t&amp;&lt;u<q:c xml:lang="de"> &gt; </q:c>tail<b xmlns="urn:z"/><c xmlns="">x</c></a>'
    for text in ("<a/>", "<a>&lt;</a>", ECR, odd):
        root = ET.fromstring(text)
        assert xml.written(root) == ET.tostring(root, encoding="unicode")


def test_reports_are_dealt_to_all_cores(spark, sf_dir):
    """One small file of orders is one part of a scan; refining takes long beside reading it."""
    from healthloom import catalog

    found = catalog.queries()["report_refinement"](spark, sf_dir)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > catalog.table(spark, sf_dir, "orders").rdd.getNumPartitions()


def test_merging_joins_keys_and_not_documents(spark, sf_dir):
    from healthloom import catalog

    plan = catalog.queries()["report_merge"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ClinicalDocument" in plan and "ClinicalDocument" not in plan[plan.index("Join") :]


def test_one_act_may_be_status_and_decision():
    """An entry that is both stands in the case report twice, as copies did."""
    response = f'<ClinicalDocument xmlns="{xml.HL7}"><id root="x"/><component><structuredBody><component><section><templateId root="{xml.STATUS_SECTION}"/><entry typeCode="DRIV"><act><templateId root="{xml.STATUS_ACT}"/></act><organizer classCode="CLUSTER" moodCode="EVN"/></entry></section></component></structuredBody></component></ClinicalDocument>'
    merged = ET.fromstring(xml.merge_response_one(response, ECR))
    entries = merged.findall(f"{{{xml.HL7}}}section/{{{xml.HL7}}}entry")
    assert len(entries) == 2 and len({ET.tostring(e) for e in entries}) == 1
