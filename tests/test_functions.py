import pytest
from pyspark.sql import functions as F

from healthloom.functions import hl7, phone, phonetic, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("raw", "options", "want"), [("Test 1", {"case": "lower"}, "test"), ("  jOHN-d'oe3 ", {}, "JOHNDOE"), ("o1abc x", {"case": "title", "remove_numbers": False}, "O1Abc X"), ("mary ann", {"case": "title"}, "Mary Ann")])
def test_names(spark, raw, options, want):
    assert one(spark, text.standardize_name(lit(raw), **options)) == want


@pytest.mark.parametrize(
    ("raw", "fmt", "want"),
    [("1977-11-21", "%Y-%m-%d", "1977-11-21"), ("1977/11/21", "%Y/%m/%d", "1977-11-21"), ("01/1980/31", "%m/%Y/%d", "1980-01-31"), ("11-1977-21", "%m/%Y/%d", "1977-11-21"), ("blah", "%Y-%m-%d", None), ("", "%Y-%m-%d", None), ("1977-13-21", "%Y-%m-%d", None), ("2977-11-21", "%Y-%m-%d", None), ("1980-1-2", "%Y-%m-%d", "1980-1-2")],
)
def test_birth_dates(spark, raw, fmt, want):
    assert one(spark, text.standardize_birth_date(lit(raw), fmt)) == want


@pytest.mark.parametrize(
    ("raw", "countries", "want"),
    [("555-654-9876", (), "+15556549876"), ("123.234.6789", ("US",), "+11232346789"), ("798.612.3456", ("GB",), "+447986123456"), ("555-654-1234", ("IN",), "+915556541234"), ("919876543210", ("IN",), "+919876543210"), ("", (), ""), (" ", (), ""), ("gibberish", (), ""), ("1234567890987654321", (), ""), ("123", (), "")],
)
def test_phones(spark, raw, countries, want):
    assert one(spark, phone.standardize_phone(lit(raw), countries)) == want


def test_countries(spark):
    rows = spark.createDataFrame([(x,) for x in ("US", "USA", "United States of America", "United states ", "zzz", "", "840", None)], "raw string")
    got = {r["raw"]: r["country"] for r in phone.standardize_country(rows, "raw").collect()}
    assert got == {"US": "US", "USA": "US", "United States of America": "US", "United states ": "US", "zzz": None, "": None, "840": "US", None: None}
    assert phone.standardize_country(rows.limit(1), "raw", "alpha_3").first()["country"] == "USA"


@pytest.mark.parametrize(
    ("word", "codes"),
    [("aubrey", "APR|"), ("richard", "RXRT|RKRT"), ("Jose", "HS|"), ("cambrillo", "KMPR|"), ("otto", "AT|"), ("maurice", "MRS|"), ("auto", "AT|"), ("maisey", "MS|"), ("catherine", "K0RN|KTRN"), ("geoff", "JF|KF"), ("Chile", "XL|"), ("steven", "STFN|"), ("zhang", "JNK|"), ("bob", "PP|"), ("ray", "R|"), ("Tux", "TKS|"), ("bryce", "PRS|"), ("Rapelje", "RPL|"), ("solilijs", "SLLS|"), ("Dallas", "TLS|"), ("Schwein", "XN|XFN"), ("dave", "TF|"), ("eric", "ARK|"), ("Parachute", "PRKT|"), ("", "|")],
)
def test_double_metaphone(word, codes):
    assert "|".join(phonetic.double_metaphone(word)) == codes


def test_double_metaphone_families():
    same = phonetic.double_metaphone
    for a, b in (("John", "Jon"), ("John", "Jhon"), ("Michelle", "Michel"), ("Deanardo", "Dinardio"), ("Beaumarchais", "Bumarchay"), ("Sophia", "Sofia"), ("Johnson", "Jhnson")):
        assert same(a) == same(b), (a, b)
    assert same("Michael")[0] == same("Mikael")[0] and same("Michael")[1] != same("Mikael")[1]
    assert same("Wagner")[1] and same("Filipowitz")[1]


@pytest.mark.parametrize(("raw", "want"), [("20200101", "20200101"), ("20200101121212999", "20200101121212"), ("20200101.123456", "20200101.1234"), ("20200101+0500", "20200101+0500"), ("20200101+05", "20200101"), ("20200101-050099x", "20200101-0500"), ("bad", "bad"), ("", "")])
def test_hl7_datetimes(spark, raw, want):
    assert one(spark, hl7.normalize_datetime(lit(raw))) == want


def test_hl7_messages(spark):
    m = "MSH|^~\\&|a|b|c|d|20200101121212999|x\rPID|1||||||20200101121212999^x|\rZZZ|202001011212129999"
    assert one(spark, hl7.standardize_datetimes(lit(m))) == "MSH|^~\\&|a|b|c|d|20200101121212|x\nPID|1||||||20200101121212^x|\nZZZ|202001011212129999"
    assert one(spark, hl7.default_value(lit("MSH|^~\\&|\nPID|1\nPID|2"), "PID", 3, "v")) == "MSH|^~\\&|\nPID|1||v\nPID|2"
    assert one(spark, hl7.default_value(lit("MSH|^~\\&|"), "PID", 3, "v")) == "MSH|^~\\&|"
    batch = "FHS|x\r\nBHS|y\r\nMSH|1\r\n\r\nPID|1\nMSH|2\nPID|2\nBTS|2\nFTS|1"
    assert one(spark, hl7.batch_messages(lit(batch))) == ["MSH|1\rPID|1\r", "MSH|2\rPID|2\r"]
    assert one(spark, hl7.batch_messages(lit(""))) == []
    assert one(spark, hl7.message_structure(lit("MSH|^~\\&|a|b|c|d|t||ADT^A01^ADT_A05|x"))) == "ADT_A05"


def test_hash_and_address(spark):
    import hashlib

    assert one(spark, text.hash_identifier(lit("John-Shepard-2053-11-07"), "salt")) == hashlib.sha256(b"John-Shepard-2053-11-07salt").hexdigest()
    assert one(spark, text.one_line_address(F.array(lit("1 A St"), lit("Apt 2")), lit("C"), lit("NY"), lit("10001"))) == "1 A St Apt 2 C, NY 10001"
    none = F.lit(None).cast("string")
    assert one(spark, text.one_line_address(F.lit(None).cast("array<string>"), none, none, none)) == ""


def test_display_forms(spark):
    assert one(spark, text.display_datetime(lit("2022-12-23T14:05:00-08:00"))) == "12/23/2022 2:05 PM -08:00"
    assert one(spark, text.display_datetime(lit("2022"))) == "2022"
    assert one(spark, text.display_date(lit("20221223"))) == "12/23/2022"
    assert one(spark, text.display_date(lit("nope"))) is None
    assert one(spark, text.display_phone(lit("+1 (248) 555-1234"))) == "248-555-1234"
    assert one(spark, text.slug(lit("Hello, World x"))) == "hello-world-x"
    assert len(one(spark, text.phone_search_forms(lit("248-555-1234")))) == 7
    assert one(spark, text.sanitized_codes(lit("a, b|c,,"))) == ["a", "b|c"]
    assert one(spark, text.vital(lit("70"), lit("[in_i]"))) == "70 in"
    assert one(spark, text.display_name(lit("official"), F.array(), F.array(lit("Ana"), lit("")), lit("Lopez"), F.array())) == "Official: Ana Lopez"
    assert one(spark, text.display_address(F.array(lit("1 A")), lit("C"), lit("NY"), lit("1"), lit(None))) == "1 A\nC, NY 1"
    assert one(spark, text.choice_text(lit(None), lit(5), lit("mg"), lit(None), lit(None))) == "5 mg"
    with pytest.raises(ValueError):
        text.select_value(F.array(), "some")
    assert text.nicknames(["robert:bob,rob", "roberta:bob"]) == {"bob": "roberta", "rob": "robert"}
