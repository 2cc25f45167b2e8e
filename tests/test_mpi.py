import pytest

from healthloom.operators import mpi
from healthloom.plans.linkage import BASIC, ENHANCED

OLD = ("old-1", "John", "O'Shepard", "1980-01-01", "male", "MRN-123456", ["12 Main St"], ["Anywhere"], ["CA"], ["90909"])


@pytest.fixture()
def index(spark):
    first = spark.createDataFrame([OLD], mpi.RECORD)
    linked = mpi.link(first, mpi.empty(spark), BASIC)
    assert not linked.first()["matched"]
    return mpi.grown(mpi.empty(spark), mpi.rows_to_insert(linked))


@pytest.mark.parametrize("passes", [BASIC, ENHANCED])
def test_same_person_is_found(spark, index, passes):
    new = [("n1", "Jon", "O'Shepard", "1980-01-01", "male", "X-123456"[-10:], ["12 Main Street"], ["Anywhere"], ["CA"], ["90909"]), ("n2", "Ana", "Lopez", "1990-05-05", "female", "MRN-999999", ["99 Elm"], ["Else"], ["NY"], ["10001"])]
    found = {r["patient_id"]: r for r in mpi.link(spark.createDataFrame(new, mpi.RECORD), index, passes).collect()}
    person = index["person"].first()["person_id"]
    assert found["n1"]["matched"] and found["n1"]["person_id"] == person
    assert not found["n2"]["matched"] and found["n2"]["person_id"] != person


def test_null_key_does_not_constrain(spark, index):
    new = [("n1", "John", "O'Shepard", "1980-01-01", "male", None, ["12 Main St"], ["Anywhere"], ["CA"], ["90909"]), ("n2", "John", "O'Shepard", "1980-01-01", "male", None, [""], [None], [None], [None])]
    found = {r["patient_id"]: r["matched"] for r in mpi.link(spark.createDataFrame(new, mpi.RECORD), index, BASIC[:1]).collect()}
    assert found == {"n1": True, "n2": False}


def test_sequential_linking_sees_earlier_records(spark):
    twins = [("a", "Ana", "Lopez", "1990-05-05", "female", "M-1111", ["99 Elm St"], ["Else"], ["NY"], ["10001"]), ("b", "Ana", "Lopez", "1990-05-05", "female", "M-1111", ["99 Elm St"], ["Else"], ["NY"], ["10001"])]
    records = spark.createDataFrame(twins, mpi.RECORD)
    linked, grown = mpi.link_sequentially(records, mpi.empty(spark), BASIC)
    assert linked.select("person_id").distinct().count() == 1
    assert grown["patient"].count() == 2 and grown["person"].count() == 1
    assert mpi.link(records, mpi.empty(spark), BASIC).select("person_id").distinct().count() == 2


def test_blocks_and_external_persons(spark, index):
    assert mpi.block_patients(index, {"mrn": ("3456", "last4"), "first_name": ("John", None), "zip": ("90909", None)}).count() == 1
    assert mpi.block_patients(index, {"mrn": ("3456", "last4"), "zip": ("0", None)}).count() == 0
    rows = spark.createDataFrame([("p", "e1"), ("p", "e1"), ("p", None)], "person_id string, external_person_id string")
    new = mpi.external_persons(index, rows)
    assert new.count() == 1
    assert mpi.external_persons(mpi.grown(index, {"external_person": new}), rows).count() == 0


def test_stream_links_and_appends(spark, index, tmp_path):
    from healthloom.sources import readers, writers
    from healthloom.streaming.incremental import link_stream

    folder = str(tmp_path / "index")
    writers.append_index({t: d for t, d in index.items()}, folder)
    spark.createDataFrame([("n1", "John", "O'Shepard", "1980-01-01", "male", "MRN-123456", ["12 Main St"], ["Anywhere"], ["CA"], ["90909"])], mpi.RECORD).write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = spark.readStream.schema(mpi.RECORD).parquet(str(tmp_path / "in"))
        link_stream(stream, folder, BASIC, str(tmp_path / f"check{n}")).awaitTermination()
    got = readers.index_tables(spark, folder)
    assert got["patient"].count() == 2 and got["person"].count() == 1


@pytest.mark.parametrize("last", ["person", "patient", "name", "given_name", "identifier"])
def test_a_stream_that_died_between_tables_loses_nothing(spark, index, tmp_path, monkeypatch, last):
    from healthloom.sources import readers, writers
    from healthloom.streaming.incremental import link_stream

    folder, check = str(tmp_path / "index"), str(tmp_path / "check")
    writers.append_index(index, folder)
    rows = [("n1", "John", "O'Shepard", "1980-01-01", "male", "MRN-123456", ["12 Main St"], ["Anywhere"], ["CA"], ["90909"]), ("n2", "Ana", "Lopez", "1990-05-05", "female", "M-1", ["9 Elm", "8 Oak"], ["Else", "B"], ["NY", "C"], ["1", "2"])]
    spark.createDataFrame(rows, mpi.RECORD).write.parquet(str(tmp_path / "in"))
    run = lambda: link_stream(spark.readStream.schema(mpi.RECORD).parquet(str(tmp_path / "in")), folder, BASIC, check).awaitTermination()
    append = writers.append_index

    def dying(tables, to, known=None):
        append({t: d for t, d in tables.items() if list(mpi.TABLES).index(t) <= list(mpi.TABLES).index(last)}, to, known)
        raise RuntimeError("lost")

    monkeypatch.setattr(writers, "append_index", dying)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(writers, "append_index", append)
    run()
    got = readers.index_tables(spark, folder)
    assert {t: got[t].count() for t in ("person", "patient", "name", "given_name", "identifier", "address")} == {"person": 2, "patient": 3, "name": 3, "given_name": 3, "identifier": 3, "address": 4}
