"""Upload cases (S4) and the generator."""

import os
import tempfile

from cohortlens import catalog
import pytest

from cohortlens.sources.ingest import ingest, read_manifest, resolve_dataset, synthetic_profile
from cohortlens.sources.tables import probe_path

HEADER = "CUST_ID,TENURE,PURCHASES,PURCHASES_TRX,CASH_ADVANCE,INSTALLMENTS_PURCHASES,ONEOFF_PURCHASES,BALANCE,CREDIT_LIMIT,PAYMENTS,MINIMUM_PAYMENTS,PRC_FULL_PAYMENT,CASH_ADVANCE_TRX"


def _write(folder, name, data: bytes):
    p = os.path.join(folder, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_upload_cases(spark):
    d = tempfile.mkdtemp(prefix="cohortlens-ingest-")
    root = os.path.join(d, "datasets")
    valid = _write(d, "valid.csv", (HEADER + "\nC10001,12,100,2,0,50,50,1000,5000,100,50,0.1,0\nC10002,12,200,4,0,100,100,2000,5000,200,100,0.2,0\n").encode())
    r = ingest(spark, valid, root)
    assert r.ok and r.row_count == 2 and r.preview.count() == 2 and os.path.isdir(os.path.join(root, r.dataset_id, "features"))
    assert ingest(spark, _write(d, "empty.csv", b"CUST_ID,BALANCE,PURCHASES\n"), root).status == 400
    assert ingest(spark, _write(d, "text.csv", b"CUST_ID,NAME,CATEGORY\nC1,a,b\nC2,c,d\n"), root).status == 400
    assert ingest(spark, _write(d, "bin.csv", bytes([0, 1, 2, 3, 255, 255])), root).status == 400
    bad = ingest(spark, _write(d, "missing.csv", b"CUST_ID,BALANCE,PURCHASES\nC1,1,2\n"), root)
    assert bad.status == 422 and not os.path.exists(os.path.join(root, bad.dataset_id))
    assert os.listdir(os.path.join(root, "_staging")) == []
    assert resolve_dataset(spark, root, r.dataset_id).endswith(r.dataset_id)
    with pytest.raises(KeyError):
        resolve_dataset(spark, root, bad.dataset_id)


ROW = "C{i},12,{p},2,0,50,50,1000,5000,100,50,0.1,0"


def test_malformed_rows_are_quarantined(spark, tmp_path):
    """Two broken records, a missing id and a text for a number: the others are ingested, nothing is lost."""

    rows = [ROW.format(i=10000 + i, p=i) for i in range(60)]
    rows[10] += ",one,field,more"
    rows[20] = "C10020,12,5"
    rows[30] = rows[30].replace("C10030", " ")
    rows[40] = rows[40].replace(",12,", ",twelve,")
    rows[50] = rows[50].replace(",0.1,", ",NA,")
    src = _write(str(tmp_path), "some.csv", "\n".join([HEADER, *rows, ""]).encode())
    r = ingest(spark, src, str(tmp_path / "datasets"))
    assert (r.ok, r.status, r.flagged, r.row_count, r.quarantined_count) == (True, 200, True, 56, 4)
    assert r.reasons == {"field_count": 2, "missing_id": 1, "not_a_number:TENURE": 1}
    kept = spark.read.parquet(f"{r.path}/raw")
    held = {x["record"]: x["reasons"] for x in spark.read.parquet(f"{r.path}/quarantine").collect()}
    assert kept.count() + len(held) == 60 and spark.read.parquet(f"{r.path}/features").count() == 56
    assert held[rows[10]] == held[rows[20]] == ["field_count"]
    assert dict(kept.dtypes)["PURCHASES"] == "double" and dict(kept.dtypes)["TENURE"] == "bigint"
    assert kept.where("CUST_ID = 'C10050'").first()["PRC_FULL_PAYMENT"] is None
    assert [x["CUST_ID"] for x in r.preview.collect()] == [f"C{10000 + i}" for i in range(5)]
    manifest = read_manifest(spark, r.path)
    assert (manifest["rows_read"], manifest["row_count"], manifest["quarantined_count"]) == (60, 56, 4)


def test_many_malformed_rows_reject_the_file(spark, tmp_path):
    src = _write(str(tmp_path), "bad.csv", "\n".join([HEADER, *[ROW.format(i=i, p=1) for i in range(10)], "x,y", "z", ""]).encode())
    r = ingest(spark, src, str(tmp_path / "datasets"))
    assert (r.ok, r.status, r.quarantined_count, r.row_count) == (False, 400, 2, 10)
    assert r.path is None and os.listdir(tmp_path / "datasets") == ["_staging"] and os.listdir(tmp_path / "datasets" / "_staging") == []
    assert ingest(spark, src, str(tmp_path / "datasets"), tolerated=0.5).flagged


def test_unpublished_and_unreadable(spark, tmp_path):
    os.makedirs(tmp_path / "datasets" / "half" / "raw")
    with pytest.raises(KeyError):
        resolve_dataset(spark, str(tmp_path / "datasets"), "half")
    assert probe_path(spark, str(tmp_path / "nothing.csv")) == []
    assert probe_path(spark, _write(str(tmp_path), "h.csv", b"a,b\n1,2\n")) == ["a", "b"]
    assert ingest(spark, str(tmp_path / "nothing.csv"), str(tmp_path / "datasets")).status == 400


def test_generator_ranges(spark):
    df = synthetic_profile(spark, 120, 42)
    assert df.columns == catalog.REQUIRED_COLUMNS and df.count() == 120
    r = df.agg({"TENURE": "min", "PURCHASES_TRX": "max"}).first()
    assert r[0] >= 6 and r[1] <= 29
    assert synthetic_profile(spark, 120, 42).subtract(df).count() == 0
