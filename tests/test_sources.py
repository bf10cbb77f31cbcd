"""Sources and sinks."""

import pytest

from tallyspark.sources import tables as S


def test_text_table_keeps_na_as_text(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,v\n1,NA\n2,\n3,None\n007,x\n", encoding="utf-8")
    got = {r["id"]: r["v"] for r in S.read_text_table(spark, str(p)).collect()}
    assert got == {"1": "NA", "2": None, "3": "None", "007": "x"}
    assert dict(S.read_table(spark, str(p)).dtypes)["id"] == "int"
    with pytest.raises(ValueError, match="suffix"):
        S.read_table(spark, str(tmp_path / "t.sav"))


def test_tables_ledger_and_fingerprint(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    S.write_tables({"one": d, "two": d.limit(2)}, str(tmp_path / "run"))
    back = spark.read.parquet(str(tmp_path / "run" / "one"))
    assert back.count() == 3
    a, b = S.table_fingerprint(d).first(), S.table_fingerprint(back.repartition(3)).first()
    assert a == b and a["rows"] == 3
    assert S.table_fingerprint(d.where("k < 3")).first()["sum_low"] != a["sum_low"]
    for run in ("r1", "r2"):
        S.append_ledger(spark, str(tmp_path / "ledger"), run, {"errors": 0})
    assert sorted(r["run"] for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == ["r1", "r2"]
    ids = [r["row_id"] for r in S.with_row_id(back).collect()]
    assert len(set(ids)) == 3
    m = S.run_manifest(spark, "demo", {"a": 1}, {"in": d}, {"out": back}).collect()
    assert {r["role"] for r in m} == {"input", "output"}
