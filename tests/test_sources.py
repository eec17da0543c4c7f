"""S1-S6, S10 and the positional truth join (J5) on files written by the test."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from wearline.operators import rul
from wearline.sources import files
from wearline.sources.contract import assert_contract


def test_snapshot_csv(spark, scratch):
    p = os.path.join(scratch, "snap.csv")
    with open(p, "w") as f:
        f.write("UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],"
                "Torque [Nm],Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF\n")
        f.write("1,M14860,M,298.1,308.6,1551,42.8,0,0,0,0,0,0,0\n")
        f.write("2,L47181,L,298.2,308.7,1408,NaN,3,1,0,1,0,0,0\n")
    df = files.read_snapshot_csv(spark, p)
    assert df.columns[:3] == ["udi", "product_id", "machine_type"]
    rows = df.orderBy("udi").collect()
    assert rows[0].torque_nm == 42.8 and rows[1].torque_nm is None and rows[1].hdf == 1


def test_cycles_text_and_truth(spark, scratch):
    p = os.path.join(scratch, "train.txt")
    with open(p, "w") as f:
        for unit, n in ((1, 3), (2, 1), (3, 2)):
            for c in range(1, n + 1):
                vals = [unit, c] + [0.1 * c] * 3 + [float(s + c) for s in range(21)] + [9.9, 8.8]  # extra columns
                f.write(" ".join(str(v) for v in vals) + "   \n")
    df = files.read_cycles_text(spark, p)
    assert len(df.columns) == 26 and df.count() == 6
    last = rul.last_cycle_rows(df)
    t = os.path.join(scratch, "truth.txt")
    with open(t, "w") as f:
        f.write("112\n98\n69\n")
    truth = files.read_truth(spark, t)
    j = rul.join_truth_by_position(last, truth).orderBy("unit_number").collect()
    assert [(r.unit_number, r.time_cycles, r.rul) for r in j] == [(1, 3, 112), (2, 1, 98), (3, 2, 69)]
    bad = os.path.join(scratch, "truth_short.txt")
    with open(bad, "w") as f:
        f.write("112\n98\n")
    with pytest.raises(ValueError):
        rul.join_truth_by_position(last, files.read_truth(spark, bad))


def test_json_documents_bundle_and_sink(spark, scratch):
    schema = StructType([StructField("review_budgets", ArrayType(StructType([
        StructField("review_fraction", DoubleType()), StructField("reviewed_assets", LongType()),
        StructField("captured_failures", LongType())]))), StructField("note", StringType())])
    p = os.path.join(scratch, "rq.json")
    with open(p, "w") as f:
        json.dump({"review_budgets": [{"review_fraction": 0.05, "reviewed_assets": 100, "captured_failures": 61}],
                   "note": "x"}, f, indent=2)
    df = files.read_json_documents(spark, p, schema)
    assert df.select(F.inline("review_budgets")).first().captured_failures == 61
    b = files.load_bundle(spark, {"rq": p, "other": os.path.join(scratch, "missing.json")},
                          {"rq": schema, "other": schema}, required=["rq"])
    assert b["other"].count() == 0 and b["rq"].count() == 1
    with pytest.raises(FileNotFoundError):
        files.load_bundle(spark, {"rq": os.path.join(scratch, "nope.json")}, {"rq": schema}, required=["rq"])
    out = os.path.join(scratch, "deep", "dir", "out")
    files.write_result(df, out)
    assert spark.read.schema(schema).json(out).count() == 1


def test_contract(spark):
    df = spark.createDataFrame([(0.97, 0.9), (0.99, None)], "roc_auc double, pr_auc double")
    rep = assert_contract(df, ["roc_auc", "pr_auc"], {"roc_auc": (0.95, 1.0)}, min_rows=2)
    assert rep["ok"]
    with pytest.raises(AssertionError):
        assert_contract(df, ["roc_auc", "f1"], {"pr_auc": (0.8, 1.0)})


def test_truth_in_byte_ranges_and_numbered_parts(spark, scratch):
    """Lines are numbered over several splits of a file and over parts whose numbers outgrow their width."""
    import os

    values = [(i * 7919) % 300 for i in range(4000)]
    os.makedirs(scratch + "/parts")
    bounds = [0, 900, 901, 901, 2500, 4000]
    for name, a, b in zip(["part-00007-x", "part-99999-x", "part-100000-x", "part-100001-x", "part-1000000-x"], bounds, bounds[1:]):
        with open(f"{scratch}/parts/{name}", "w") as f:
            f.write("".join(f"{v} \n" + ("\n" if k % 50 == 0 else "") for k, v in enumerate(values[a:b])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = files.read_truth(spark, scratch + "/parts")
        assert spark.read.text(scratch + "/parts").select("_metadata.file_block_start").distinct().count() > 3
        assert [(r.unit_ordinal, r.rul) for r in out.orderBy("unit_ordinal").collect()] == list(enumerate(values, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_staged_folders_can_be_cleared(spark, scratch):
    from wearline.session import clear_staged, path_exists, stage, staged_so_far

    kept = stage(spark.range(5), "kept")
    mark = staged_so_far(spark)
    gone = stage(spark.range(7), "gone")
    path = gone.inputFiles()[0].rsplit("/", 1)[0]
    assert gone.count() == 7 and path_exists(spark, path)
    assert clear_staged(spark, mark) == 1 and not path_exists(spark, path)
    assert kept.count() == 5 and clear_staged(spark, mark) == 0
