"""End-to-end run of the command-line job on samples written as the
reference's input shape (a 7-slot label array plus numeric features)."""

import json

from pyspark.sql import functions as F

from quiver.cli import run
from quiver.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_train_then_evaluate(spark, tmp_path):
    s = X.samples(spark, SF)
    label = F.array(F.col("convert_label"), F.col("gmv"), F.col("roi1"), F.col("cost"), F.col("l_discount"),
                    F.col("l_tax"), F.lit(0.0)).cast("array<float>")
    data = s.select(label.alias("label"), "l_quantity", "l_extendedprice", "l_discount",
                    F.year("l_shipdate").alias("y"))
    data.filter("y < 2000").drop("y").write.parquet(str(tmp_path / "d" / "20250917"))
    data.filter("y >= 2000").drop("y").write.parquet(str(tmp_path / "d" / "20250918"))
    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"bounds": {"l_quantity": [5.0, 10.0, 20.0, 30.0, 40.0],
                                           "l_discount": [0.02, 0.05, 0.08], "l_extendedprice": [0.0]},
                                "log_bounds": {"l_extendedprice": [8.0, 10.0, 10.5, 11.0]}}))
    out = run(spark, ["--train-paths", f"{tmp_path}/d/{{20250917,20250918}}/*", "--is-offline", "1",
                      "--is-eval", "1", "--spec", str(spec), "--out", str(tmp_path / "o"),
                      "--loss-type", "weighted_cross_entropy, focal_loss"])
    report = spark.read.parquet(out["report"])
    assert report.count() == 46
    losses = spark.read.parquet(out["losses"]).first()
    assert losses.total_loss > 0
    assert spark.read.parquet(out["scored"]).count() == data.filter("y >= 2000").count()


def test_whole_feature_path_with_a_warm_start(spark, tmp_path):
    """Categorical, 1-D and 2-D features with ratios and deltas, samples that lack columns, a second run that begins from the first's model."""
    s = X.samples(spark, SF)
    label = F.array(F.col("convert_label"), F.col("gmv"), F.col("roi1"), F.col("cost"), F.col("l_discount"), F.col("l_tax"), F.lit(0.0)).cast("array<float>")
    series = [F.transform(F.sequence(F.lit(1), F.lit(20)), lambda j: (F.col("l_partkey") * k + j) % 37 - 1).alias(f"m_{h}h_vmid_all") for k, h in ((3, 1), (7, 3))]
    data = s.select(label.alias("label"), F.col("l_orderkey").alias("req_id"), F.col("l_partkey").alias("customer_id"), F.col("l_suppkey").alias("ad_id"),
                    F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("qty"), *series, (F.col("l_linenumber") % 2).alias("kind"),
                    F.year("l_shipdate").alias("y"))
    data.filter("y < 2000").drop("y").write.parquet(str(tmp_path / "d" / "20250917"))
    data.filter("y >= 2000").drop("y").write.parquet(str(tmp_path / "d" / "20250918"))
    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"bounds": {"qty": [5.0, 20.0], "absent": [1.0]}, "sparse": {"flag": 97}, "log_bounds": {"qty": [1.0, 2.0, 3.0]},
                                "arrays": {"m_1h_vmid_all": [10.0, 34.0], "m_3h_vmid_all": [30.0], "m_1_3h_vmid_all": [-3.0, -1.0, 0.0], "r": [-0.5, 0.5]},
                                "ratios": [["m_1h_vmid_all", "m_3h_vmid_all", "r"]], "ladders": {"m": [1, 3]}, "key": "vmid"}))
    common = ["--train-paths", f"{tmp_path}/d/{{20250917,20250918}}/*", "--is-offline", "1", "--spec", str(spec), "--auto-type-field", "kind",
              "--auto-type-to-keep", "1", "--out", str(tmp_path / "o")]
    first = run(spark, [*common, "--model-path", str(tmp_path / "m1"), "--score-train", "1"])
    second = run(spark, [*common, "--is-eval", "1", "--warm-start", str(tmp_path / "m1"), "--model-path", str(tmp_path / "m2")])
    assert all(n > 0 for n in first["steps"].values()) and all(n == 0 for n in second["steps"].values())
    a, b = (sorted(map(tuple, spark.read.parquet(str(tmp_path / m)).collect())) for m in ("m1", "m2"))
    assert a == b
    scored = spark.read.parquet(second["scored"])
    kept = data.filter("kind = 1")
    assert {r.dataset: r.n for r in scored.groupBy("dataset").agg(F.count("*").alias("n")).collect()} == {
        "train": kept.filter("y < 2000").count(), "eval": kept.filter("y >= 2000").count()}
    assert spark.read.parquet(second["report"]).count() == 46
    flags = scored.filter("dataset = 'eval'").join(kept.select("req_id", "customer_id", "ad_id", "flag"), ["req_id", "customer_id", "ad_id"])
    p = {r.flag: r.p for r in flags.groupBy("flag").agg(F.avg("score_convert").alias("p")).collect()}
    assert p["R"] > 0.5 > max(v for k, v in p.items() if k != "R")     # the label is that flag
