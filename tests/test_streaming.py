import os

from evalsmith.streaming.replies import start_reply_stream


def test_reply_stream_backfill(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    rows = [("c1", "m", "r1", 1, "violates the rule"), ("c2", "m", "r1", 0, "0"), ("c3", "n", "r1", 1, "unsure")]
    spark.createDataFrame(rows, "case_id string, model_name string, run_id string, label int, raw_output string").write.parquet(src)
    q = start_reply_stream(spark, src, os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt"), available_now=True)
    q.awaitTermination(120)
    out = {r["case_id"]: r for r in spark.read.parquet(os.path.join(tmpdir_path, "out")).collect()}
    assert out["c1"]["predicted_label"] == 1 and out["c1"]["decision"] == "Correct"
    assert out["c3"]["predicted_label"] == 2 and out["c3"]["decision"] == "Not Sure"
