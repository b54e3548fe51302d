import numpy as np
import pytest

from murmuration.operators import scaling
from murmuration.streaming import scaler


def test_batches_give_what_one_fit_gives(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(90, 4)) @ np.random.default_rng(1).normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(f"u{i % 3}", i, v.tolist()) for i, v in enumerate(x)], "utt_id string, frame int, x array<double>")
    source, path = str(tmp_path / "in"), str(tmp_path / "moments")
    for part in range(3):  # each run takes what has arrived since the last
        df.where(f"frame % 3 = {part}").write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        scaler.fit_stream(stream, 4, path, str(tmp_path / "state")).awaitTermination()
    stats, loadings = scaler.fitted(spark, path, 4, 2)
    want_stats, want = scaling.fit_scaler_pca(df, 2)
    a, b = stats.first(), want_stats.first()
    assert a["n"] == b["n"] == 90 and np.allclose(a["mean"], b["mean"]) and np.allclose(a["var"], b["var"])
    assert np.allclose(loadings, want)


def test_no_frames(spark, tmp_path):
    df = spark.createDataFrame([], "x array<double>")
    scaler.partial_moments(df, 3).write.parquet(str(tmp_path / "m" / "batch=0"))
    with pytest.raises(ValueError):
        scaler.fitted(spark, str(tmp_path / "m"), 3, 2)
