"""What the steps of pre-processing read."""

from packetloom.operators import preprocess


def test_a_capture_is_aligned_without_reading_the_others_again(spark, tmp_path):
    for name, times in (("a", range(0, 100, 10)), ("b", range(45, 145, 10))):
        spark.createDataFrame([(name, 1, t) for t in times], "capture_id string, stream_id long, time_ms long").write.parquet(str(tmp_path / name))
    captures = [spark.read.parquet(str(tmp_path / name)) for name in "ab"]
    first, second = preprocess.align_times(captures)
    assert first.inputFiles() and not any(f"{tmp_path}/b/" in f for f in first.inputFiles())
    assert sorted(r.time_ms for r in first.collect()) == [50, 60, 70, 80, 90] and sorted(r.time_ms for r in second.collect()) == [45, 55, 65, 75, 85]
