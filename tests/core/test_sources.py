import numpy as np
import pytest

from murmuration.sources import files, segment_files

GRID = '''File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 2.5
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        xmin = 0
        xmax = 2.5
        intervals: size = 3
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "Hello ""you"""
        intervals [2]:
            xmin = 0.5
            xmax = 1
            text = ""
        intervals [3]:
            xmin = 1
            xmax = 2.5
            text = "two
lines"
    item [2]:
        class = "TextTier"
        name = "points"
        points [1]:
            number = 1
            mark = "x"
'''


def test_frames(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "sub" / "a.b.npy", x)
    np.save(tmp_path / "flat.npy", np.arange(3.0))
    np.save(tmp_path / "empty.npy", np.zeros((0, 3)))
    got = {(r["utt_id"], r["frame"]): r["x"] for r in files.read_frames(spark, str(tmp_path)).collect()}
    assert got == {("flat", 0): [0.0, 1.0, 2.0]} | {("a.b", i): x[i].tolist() for i in range(4)}


def test_boundaries(spark, tmp_path):
    (tmp_path / "u1.list").write_text("0.5\n\n 1.25 # end\n")
    (tmp_path / "u2.list").write_text("3")
    (tmp_path / "none.list").write_text("")
    got = {(r["utt_id"], r["pos"], r["end_sec"]) for r in files.read_boundaries(spark, str(tmp_path)).collect()}
    assert got == {("u1", 0, 0.5), ("u1", 1, 1.25), ("u2", 0, 3.0)}


def test_textgrid(spark, tmp_path):
    (tmp_path / "u1.TextGrid").write_text(GRID)
    (tmp_path / "u2.TextGrid").write_bytes(GRID.encode("utf-16"))
    rows = [tuple(r) for r in files.read_textgrids(spark, str(tmp_path)).collect()]
    want = [("words", 0.0, 0.5, 'Hello "you"'), ("words", 0.5, 1.0, ""), ("words", 1.0, 2.5, "two\nlines")]
    assert sorted(rows) == sorted((u, *w) for u in ("u1", "u2") for w in want)


def test_partition_round_trip(spark, tmp_path):
    rows = [(0, 0, "a", 0, 50), (0, 1, "b", 5, 10), (1, 2, "c", 1, 2), (11, 3, "d", 3, 4)]
    df = spark.createDataFrame(rows, "class int, pos int, utt_id string, start_frame int, end_frame int")
    files.write_partition(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "Class 0\na 0.0 1.0\nb 0.1 0.2\n\nClass 1\nc 0.02 0.04\n\nClass 11\nd 0.06 0.08\n\n"
    (tmp_path / "p.txt").write_text("Class 7\nClass 8\n" + text + "one\na b c d\n")
    got = [(r["class"], r["pos"], r["utt_id"], r["start_sec"], r["end_sec"]) for r in files.read_partition(spark, str(tmp_path / "p.txt")).collect()]
    assert sorted(got) == [(0, 0, "a", 0.0, 1.0), (0, 1, "b", 0.1, 0.2), (1, 0, "c", 0.02, 0.04), (2, 0, "d", 0.06, 0.08)]


def test_partition_in_parts_and_in_splits(spark, tmp_path):
    rows = [(c, i, f"u{i}", i, i + 2) for c in range(7) for i in range(c * 40, c * 40 + (1 if c == 3 else 40))]
    df = spark.createDataFrame(rows, "class int, pos int, utt_id string, start_frame int, end_frame int")
    want = sorted((c, i - c * 40, u, a / 50, b / 50) for c, i, u, a, b in rows)
    files.write_partition(df, str(tmp_path / "parts"))
    read = lambda **kw: sorted(tuple(r[1:]) for r in files.read_partition(spark, **kw).collect())
    assert read(path=str(tmp_path / "parts"), in_parts=True) == want
    (tmp_path / "whole.txt").write_text("".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*"))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert read(path=str(tmp_path / "whole.txt")) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_segment_files(spark, tmp_path):
    folder = str(tmp_path / "segments")
    rows = [("a_b", 0, 5, [1.0, 2.0]), ("a_b", 5, 9, [3.0, 4.0]), ("c", 0, 2, [5.0, 6.0]), ("c", 0, 2, [5.0, 6.0]), (None, 0, 1, [1.0]), ("d", 0, 1, None)]
    df = spark.createDataFrame(rows, "utt_id string, start_frame int, end_frame int, features array<double>")
    assert segment_files.write_segments(df, folder) == 3
    assert segment_files.write_segments(df, folder) == 0  # what is there stays
    np.save(tmp_path / "segments" / "pca_model.npy", np.zeros(3))
    np.save(tmp_path / "segments" / "nokey.npy", np.zeros(3))
    (tmp_path / "segments" / "sub").mkdir()
    np.save(tmp_path / "segments" / "sub" / "e_3_4.npy", np.float32([7, 8]))
    got = sorted(map(tuple, segment_files.read_pooled(spark, folder).collect()))
    assert got == sorted([*rows[:3], ("e", 3, 4, [7.0, 8.0])])
    assert [r["path"].rsplit("/", 1)[1] for r in segment_files.unread_files(spark, folder).collect()] == ["nokey.npy"]
    units = spark.createDataFrame([("a", 0, 5, [3, 3, 7]), ("a", 5, 6, [])], "utt_id string, start_frame int, end_frame int, units array<int>")
    assert segment_files.write_segments(units, str(tmp_path / "units"), "units") == 2
    assert sorted(map(tuple, segment_files.read_units(spark, str(tmp_path / "units")).collect())) == [("a", 0, 5, [3, 3, 7]), ("a", 5, 6, [])]


def test_frame_files(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, [1.0, 2.0]), ("u", 0, [3.0, 4.0]), ("v", 0, [5.0, 6.0]), (None, 0, [0.0, 0.0])], "utt_id string, frame int, x array<float>")
    assert segment_files.write_frames(df, str(tmp_path / "f")) == 2
    assert sorted(map(tuple, files.read_frames(spark, str(tmp_path / "f")).collect())) == [("u", 0, [3.0, 4.0]), ("u", 1, [1.0, 2.0]), ("v", 0, [5.0, 6.0])]


def test_run_names(spark):
    names = ["x/cosine_t0.5_r0.31_58.00.txt", "kmeans_116.7.txt", "a/birch_r0.9.txt", "other.txt", None]
    got = [(r["run_threshold"], r["run_resolution"], r["run_method"]) for r in files.run_metadata(spark.createDataFrame([(n,) for n in names], "path string")).collect()]
    assert got == [(0.5, 0.31, "Graph"), (None, None, "K-means"), (None, 0.9, "BIRCH"), (None, None, None), (None, None, None)]


def test_scratch_tables_go_at_the_end(spark):
    import os

    from murmuration import session

    with session.scratch():
        table = session.write_table(spark.range(3), "kept")
        with session.scratch():
            inner = session.write_table(table.df, "inner")
            assert inner.df.count() == 3
        assert not os.path.exists(inner.path) and table.df.count() == 3
        dropped = session.write_table(spark.range(2), "dropped")
        dropped.drop()
    assert not os.path.exists(table.path)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    from types import SimpleNamespace

    from murmuration import session

    elsewhere = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, applicationId="app"))
    with pytest.raises(RuntimeError):
        session.shared_dir(elsewhere)
    elsewhere.conf["spark.checkpoint.dir"] = "/shared/"
    assert session.shared_dir(elsewhere) == "/shared/murmuration/app"
