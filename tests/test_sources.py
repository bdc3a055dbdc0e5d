import struct
import zlib

import pytest

from voxtable.sources import storage as ST
from voxtable.sources import tables as T


def png(path, w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(w) for _ in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_catalogue(spark, tmp_path):
    sub = tmp_path / "benign" / "100X"
    sub.mkdir(parents=True)
    png(sub / "SOB_B_TA-14-4659-100-001.png", 7, 5)
    png(sub / "SOB_M_DC-14-2523-400-010.png", 3, 4)
    png(sub / "SOB_B_TA-14.png", 2, 2)                  # too few parts
    png(sub / "SOB_B_TA-14-1-40-002.PNG", 2, 2)         # extension case matters
    (sub / "SOB_B_F-14-9-40-003.png").write_bytes(b"broken")
    got = {r.image_number: r for r in ST.image_catalogue(spark, str(tmp_path)).collect()}
    assert set(got) == {"001", "010"}
    assert (got["001"].width, got["001"].height, got["001"].is_benign, got["010"].is_benign) == (7, 5, True, False)


def test_storage_bytes(spark, tmp_path):
    assert ST.storage_bytes(spark, str(tmp_path / "missing")) == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"12345")
    (tmp_path / "y.bin").write_bytes(b"123")
    assert ST.storage_bytes(spark, str(tmp_path)) == 8


def test_tables_are_pooled_by_name(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text(" PatientID ,X,Y\np1,1,2\n")
    b.write_text("Y,PatientID,X\n20,p2,10\n")
    got = T.read_tables(spark, [str(a), str(b)]).orderBy("PatientID").collect()
    assert [(r.PatientID, r.X, r.Y) for r in got] == [("p1", 1, 2), ("p2", 10, 20)]
    assert T.read_tables(spark, str(a)).columns == ["PatientID", "X", "Y"]


def test_reports(spark, scratch):
    df = spark.createDataFrame([("a", 1.5, None), ("b", 2.5, 3)], "k string, v double, n long")
    T.write_csv(df, f"{scratch}/csv", single_file=True)
    assert T.read_csv(spark, f"{scratch}/csv", df.schema).orderBy("k").collect() == df.orderBy("k").collect()
    one = df.where("k = 'a'")
    T.write_report(one, f"{scratch}/json")
    assert T.read_report(spark, f"{scratch}/json", df.schema).collect() == one.collect()


def test_write_once_keeps_finished_output(spark, scratch):
    out = f"{scratch}/o"
    assert T.write_once(spark.range(3), out)
    assert not T.write_once(spark.range(9), out) and spark.read.parquet(out).count() == 3
    assert T.write_once(spark.range(9), out, force=True) and spark.read.parquet(out).count() == 9


def test_shared_folder_must_be_named_on_a_cluster():
    from voxtable.session import shared_root

    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Cluster())


def test_a_local_session_without_a_shared_folder_gets_one():
    from voxtable.session import shared_root

    class Conf:
        def get(self, key, default):
            return default

    class Local:
        conf = Conf()
        sparkContext = type("C", (), {"master": "local[2]", "applicationId": "local-test"})()
    assert shared_root(Local()) == shared_root(Local())
