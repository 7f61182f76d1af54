"""Files by content with kept hashes, parts of records, and what exports say."""

import hashlib

from pyspark.sql import functions as F

from brinewood.operators import catalog, export
from brinewood.sources import hashes


def test_only_new_states_are_read(spark, tmp_path, monkeypatch):
    folder, place = tmp_path / "files", str(tmp_path / "kept")
    (folder / "deep er").mkdir(parents=True)
    files = {"a.pdf": b"one", "b.PDF": b"two", "deep er/c.pdf": b"one", "d.txt": b"no", ".hidden.pdf": b"h"}
    for name, content in files.items():
        (folder / name).write_bytes(content)
    real = hashes.known

    def hashed():
        got = hashes.content_hashes(spark, str(folder), ".pdf", place)
        return {r.path.rsplit("/", 1)[-1]: r.sha256 for r in got.collect()}

    want = {n.rsplit("/", 1)[-1]: hashlib.sha256(c).hexdigest() for n, c in files.items() if n[-3:].lower() == "pdf" and n[0] != "."}
    assert hashed() == want
    n = real(spark, place).count()
    assert hashed() == want and real(spark, place).count() == n  # nothing was read again
    (folder / "a.pdf").write_bytes(b"three!")
    (folder / "b.PDF").unlink()
    monkeypatch.setattr(hashes, "LOT", 1)
    (folder / "e.pdf").write_bytes(b"four")
    (folder / "f.pdf").write_bytes(b"")  # empty files are left out
    got = hashed()
    assert got == {"a.pdf": hashlib.sha256(b"three!").hexdigest(), "c.pdf": want["c.pdf"], "e.pdf": hashlib.sha256(b"four").hexdigest()} and real(spark, place).count() == n + 2


def test_long_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Spark's reader gives no file of 2 GB as one value (here: of 1 kB); bytes, marks and line feeds at either end are all in the hash."""
    monkeypatch.setattr(hashes, "LONG", 1_000)
    noise = bytes(range(256)) * 40
    files = {"a": noise, "b": noise + b"\n", "c": b"\xef\xbb\xbf" + noise, "d": b"\xef\xbb\xbf" + noise + b"\n\n", "e": b"\n" * 2000, "f g": b"\r\n" + noise[::-1] + b"\r", "h": b"short"}
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / f"{name}.bin").write_bytes(content)
    read = []
    monkeypatch.setattr(hashes, "hash_of_long", lambda *a, real=hashes.hash_of_long: read.append(a[1]) or real(*a))
    for most in ("128m", "1k"):  # in one split and in many
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = {r.path.rsplit("/", 1)[-1][:-4]: r.sha256 for r in hashes.content_hashes(spark, str(tmp_path / "in"), ".bin", str(tmp_path / most)).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {n: hashlib.sha256(c).hexdigest() for n, c in files.items()}
    assert len(read) == 12


def test_records_find_their_files(spark):
    rows = [("/x/a.pdf", "h1"), ("/x/b.pdf", "h1"), ("/x/c.pdf", "h2")]
    known = spark.createDataFrame(rows, "path string, sha256 string")
    got = hashes.with_files(spark.createDataFrame([("h1", 1), ("h3", 2), (None, 3)], "hash string, k int"), known).collect()
    assert {(r.k, r.found) for r in got} == {(1, "b.pdf"), (2, None), (3, None)}
    assert {(r.sha256, r.n_files) for r in hashes.by_content(known).collect()} == {("h1", 2), ("h2", 1)}


def test_parts_of_records(spark):
    names = ["x_d0001de0003.pdf", "x_d0003de0003.pdf", "x_d0002de0002.pdf", "y_d0001de0009.pdf", "z_d0001de0001.pdf", "z_d0001de0002.pdf", "other.pdf"]
    listed = catalog.listed_parts(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    entries = spark.createDataFrame([(1, "x", "z"), (2, "y", "z"), (3, "y", None), (4, "w", None), (5, None, "x")], "k int, folder string, see_also string")
    got = sorted((r.k, r.folder, r.total, r.part, r.present) for r in catalog.resolve_parts(entries, ["k"], listed).collect())
    x = lambda k: [(k, "x", 3, 1, True), (k, "x", 3, 2, False), (k, "x", 3, 3, True)]
    assert got == [*x(1), (2, "z", 1, 1, True), *x(5)]
    assert catalog.resolve_parts(entries, ["k"], listed.limit(0)).count() == 0


def test_texts_of_zero_are_said(spark):
    row = spark.createDataFrame([("0", 0, "0.0", None), ("", 5, None, 0)], "text string, n int, other string, m int")
    got = row.select(export.said(F.col("text")), export.counted(F.col("n")), export.first_said(F.col("other"), export.counted(F.col("m")), F.lit("z"))).collect()
    assert [tuple(r) for r in got] == [("0", "", "0.0"), ("", "5", "z")]
