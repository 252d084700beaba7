"""Archives as a data source: members, gaps, bounded memory."""

import tracemalloc
import zipfile

import pytest

from tickerloom.sources import archives


def test_members(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "one\r\ntwo\n\nfour")
        z.writestr("DAY.TXT", "caf\xe9\n".encode("latin1"))
    with zipfile.ZipFile(tmp_path / "sub" / "b.ZIP", "w") as z:
        z.writestr("readme.md", "x")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("first.txt", "")
        z.writestr("second.txt", "s")
    read = lambda *a: sorted(((r.path.rsplit("/", 1)[1], r.member, r.line_no, r.value, r.missing_file) for r in archives.read_archives(spark, *a).collect()), key=str)
    assert read(str(tmp_path), "DAY.TXT") == [("a.zip", "DAY.TXT", 1, "café", None), ("b.ZIP", None, 0, None, "DAY.TXT")]
    assert read(f"file:{tmp_path}/a.zip") == [("a.zip", "x.txt", 1, "one", None), ("a.zip", "x.txt", 2, "two", None), ("a.zip", "x.txt", 3, "", None), ("a.zip", "x.txt", 4, "four", None)]
    every = archives.read_archives(spark, f"file://{tmp_path}", every_member=True)
    assert every.rdd.getNumPartitions() == 5 and every.where("value IS NOT NULL").count() == 6
    with pytest.raises(Exception, match="nowhere"):
        archives.read_archives(spark, f"{tmp_path}/nowhere").collect()
    (tmp_path / "none").mkdir()
    assert archives.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_a_large_member_is_read_piece_by_piece(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.txt", "w") as f:
        for i in range(300):
            f.write((f"{i:06d}" + "x" * 1994 + "\n").encode() * 500)  # 300 MB of text
    reader = archives.ArchiveReader({"path": str(tmp_path)})
    tracemalloc.start()
    lines = chars = 0
    for batch in reader.read(reader.partitions()[0]):
        lines += batch.num_rows
        chars += batch.column("value").nbytes
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == 150_000 and chars > 290e6 and peak < 40e6
