import hashlib

from bindery.plans import acquire_queries


def test_all_files_with_large_ones_rejected(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(acquire_queries, "FILE_CAP", 100)
    files = {"book_source.parquet": b"a" * 100, "page.parquet": b"b" * 101, "text_line.parquet/part-0.parquet": b"d", "text_line.parquet/part-1.parquet": b"c" * 7}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "notes.txt").write_bytes(b"no table")
    got = {r.file: (r.length, r.sha256) for r in acquire_queries.file_identity(spark, str(tmp_path)).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest() if len(c) <= 100 else None) for n, c in files.items()}
