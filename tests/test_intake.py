"""Files of a store lie many to a folder, one for each row."""

from pathlib import Path

from memspark import queries_documents, queries_files

DATA = "/root/testdata/sf0.001"


def test_watched_files_are_many_to_a_folder(spark, tmp_path, monkeypatch):
    from memspark.operators import sinks

    monkeypatch.setattr(queries_files, "shared_path", lambda *_: str(tmp_path / "watched"))
    monkeypatch.setattr(queries_files, "FOLDERS", 2)
    rows = queries_files.s11(spark, DATA).collect()
    files = list((tmp_path / "watched").rglob("*-*.txt"))
    assert len(files) == len(rows) > 0 and len({p.parent for p in files}) <= 8  # before: a folder for each file
    assert {r.conv_id % 4 == 3 for r in rows if not r.available} == {True} and all(r.available == (r.conv_id % 4 != 3) for r in rows)
    odd = spark.createDataFrame([("a/b", "x y.txt", b"\x00\n"), ("a", "z", b""), ("a", "\u00e4", b"1")], "folder string, name string, content binary")
    for _ in range(2):  # a task that runs again writes the same files
        assert sinks.write_files(odd, str(tmp_path / "odd")) == 3
    assert {str(p.relative_to(tmp_path / "odd")): p.read_bytes() for p in (tmp_path / "odd").rglob("*") if p.is_file()} == {"a/b/x y.txt": b"\x00\n", "a/z": b"", "a/\u00e4": b"1"}
    assert sinks.write_files(odd.limit(0), str(tmp_path / "none")) == 0


def test_files_are_many_to_a_folder(spark, tmp_path, monkeypatch):
    for module, query, most in ((queries_documents, queries_documents.s1_files, 110), (queries_files, queries_files.s8, 2)):
        root = tmp_path / query.__name__
        monkeypatch.setattr(module, "shared_path", lambda *_, root=root: str(root))
        rows = query(spark, DATA).collect()
        files = [p for p in Path(root).rglob("part-*") if ".trash" not in str(p)]
        assert len({p.parent for p in files}) < most and len(files) >= len(rows) > 0
        if "files" in rows[0]:
            assert len(files) == sum(r["files"] for r in rows)
        else:
            assert all(p.read_text().count("\n") == 1 for p in files)


def test_taken_in_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    from memspark.operators import sinks

    wrote = []
    monkeypatch.setattr(sinks, "write_files", lambda files, root, write=sinks.write_files: wrote.append(write(files, root)))  # before: by Spark's writer, committed one by one
    rows = [(i, text, lang, source, 1) for i, (text, lang, source) in enumerate([("a\nb", "en", "x/y z"), ("c", "fr", "x/y z"), ("", "en", "."), ("d", None, None), ("e", "en", ""), ("g", "en", "%2F=")])] + [(15, "f", "fr", "x/y z", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.source, r.lang): (r.files, r.imported, r.binary, r.empty, r.bytes) for r in queries_documents.s1_files(spark, str(tmp_path)).collect()}
    assert found == {("x/y z", "en"): (1, 1, 0, 0, 4), ("x/y z", "fr"): (2, 1, 1, 0, 2), (".", "en"): (1, 1, 0, 0, 1), (None, None): (1, 1, 0, 0, 2), ("", "en"): (1, 1, 0, 0, 2), ("%2F=", "en"): (1, 1, 0, 0, 2)}
    assert wrote == [13]  # six files of the first ids lie in a hidden folder too
