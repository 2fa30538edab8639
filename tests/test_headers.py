"""Headers are read from the first bytes of a file, whatever follows, and by one job for all files."""

import gzip
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from procura.sources import headers, sheets
from procura.sources.headers import first_record

HEAD = "CODFORNEC,FILIAL,FORNECEDOR,FANTASIA,CODCOMPRADOR,JANEIRO,FEVEREIRO"
NAMES = tuple(HEAD.split(","))


class Watched(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


@pytest.mark.parametrize("text, want", [
    ("", []),
    ("\n \r\n", []),
    ("\n\na,b\n1,2\n", ["a", "b"]),
    ("﻿a,b\r\n1,2", ["a", "b"]),
    ("a,b\r1,2", ["a", "b"]),
    ('a,"b\nc",d\n1,2,3\n', ["a", "b\nc", "d"]),
    ('a,"b""c, d"\n', ["a", 'b"c, d']),
    ('a,"b\n1,2\n3,4\n', ["a", "b\n"]),
    ("a,ç,a\n", ["a", "ç", "a"]),
])
def test_first_record(text, want):
    assert first_record(io.BytesIO(text.encode())) == want


def test_a_record_without_end_counts_as_its_first_line():
    assert first_record(io.BytesIO(b'a,"b\n' + b"1,2\n" * 100_000)) == ["a", "b\n"]
    assert first_record(io.BytesIO(b'a,"b\n' + b"1,2\n" * 1000), most=100) == ["a", "b\n"]
    assert first_record(io.BytesIO(b"a" * 200), most=100) is None


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters='\r\n",﻿'), min_size=1), min_size=2, max_size=6))
def test_any_plain_header(names):
    if not "".join(names).strip():
        return
    assert first_record(io.BytesIO((",".join(names) + "\n1,2\n").encode())) == names


def test_bytes_read_do_not_grow_with_the_file():
    taken = []
    for rows in (10, 100_000):
        file = Watched((HEAD + "\n" + "7,1,A,A,C,1,2\n" * rows).encode())
        assert tuple(first_record(file)) == NAMES
        taken.append(file.taken)
    assert max(taken) <= headers.READ_AHEAD


def test_the_rest_of_a_file_is_not_read(spark, tmp_path):
    """The packed file breaks off after its first bytes, so whoever read on would fail."""
    folder = tmp_path / "Cópia + 100% 2025"
    folder.mkdir()
    body = HEAD + "\n" + "".join(f"{i * 7919 % 100003},1,A{i * 31 % 977},A,C,{i},2\n" for i in range(100_000))
    packed = gzip.compress(body.encode())
    (folder / "FILIAL 1.csv.gz").write_bytes(packed[: len(packed) // 2])
    (folder / "FILIAL 2.csv").write_text(body)
    (folder / "FILIAL 3.csv").write_text("")  # Spark's file index has no empty files
    spark.createDataFrame([(1, 2)], "`Cod Fornec` int, `a.b` int").coalesce(1).write.parquet(str(folder / "FILIAL 4"))
    got = {s.name: s.columns for s in sheets.list_sheets(spark, str(folder))}
    assert got == {"FILIAL 1": NAMES, "FILIAL 2": NAMES, "FILIAL 4": ("Cod Fornec", "a.b")}


def test_files_that_tasks_cannot_open_take_the_readers_of_spark(spark, tmp_path):
    folder = tmp_path / "C 2025"
    folder.mkdir()
    (folder / "FILIAL 1.csv").write_text("\n" + HEAD + "\n7,1,A,A,C,1,2\n")
    with gzip.open(folder / "FILIAL 2.csv.gz", "wt") as file:
        file.write(HEAD + "\n7,2,A,A,C,1,2\n")
    spark.range(1).coalesce(1).write.parquet(str(folder / "FILIAL 4"))
    one, two = (sheets.list_sheets(spark, str(folder), schemes=s) for s in (headers.SCHEMES, ()))
    assert one == two and [s.columns for s in one] == [NAMES, NAMES, ("id",)]


def test_a_quoted_line_break_in_a_header(spark, tmp_path):
    folder = tmp_path / "C 2025"
    folder.mkdir()
    (folder / "FILIAL 1.csv").write_text(HEAD + ',"NOTA\nLIVRE"\n7,1,A,A,C,1,2,x\n8,1,B,B,C,3,4,y\n')
    (folder / "FILIAL 2.csv").write_text(HEAD + "\n9,2,A,A,C,5,6\n")
    table = sheets.scan_workbooks(spark, [str(folder)])
    assert sorted((r.CODFORNEC, r.JANEIRO) for r in table.collect()) == [(7, "1"), (8, "3"), (9, "5")]


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    counts = []
    for n in (2, 40):
        folder = tmp_path / f"{n} 2025"
        folder.mkdir()
        for i in range(n):
            (folder / f"FILIAL {i}.csv").write_text(HEAD + "\n")
            spark.createDataFrame([(i,)], "CODFORNEC int").coalesce(1).write.parquet(str(folder / f"ABA {i}")) if i < 2 or not i % 10 else None
        group = f"headers of {n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert len(sheets.list_sheets(spark, str(folder))) > n
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    assert counts[0] == counts[1]
