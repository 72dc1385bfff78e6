"""Folders of uploads whose files differ in separator, header, order and names."""

import os

import pytest

from restate.sources import io as IO


def write(folder, files):
    for name, text in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as fh:
            fh.write(text)


def rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_every_file_counts_by_its_own_header(spark, tmp_path):
    write(tmp_path, {"a.csv": "Book,Value,Date\nB1,1.5,2024-01-01\nB2,2,\n", "b.csv": "date; VALUE ;book\n2024-01-02;3;B3\n",
                     "c d%20[1].csv": "﻿Book\tValue\nB4\t4\n", "e.csv": 'book|"no|te"|value\nB5|"x|y"|5\n', "f.csv": "Book,Value,Date\nB6,6,d\n",
                     "only header.csv": "Book,Other\n", "empty.csv": ""})
    df = IO.read_upload(spark, str(tmp_path))
    assert set(df.columns) == {"BOOK", "VALUE", "DATE", "NO|TE", "OTHER", "source_file"}
    got = rows(df, ["BOOK", "VALUE", "DATE", "NO|TE"])
    assert got == sorted([("B1", "1.5", "2024-01-01", None), ("B2", "2", None, None), ("B3", "3", "2024-01-02", None), ("B4", "4", None, None),
                          ("B5", "5", None, "x|y"), ("B6", "6", "d", None)], key=str)
    assert df.where("BOOK = 'B5'").first()["source_file"] == "e.csv"


def test_rows_of_another_length_can_be_seen(spark, tmp_path):
    write(tmp_path, {"a.csv": "a,b\n1,2\n1\n1,2,3\n"})
    got = rows(IO.read_upload(spark, str(tmp_path), bad_col="bad"), ["A", "B", "bad"])
    assert got == sorted([("1", "2", None), ("1", None, "1"), ("1", "2", "1,2,3")], key=str)


def test_names_twice_and_nothing(spark, tmp_path):
    write(tmp_path / "x", {"a.csv": "a, A\n1,2\n"})
    with pytest.raises(ValueError, match="more than once"):
        IO.read_upload(spark, str(tmp_path / "x"))
    write(tmp_path / "y", {"a.csv": ""})
    assert IO.read_upload(spark, str(tmp_path / "y")).count() == 0
