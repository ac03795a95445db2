"""Quoted CSV in many splits equals the reader that takes a file in one task."""

from __future__ import annotations

import csv
import os
import random
import tempfile

import pytest

from hearth.sources import csvsplit, files


def _folder(n_files: int, rows: int, seed: int, end: str = "\n") -> tuple[str, list[list[str]]]:
    rng = random.Random(seed)
    cells = ["plain", "", "with, comma", 'a "quoted" word', "two\nlines", "\n\n", '"', "x" * 90, "é\nü", "1,2\n\"3\"\n"]
    tmp, out = tempfile.mkdtemp(prefix="hearth-csvsplit-"), []
    for f in range(n_files):
        with open(os.path.join(tmp, f"feed_{f}.csv"), "w", newline="") as h:
            w = csv.writer(h, lineterminator=end)
            w.writerow(["id", "a", "b"] if f % 2 == 0 else ["id", "b", "a"])
            for i in range(rows):
                row = [f"{f}-{i}", rng.choice(cells), rng.choice(cells)]
                w.writerow(row)
                out.append([row[0], *(row[1:] if f % 2 == 0 else row[:0:-1])])
    return tmp, out


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_equals_the_rows_written(spark, small_splits, seed, end):
    tmp, want = _folder(3, 120, seed, end)
    df = files.read_csv(spark, tmp, columns=["id", "a", "b"], glob="feed_*.csv", missing=None)
    rows = df.orderBy("_ord").collect()
    assert [[r["id"], r["a"] or "", r["b"] or ""] for r in rows] == want  # in file order, too


def test_one_file_is_read_by_many_tasks(spark, small_splits):
    tmp, want = _folder(1, 200, 4)
    headers, inside = csvsplit.inventory(spark, tmp)
    assert list(headers.values()) == [["id", "a", "b"]]
    got = csvsplit.records(spark, tmp, None, inside)
    assert inside and got.rdd.getNumPartitions() > 5 and got.count() == len(want)


def test_equals_the_multiline_reader(spark, small_splits):
    tmp, _ = _folder(1, 150, 5)
    with open(os.path.join(tmp, "feed_0.csv"), "a", newline="") as h:
        h.write('short,row\n\n"long\nid",1,2,3\nlast,"open\nquote, to the end')
    one = (spark.read.schema("id string, a string, b string, bad string").option("header", True).option("escape", '"')
           .option("multiLine", True).option("columnNameOfCorruptRecord", "bad").csv(tmp))
    many = files.read_csv(spark, tmp, missing=None, ordinal=None, corrupt="bad")
    key = lambda df: sorted(((r.id, r.a, r.b, r.bad is None) for r in df.collect()), key=repr)
    assert key(many) == key(one)


def test_a_record_longer_than_several_splits(spark, small_splits):
    tmp = tempfile.mkdtemp(prefix="hearth-csvsplit-")
    body = "\n".join(f"line {i}" for i in range(600))
    with open(os.path.join(tmp, "x.csv"), "w", newline="") as h:
        csv.writer(h, lineterminator="\n").writerows([["k\nk", "v"], ["1", body], ["2", "b"], ["3", body], ["4", "d"]])
    got = files.read_csv(spark, tmp, missing=None).orderBy("_ord").collect()
    assert [(r["k\nk"], r["v"]) for r in got] == [("1", body), ("2", "b"), ("3", body), ("4", "d")]


def test_headers_are_named_as_the_reader_does():
    assert csvsplit.column_names('﻿a,,"b,c",A\r') == ["a0", "_c1", "b,c", "A3"]


def test_no_match(spark):
    tmp, _ = _folder(1, 3, 1)
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, tmp, glob="none*.csv")
