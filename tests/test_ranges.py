"""Large files by ranges, against the csv module on whole files."""

import csv
import io
import random

import pytest

from matforge.sources import catalogs, ranges


def plain(content, delimiter=","):
    body = catalogs.decode(content).lstrip("﻿")
    rows = list(csv.reader(io.StringIO(body, newline=""), delimiter=delimiter))
    names = [catalogs.clean_name(h) for h in rows[0]]
    return [dict(zip(names, r)) for r in rows[1:] if any(c.strip() for c in r)]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def cell(rnd):
    kind = rnd.randrange(8)
    word = lambda: "".join(rnd.choices("abc é;\t", k=rnd.randrange(0, 9)))
    if kind < 4:
        return word().replace(";", "").replace("\t", "")
    if kind == 4:
        return '"' + word() + "\n" * rnd.randrange(1, 4) + word() + '"'
    if kind == 5:
        return '"' + word() + '""' + word() + ',"""' + word() + '"'
    if kind == 6:
        return word().replace(";", "").replace("\t", "") + '"x"'  # quotes inside a cell are letters
    return '"q"tail'


def written(tmp_path, name, content):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "a.csv").write_bytes(content)
    return str(folder)


def check(spark, folder, content, delimiter=","):
    rows = catalogs.read_rows(spark, folder).orderBy("row_idx").collect()
    want = plain(content, delimiter)
    assert [r["cells"] for r in rows if r["cells"] is not None] == want
    assert [r["row_idx"] for r in rows] == (list(range(1, len(want) + 1)) or [0])


@pytest.mark.parametrize("seed, encoding, end", [(1, "utf-8", "\n"), (2, "utf-8-sig", "\r\n"), (3, "latin-1", "\n"), (4, "utf-8", "\n")])
def test_quoted_breaks_across_ranges(spark, tmp_path, small_ranges, seed, encoding, end):
    rnd = random.Random(seed)
    lines = ["material_code,material_description,uom,plant"] + [",".join(cell(rnd) for _ in range(rnd.randrange(1, 6))) for _ in range(1500)]
    if seed == 4:  # one cell that is longer than several ranges
        lines[700] = 'X,"' + "long line\n" * 2000 + '",EA'
    content = end.join(lines).encode(encoding)
    folder = written(tmp_path, "in", content)
    assert ranges.lines_of(spark, folder).select("at").distinct().count() > 5
    check(spark, folder, content)


def test_small_files_together(spark, tmp_path):
    head = b"material_code;material_description;uom\n"
    for name, body in (("a.csv", head + b'A1;"x;\ny";EA\n'), ("b.csv", b""), ("c.csv", head), ("d.csv", b"\n\n"), ("e.csv", b"\xef\xbb\xbf" + head.replace(b";", b",") + b"E1,Pump,EA")):
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: (r["row_idx"], r["cells"] and r["cells"]["material_description"], r["problem"]) for r in catalogs.read_rows(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (1, "x;\ny", None), "b.csv": (0, None, "CSV file is empty."), "c.csv": (0, None, None), "d.csv": (0, None, "CSV file is empty."), "e.csv": (1, "Pump", None)}


def test_log_of_one_file_by_ranges(spark, tmp_path, small_ranges):
    rnd = random.Random(9)
    lines, want = [], []
    for i in range(600):
        lines += [f"[BLOCKED by SAFETY GATE] confidence=0.{50 + i % 40}", f"  A: ITEM-{i} (X)"] + ["noise"] * rnd.randrange(3) + [f"  B: PART-{i}"]
        if rnd.random() < 0.7:
            lines.append(f"  SAFETY GATE TRIGGERED: reason {i}")
            want.append((f"ITEM-{i}", f"PART-{i}", f"reason {i}"))
    (tmp_path / "log.txt").write_bytes("\r\n".join(lines).encode())
    got = catalogs.read_log(spark, str(tmp_path)).collect()
    assert sorted((r["item_a"], r["item_b"], r["block_reason"]) for r in got) == sorted(want)
