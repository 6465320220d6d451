"""Large delimited files read by many tasks give the standard reader's rows."""

import csv
import io
import random

import pytest

from reckonry.sources import delimited as D


def _standard(data: bytes):
    text = D.decode(data)
    return list(csv.reader(io.StringIO(text), delimiter=D.delimiter_of(text)))


def _messy(seed, n, letters="abc xyzé"):
    draw, out = random.Random(seed), []
    for k in range(n):
        cells = []
        for _ in range(3):
            cell = "".join(draw.choice(letters) for _ in range(draw.randrange(8)))
            kind = draw.random()
            if kind < 0.25:
                cell = '"' + "".join(draw.choice(['x', ',', '\n', '""', 'é', '\r\n']) for _ in range(draw.randrange(6))) + '"'
            elif kind < 0.35:
                cell += '5" pipe'
            elif kind < 0.4:
                cell = '"closed"tail"'
            cells.append(cell)
        out.append(",".join(cells) if draw.random() > 0.05 else "")
    return "\r\n".join(out) + draw.choice(["", "\n", "\r\n"])


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_split_files_equal_the_standard_reader(spark, tmp_path, small_splits):
    files = {
        "messy one.csv": _messy(1, 400).encode(), "messy+two.csv": _messy(2, 300).encode("utf-8-sig"), "old.csv": _messy(3, 200).encode("cp1252"),
        "older.csv": _messy(3, 60).encode("cp1252") + b"\x81,\x8d,x\r\n", "one.csv": b"a;b;c\n1;2;3", "unclosed.csv": b"a,b\n1,2\n" * 120 + b'3,"open\nfor,ever\n' + b"x,y\n" * 200,
        "blank.csv": b"\n\n\na,b\n\n", "long.csv": b"h,i\n" + b'"' + b"line\n" * 900 + b'",1\nq,2\n', "empty.csv": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = D.read_cells(spark, str(tmp_path), whole_bytes=0)
    got = {}
    for r in rows.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.source_row] = r.cells
    whole = {}
    for r in D.read_cells(spark, str(tmp_path)).collect():
        whole.setdefault(r.file.rsplit("/", 1)[1], {})[r.source_row] = r.cells
    for name, data in files.items():
        want = dict(enumerate(_standard(data), start=1))
        assert whole.get(name, {}) == want, name
        assert got.get(name, {}) == want, name


def test_a_line_is_a_function_of_the_state_before():
    draw = random.Random(4)
    for _ in range(3000):
        line = "".join(draw.choice(['"', '"', ",", "a", " "]) for _ in range(draw.randrange(9)))
        for inside in (False, True):
            rows = list(csv.reader(io.StringIO(('"' if inside else "") + line + "\nNEXT")))
            assert D.ends_quoted(line, ",", inside) == (len(rows) == 1), (line, inside)
