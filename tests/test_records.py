"""Quoted line breaks in files of many splits."""
import csv
import io
import os
import random
from contextlib import contextmanager

import pytest

from tessera.sources import records
from tessera.sources.csv import read_csv, scan_strings


@contextmanager
def small_splits(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(path)


def _table(seed, n, end, longest):
    random.seed(seed)
    rows = []
    for k in range(n):
        note = random.choice(["plain", "", 'say "hi"', "a,b", "é漢", 'x"', '"', '""', ",", f"l1{end}l2", f"{end}{end}", f'q"{end}"q, "', end * random.randint(1, longest)])
        rows.append([str(k), note + "z" * random.randint(0, 12), random.choice(["1.5", "", "t"])])
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["id", "no\nte", "v"], *rows])
    return out.getvalue(), rows


@pytest.mark.parametrize("size, end, longest", [(45, "\n", 2), (200, "\r\n", 2), (45, "\n", 60), (1 << 20, "\r\n", 3)])
def test_records_of_many_splits(spark, tmp_path, size, end, longest):
    text, rows = _table(size + longest, 90, end, longest)
    p = _write(tmp_path / "t.csv", text)
    with small_splits(spark, size):
        df = scan_strings(spark, p)
        assert df.columns == ["id", "no\nte", "v"]
        assert df.rdd.getNumPartitions() > len(text) / max(size, 1024) / 40
        got = sorted((int(r[0]), r[1], r[2]) for r in df.collect())
    want = [(int(a), b if b != "" else None, c or None) for a, b, c in rows]
    assert got == [(a, None if b is None else b, c) for a, b, c in want]


def test_reads_like_the_whole_file_reader(spark, tmp_path):
    """Quotes inside unquoted fields and text behind a closing quote are no openings."""
    text = 'a,b\n1,5" pipe\n2,"x\ny"\n3,6" and 7" too\n4,"say ""hi""\n, there"\n\n5,plain\n   \n6," lead\n"\n7, "not quoted"\n'
    p = _write(tmp_path / "t.csv", text)
    whole = spark.read.option("escape", '"').option("multiLine", True).option("header", True).csv(p)
    want = sorted(tuple(r) for r in whole.collect() if r[0].strip())
    for size in (5, 16, 1 << 20):
        with small_splits(spark, size):
            assert sorted(map(tuple, scan_strings(spark, p).collect())) == want


def test_lone_carriage_returns_end_records(spark, tmp_path):
    p = _write(tmp_path / "t.csv", 'a,b\r1,x\r2,"p\rq"\r3,"s\nt"\r')
    with small_splits(spark, 8):
        assert sorted(map(tuple, scan_strings(spark, p).collect())) == [("1", "x"), ("2", "p\rq"), ("3", "s\nt")]


def test_folder_of_files_with_headers_and_types(spark, tmp_path):
    os.mkdir(tmp_path / "d")
    want = []
    for k in range(5):
        body = "".join(f'{100 * k + i},"n{i}\nm",{i / 2}\n' for i in range(40))
        _write(tmp_path / "d" / f"{k}.csv", '"id","no\nte",x\n' + body)
        want += [(100 * k + i, f"n{i}\nm", i / 2) for i in range(40)]
    with small_splits(spark, 64):
        df = read_csv(spark, str(tmp_path / "d"))
        assert [t for _, t in df.dtypes] == ["bigint", "string", "double"]
        assert sorted(map(tuple, df.collect())) == want


def test_too_many_fields_in_a_broken_record(spark, tmp_path):
    p = _write(tmp_path / "t.csv", 'a,b\n1,"x\ny"\n2,"p\nq",3\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        scan_strings(spark, p).collect()


def test_unclosed_quote_and_header_only(spark, tmp_path):
    p = _write(tmp_path / "t.csv", 'a,b\n1,"x\ny"\n2,"open\nto the\nend')
    with small_splits(spark, 9):
        rows = sorted(map(tuple, scan_strings(spark, p).collect()))
    assert rows[0] == ("1", "x\ny") and rows[1][0] == "2" and "to the" in rows[1][1] and len(rows) == 2
    assert scan_strings(spark, _write(tmp_path / "h.csv", '"a\nb",c\n')).count() == 0


def test_no_breaks_keep_the_plain_reader(spark, tmp_path):
    p = _write(tmp_path / "t.csv", 'a,b\n1,"x, y"\n2,5" pipe\n')
    assert not records.find_records(spark, p).breaks
    plan = scan_strings(spark, p)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan csv" in plan


def test_line_automaton_against_a_character_loop():
    def slow(line, inside):
        state = "in" if inside else "start"
        i = 0
        while i < len(line):
            c = line[i]
            if state == "start":
                state = "in" if c == '"' else "start" if c == "," else "plain"
            elif state == "plain":
                state = "start" if c == "," else "plain"
            elif c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "plain"
            i += 1
        return state == "in"

    random.seed(4)
    for _ in range(20_000):
        line = "".join(random.choice('"",ab') for _ in range(random.randint(0, 12)))
        for inside in (False, True):
            assert records.after(line, inside) == slow(line, inside), (line, inside)
