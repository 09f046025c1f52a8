import datetime as dt
import re

from seriesloom.operators.line_quarantine import judged_lines, loaded_lines, rejected_lines, rejection_report
from seriesloom.runtime import table


def brute(line):
    line = (line or "").removesuffix("\r")
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] != '"':
                    text, i = text + line[i], i + 1
                elif line[i + 1 : i + 2] == '"':
                    text, i = text + '"', i + 2
                else:
                    i += 1
                    break
            if line[i : i + 1] not in ("", ","):
                return "quoting"
        else:
            j = line.find(",", i)
            text, i = line[i : len(line) if j < 0 else j], len(line) if j < 0 else j
            if '"' in text:
                return "quoting"
        fields.append(text.strip(" \t"))
        if i >= len(line):
            break
        i += 1
    if len(fields) != 2:
        return "columns"
    day, value = fields
    try:
        if not re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", day):
            return "date"
        dt.date(int(day[:4]), int(day[5:7]), int(day[8:10]))
    except ValueError:
        return "date"
    return None if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", value) else "value"


ODD = [
    None, "", ",", "2000-02-30,1", "2000-02-29,1", '"2000-01-01","1"', '"2000-01-01" ,1', ' "2000-01-01",1', '2000-01-01,"1""2"', '2000-01-01,"', '"', '""', '"",""', '2000-01-01,""',
    "2000-01-01,1\r", "2000-01-01,1\r\r", "2000-01-01T05:00,+1.e5", "2000-01-01,1e", "2000-01-01,.", "2000-01-01,١", "2000-01-01,１", "0000-01-01,1", "2000-13-01,1", "2000-01-01\n,1", "2000-01-01,1\n", '"2000-01-01\n",1',
    "2000-01-01,1_0", "2000-01-01,nan", "2000-01-01,1,2", "x,y", '"2000-01-01","' + "1" * 50_000 + '"', '"' + '""' * 50_000 + '",1', '"' + '""' * 50_000, "," * 50_000, "a" * 100_000, "2000-01-01,\t-5 \t", "﻿2000-01-01,1",
]


def test_odd_lines(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "line_id long, raw_line string")
    got = {r.line_id: r.reason for r in judged_lines(df).collect()}
    assert got == {i: brute(x) for i, x in enumerate(ODD)}


def test_whole_table(spark, sf_dir):
    lines = table(spark, sf_dir.replace("0.001", "0.01"), "series_lines")
    want = {r.line_id: brute(r.raw_line) for r in lines.collect() if (r.line_no or 0) > 1}
    got = {r.line_id: r.reason for r in rejected_lines(lines).collect()}
    assert got == {k: v for k, v in want.items() if v}
    loaded = loaded_lines(lines)
    assert loaded.count() == len(want) - len(got) and loaded.filter("date is null or value is null").count() == 0
    assert rejection_report(lines).agg({"n_lines": "sum"}).first()[0] == len(want)


def test_twice_empty_and_clashing_names(spark):
    cols = "line_id long, line_no int, raw_line string, reason string, salt int, file_name string, date_text string"
    df = spark.createDataFrame([(7, 2, "x", "r", 1, None, "d"), (7, 2, "x", "r", 1, None, "d"), (8, None, "x", "r", 1, None, "d"), (9, 1, "x", "r", 1, "f", "d")], cols)
    assert [tuple(r) for r in rejected_lines(df).collect()] == [(7, "columns")] * 2
    assert rejected_lines(spark.createDataFrame([], cols)).count() == 0
