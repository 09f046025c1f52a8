import json

from seriesloom.operators.schema_drift import MAX_COLUMNS, aliases, changes, column_names, file_order, lifespans, long_table, parsed, spans, unified
from seriesloom.runtime import table

COLS = "entry_id long, artifact string, lab string, file_no int, run string, body string, field string, type string"


def kind(v):
    return {bool: "boolean", int: "integer", float: "number", str: "string", list: "list", dict: "object"}[type(v)]


def brute(rows):
    files = {}
    for r in rows:
        try:
            b = json.loads(r.body)
        except (TypeError, ValueError):
            b = {}
        f = files.setdefault((r.artifact, r.lab), {}).setdefault(r.file_no, {})
        if not isinstance(b, dict):
            continue
        flat = {}
        for k, v in b.items():
            flat |= {f"estimates.{a}": c for a, c in v.items()} if k == "estimates" and isinstance(v, dict) else {k: v}
        for k, v in flat.items():
            f.setdefault(k, {})
            if v is not None:
                f[k][r.run] = v
    out = set()
    for (a, lab), by in files.items():
        order = sorted(by)
        for p, n in zip(order, order[1:]):
            old, new = by[p], by[n]
            types = lambda d: {kind(v) for v in d.values()} - ({"integer"} if "number" in {kind(v) for v in d.values()} else set())
            gone, come = set(old) - set(new), set(new) - set(old)
            for g in sorted(gone):
                for c in sorted(come):
                    runs = set(old[g]) & set(new[c])
                    if runs and all(old[g][r] == new[c][r] and (kind(old[g][r]) == "boolean") == (kind(new[c][r]) == "boolean") for r in runs):
                        out.add((a, lab, n, "renamed", c, g))
                        gone.discard(g)
                        come.discard(c)
                        break
            out |= {(a, lab, n, "added", c, c) for c in come} | {(a, lab, n, "removed", g, g) for g in gone}
            out |= {(a, lab, n, "retyped", k, k) for k in set(old) & set(new) if types(old[k]) and types(new[k]) and types(old[k]) != types(new[k])}
    return out


def test_whole_table(spark, sf_dir):
    e = table(spark, sf_dir.replace("0.001", "0.01"), "artifact_entries")
    want = brute(e.collect())
    got = [tuple(r) for r in changes(e).collect()]
    assert set(got) == want and len(got) == len(want) and {c[3] for c in got} == {"added", "removed", "renamed", "retyped"}


def test_small_histories(spark):
    rows, i = [], 0
    for no, bodies in {
        1: ['{"a": 1, "b": 2.5, "c": "x", "estimates": {"p": 1}, "n": null}', '{"a": 2, "b": null, "big": 12345678901234567890}'],
        3: ['{"A": 1.0, "c": 3, "estimates": {"p": 1}, "n": null}', '{"A": 2}', "no json", None],
        4: ['{"A": 1, "c": null, "p": 1, "n": 5}'],
        9: ["[1]"],
    }.items():
        for run, b in enumerate(bodies):
            i += 1
            rows += [(i, "x", "l", no, f"r{run}", b, "f", "t"), (i + 100, "x", "l", no, f"r{run}", b, "f", "t")]
    rows.append((999, None, "l", 1, "r", "{}", "f", "t"))
    e = spark.createDataFrame(rows, COLS)
    got = {tuple(r)[2:] for r in changes(e).collect()}
    assert got == {
        (3, "renamed", "A", "a"), (3, "removed", "b", "b"), (3, "removed", "big", "big"), (3, "retyped", "c", "c"),
        (4, "renamed", "p", "estimates.p"), (4, "retyped", "A", "A"),
        (9, "removed", "A", "A"), (9, "removed", "c", "c"), (9, "removed", "p", "p"), (9, "removed", "n", "n"),
    }
    assert {(r.file_no, r.field): r.canonical for r in aliases(e).collect()}[4, "p"] == "estimates.p"
    wide = unified(e)
    assert wide.count() == len(rows) and dict(wide.dtypes)["f_a"] == "double" and dict(wide.dtypes)["f_c"] == "string"
    assert {r.f_a for r in wide.filter("file_no = 3").collect()} == {1.0, 2.0, None}
    assert "12345678901234567890" in {r.f_big for r in wide.collect()} and dict(wide.dtypes)["f_big"] == "string"  # beyond 64 bits: kept as text
    cat = lifespans(parsed(e), file_order(e))
    assert spans(cat).filter("field = 'c'").count() == 2
    none = spark.createDataFrame([], COLS)
    assert changes(none).count() == 0 and unified(none).count() == 0


def entries(spark, bodies, lab="l"):
    return spark.createDataFrame([(i, "x", lab, no, f"r{r}", b, "f", "t") for i, (no, r, b) in enumerate(bodies)], COLS)


def values(df):
    """(entry, value) of every non-null cell of the wide table."""
    return sorted((r.entry_id, str(v)) for r in df.collect() for c, v in r.asDict().items() if c.startswith("f_") and v is not None)


def test_a_name_used_again_keeps_every_value(spark):
    e = entries(spark, [(1, 0, '{"a": 1}'), (2, 0, '{"b": 1}'), (3, 0, '{"b": 1, "a": 77}'), (4, 0, '{"c": 1, "a": 77}'), (5, 0, '{"c": 1, "d": 77}'), (6, 0, '{"c": 1, "d": 77, "a": 5}')])
    wide = unified(e)
    assert values(wide) == [(0, "1"), (1, "1"), (2, "1"), (2, "77"), (3, "1"), (3, "77"), (4, "1"), (4, "77"), (5, "1"), (5, "5"), (5, "77")]
    assert {c for c in wide.columns if c.startswith("f_")} == {"f_a", "f_a_g2", "f_a_g3"}
    assert [r.f_a for r in wide.orderBy("entry_id").collect()] == [1] * 6


def test_columns_of_like_names_stay_apart(spark):
    e = entries(spark, [(1, 0, '{"estimates_k": 1, "estimates": {"k": 2}, "A": 3, "a": 4, "x": [1, 2.0], "y": "1", "z": 1}'), (1, 1, '{"z": "s", "y": "q\\"q"}')])
    wide = unified(e)
    assert values(wide.select("entry_id", *[c for c in wide.columns if c.startswith("f_")])) == sorted([(0, "1"), (0, "2"), (0, "3"), (0, "4"), (0, "[1,2]"), (0, "1"), (0, "1"), (1, "s"), (1, 'q"q')])
    assert column_names([("a", 1), ("A", 1), ("a", 2)]) == ["f_a", "f_A_2", "f_a_g2"] and MAX_COLUMNS >= 2000


def test_every_value_is_found_again(spark, sf_dir):
    e = table(spark, sf_dir, "artifact_entries")
    n = long_table(e).count()
    wide = unified(e)
    assert n == len(values(wide)) and wide.count() == e.count()
