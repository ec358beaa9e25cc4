"""Merged profiles: parts of a table taken together against the whole, exactly where they are exact and within bounds elsewhere."""

import math
import random
import statistics

from ledgerlens.operators import states

VALUES = "part string, column_name string, value string"


def _rows():
    rng = random.Random(4)
    rows = []
    for k in range(6000):
        part = f"p{k % 7 if k % 3 else 0}"
        rows += [(part, "amount", str(round(rng.gauss(1e6, 5), 3))), (part, "whole", str(rng.randrange(10**9))), (part, "kind", rng.choice("aaabbc") + "x"), (part, "flag", rng.choice(["Yes", "no"]))]
        rows += [(part, "day", f"{rng.randrange(1, 29)}/{rng.randrange(1, 13)}/20{rng.randrange(10, 20)}"), (part, "gaps", rng.choice(["N/A", " ", None, "-", "text here"])), (part, "words", f"w{k}")]
    return rows + [("p9", "empty", None), ("p9", "odd", "NaN"), ("p9", "odd", "Infinity"), ("p9", "odd", "1e400"), ("p8", "one", "5")]


def test_parts_equal_the_whole(spark):
    df = spark.createDataFrame(_rows(), VALUES).repartition(5)
    parts = states.column_states(df, ["part"])
    got = {r.column_name: r for r in states.described(states.merged(parts, []), []).collect()}
    want = {r.column_name: r for r in states.described(states.column_states(df, []), []).collect()}
    assert got.keys() == want.keys() == {"amount", "whole", "kind", "flag", "day", "gaps", "words", "empty", "odd", "one"}
    for name, w in want.items():
        g = got[name]
        for c in ("data_type", "non_null", "n_missing", "missing_pct", "min_value", "max_value", "min_length", "max_length", "avg_length", "first_day", "last_day"):
            assert g[c] == w[c], (name, c)
        for c in ("mean_value", "std_value"):
            assert g[c] == w[c] or math.isclose(g[c], w[c], rel_tol=1e-6, abs_tol=2e-4), (name, c, g[c], w[c])
        if w.distinct_values < TRACKED_EXACT:
            assert (g.distinct_values, g.top) == (w.distinct_values, w.top), name


TRACKED_EXACT = states.TRACKED * 3 // 4


def test_against_python(spark):
    rows = _rows()
    got = {r.column_name: r for r in states.described(states.merged(states.column_states(spark.createDataFrame(rows, VALUES), ["part"]), []), []).collect()}
    amounts = [float(v) for _, c, v in rows if c == "amount"]
    a = got["amount"]
    assert math.isclose(a.mean_value, statistics.fmean(amounts), abs_tol=1e-4) and math.isclose(a.std_value, statistics.stdev(amounts), abs_tol=1e-3)
    rank = sum(x <= a.median_value for x in amounts) / len(amounts)
    assert abs(rank - 0.5) < 0.03 and abs(a.distinct_values / len(set(amounts)) - 1) < 0.06
    assert {k: got[k].data_type for k in got} == {"amount": "float", "whole": "integer", "kind": "categorical", "flag": "boolean", "day": "date", "gaps": "categorical", "words": "text", "empty": "unknown", "odd": "integer", "one": "integer"}
    kinds = [v for _, c, v in rows if c == "kind"]
    assert [(t.value, t.n) for t in got["kind"].top] == sorted(((v, kinds.count(v)) for v in set(kinds)), key=lambda x: -x[1])
    assert got["gaps"].non_null == sum(v == "text here" for _, c, v in rows if c == "gaps") and got["empty"].top == []


def test_stored_states_cost_only_new_parts(spark, tmp_path):
    path = str(tmp_path / "states")
    rows = _rows()
    for part in ("p0", "p1"):
        own = spark.createDataFrame([r for r in rows if r[0] == part], VALUES)
        states.column_states(own, ["part"]).write.mode("append").parquet(path)
    both = states.described(states.merged(spark.read.parquet(path), []), [])
    assert {r.column_name: r.non_null for r in both.collect()}["amount"] == sum(p in ("p0", "p1") for p, c, _ in rows if c == "amount")
    assert states.described(states.merged(states.column_states(spark.createDataFrame([], VALUES), ["part"]), []), []).collect() == []
