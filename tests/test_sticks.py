import random

import pytest

from lithoframe.operators import sticks as k


def lines(spark, text, file="dir/FaultA.txt"):
    return spark.createDataFrame([(file, i, v) for i, v in enumerate(text)], "file string, line_no long, line string")


def found(df):
    """{stick number: (name, [z in order])}"""
    out = {}
    order = "point_id" if "point_id" in df.columns else "line_no"
    for r in sorted(df.collect(), key=lambda r: (r["stick_no"], r[order], r["line_no"])):
        out.setdefault(r["stick_no"], (r["fault_name"], []))[1].append(r["z"])
    return list(out.values())


def model(text):
    """The stick rules read one line at a time."""
    sticks, name, points = [], None, []

    def number(tokens):
        try:
            return [float(t) for t in tokens]
        except ValueError:
            return None

    for line in text:
        tok = line.split()
        if not tok or tok[0][0] in "#!/":
            continue
        fresh = None
        if len(tok) == 2 and tok[0].upper() == "FAULT":
            fresh, xyz = tok[1], None
        elif len(tok) in (3, 4):
            xyz = number(tok[-3:])
            if xyz is None:
                continue
            if len(tok) == 4 and tok[0] != name:
                fresh = tok[0]
            elif name is None:
                fresh = "UNKNOWN"
        else:
            continue
        if fresh is not None:
            sticks.append((name, points))
            name, points = fresh, []
        if xyz:
            points.append(xyz[2])
    return [s for s in [*sticks, (name, points)] if len(s[1]) >= 2]


@pytest.mark.parametrize("block", [3, 7, 100_000])
def test_petrel_matches_sequential_reading(spark, block):
    rng = random.Random(block)
    pool = ["FAULT A", "fault B", "# c", "", "!x", "/y", "A 1 2 {}", "B 1 2 {}", "1 2 {}", "1 2 {}", "A 1 x 3",
            "1 nope 3", "FAULT two words", "1 2", "UNKNOWN 1 2 {}"]
    for _ in range(3):
        text = [rng.choice(pool).format(i) for i in range(120)]
        assert found(k.parse_petrel(lines(spark, text), block)) == model(text)


def test_petrel_basics(spark):
    text = ["# c", "A 1 2 3", "A 1 2 4", "B 1 2 5", "A 1 2 6", "1 2 7", "FAULT C", "1 2 8", "1 2 9"]
    assert found(k.parse_petrel(lines(spark, text))) == [("A", [3, 4]), ("A", [6, 7]), ("C", [8, 9])]


def test_opendtect(spark):
    text = ["1 2 3", "1 2 4", "Fault: Main one ", "1 2 5 10 20", "1 2 6 10 20", "FAULT : x", "1 2 7"]
    assert found(k.parse_opendtect(lines(spark, text), 2)) == [("UNKNOWN", [3, 4]), ("Main one", [5, 6])]


def test_five_columns(spark):
    text = ["1 2 30 0 3", "1 2 10 0 1", "1 2 5 1 0", "1 2 20 0 2.9", "# c", "", "1 2 6 1 1", "1 2 9 7 0", "1 2 nan x 0"]
    assert found(k.parse_five_column(lines(spark, text))) == [("FaultA_stick0", [10, 20, 30]), ("FaultA_stick1", [5, 6])]


def test_index_dat(spark):
    text = ["FAULT a", "10 50 202", "11 51 0 210", "x 1 2", "12 52 218"]
    rows = k.parse_index_dat(lines(spark, text)).orderBy("line_no").collect()
    assert [(r["il"], r["xl"], r["s"]) for r in rows] == [(10, 50, 202), (11, 51, 210), (12, 52, 218)]


def test_viewer_dat(spark):
    rows = k.parse_viewer_dat(lines(spark, ["0 0 5", "# x", "1 2 3 4"])).collect()
    assert [(r["inline"], r["crossline"], r["twt"]) for r in rows] == [(1001, 1900, 20)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        k.parse_viewer_dat(lines(spark, ["1.5 2 3"])).collect()


def test_numbers(spark):
    from pyspark.sql import functions as F

    from lithoframe.functions.numeric import parse_number
    texts = ["1", "-1.5", ".5", "5.", "1e3", "1_0", "+7", "1d", "2f", "0x1p3", "x", "", "nan", "-inf", "1e", "."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(parse_number(F.col("t"))).collect()]
    assert got[:7] == [1, -1.5, 0.5, 5, 1000, 10, 7]
    assert got[7:12] == [None] * 5
    assert got[12] != got[12] and got[13] == float("-inf") and got[14:] == [None, None]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        k.parse_sticks(lines(spark, ["1 2 3"]), "zmap")
