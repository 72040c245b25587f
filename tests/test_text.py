import pytest
from pyspark.sql import functions as F

from tether.functions.address import PARTS, address_key, completeness, parse_address, states_agree
from tether.functions.phonetic import metaphone
from tether.functions.text import char_ngrams, normalize_name, title_case

NAMES = {
    "Crystal Clean LLC": "crystal clean",
    "Crystal-Clean Inc.": "crystal clean",
    "Midwest Waste Services": "midwest waste services",
    "A+ Auto Rpr & Trk Svc, Inc.": "a and automotive repair and truck service",
    "Smith Co. dba Joe's Diner": "joe s diner",
    "X Corp d/b/a  Y Mfg": "y manufacturing",
    "Foo f k a Bar a/k/a Baz": "bar a k a baz",
    "Acme 12": "acme",
    "Acme 12.": "acme 12",
    "Acme 12 Inc": "acme 12",
    "Acme (old) LLC #7": "acme",
    "AT&T": "at and t",
    "et al Partners": "partners",
    "Natl Dist Ctrs USA": "national distribution centers",
    "dba ": "",
    "": "",
    "9 Lives 9": "9 lives",
    "small_ring 3": "small_ring",
    "Customer#000000001": "customer",
    "Café Münch GmbH": "café münch gmbh",
    "ÉTION dans": "étion dans",
}


def test_normalize(spark):
    df = spark.createDataFrame([(k,) for k in NAMES] + [(None,)], "x string")
    got = {r["x"]: r["y"] for r in df.select("x", normalize_name(F.col("x")).alias("y")).collect()}
    assert got == NAMES | {None: ""}


def test_normalize_twice_changes_nothing_more(spark):
    df = spark.createDataFrame([(v,) for v in NAMES.values() if not v.startswith("at and") and "12" not in v and "a k a" not in v], "x string")
    rows = df.select("x", normalize_name(F.col("x")).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in rows)


def test_title_case(spark):
    df = spark.createDataFrame([("joe's a-b cafe 3rd x_y",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(title_case(F.col("x"))).collect()] == ["Joe'S A-B Cafe 3Rd X_Y", "", None]


def test_ngrams(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",)], "x string")
    assert [sorted(r[0]) for r in df.select(char_ngrams(F.col("x"))).collect()] == [["abc", "abcd", "bcd"], [], []]


def test_address_key_and_points(spark):
    rows = [
        ("123", "Main  Street", "Rockford", "IL", "61101", "123 main street rockford il 61101", 6),
        ("123", "", "Rockford", "IL", "61101", "123 rockford il 61101", 4),
        (None, "Main Street", None, None, None, "main street", 2),
        ("123", "Main Street", "Rockford", "Illinois", "6110", "123 main street rockford illinois 6110", 4),
        (None, None, None, None, None, "", 0),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{p} string" for p in PARTS) + ", k string, n int")
    for r in df.select("k", "n", address_key().alias("k2"), completeness().alias("n2")).collect():
        assert (r["k"], r["n"]) == (r["k2"], r["n2"])


@pytest.mark.parametrize(
    "line, parts",
    [
        ("123 Main St, Rockford IL 61101", ("123", "main street", "rockford", "IL", "61101")),
        ("456 Oak Avenue, Hoffman Estates IL", ("456", "oak avenue", "hoffman estates", "IL", "")),
        ("PO Box 12, Rockford, IL 61101-1234", ("", "po box 12", "rockford", "IL", "61101")),
        ("", (None,) * 5),
        (None, (None,) * 5),
    ],
)
def test_parse_address(spark, line, parts):
    df = spark.createDataFrame([(line,)], "x string")
    assert tuple(parse_address(df, F.col("x")).select(*PARTS).first()) == parts


def test_states(spark):
    df = spark.createDataFrame([("IL", "IL", True), ("IL", None, True), ("IL", "WI", True), ("WI", "IL", True), ("IL", "MO", False), ("", "IL", False)], "a string, b string, ok boolean")
    for r in df.select("ok", states_agree(F.col("a"), F.col("b"), (("WI", "IL"),)).alias("got")).collect():
        assert r["ok"] == r["got"]


def test_metaphone():
    assert [metaphone(w) for w in ("knight", "phone", "Thomas", "which", "xavier", "school", "")] == ["NT", "FN", "0MS", "WX", "SFR", "SKL", ""]
