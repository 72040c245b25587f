"""Column expressions over postal addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tether.functions.text import squeeze, text

PARTS = ("addr_street_number", "addr_street_name", "addr_city", "addr_state", "addr_zip")

# Words that end a street's name, and what they become.
STREET_WORDS = {
    "st": "street", "street": "street", "ave": "avenue", "avenue": "avenue", "rd": "road", "road": "road", "dr": "drive",
    "drive": "drive", "blvd": "boulevard", "boulevard": "boulevard", "ln": "lane", "lane": "lane", "ct": "court",
    "court": "court", "hwy": "highway", "highway": "highway", "pkwy": "parkway", "parkway": "parkway", "way": "way", "pl": "place", "place": "place",
}


def address_key(parts: list[Column] | None = None) -> Column:
    """The five parts in lower case with single blanks; null counts as ''."""
    return squeeze(F.lower(F.concat_ws(" ", *[text(c) for c in parts or [F.col(p) for p in PARTS]])))


def completeness() -> Column:
    """Points for an address: street name 2; number, city, two-letter state and five-digit zip 1 each."""
    number, name, city, state, zip_ = (F.col(p) for p in PARTS)
    has = lambda c: F.coalesce(c != "", F.lit(False)).cast("int")
    two = F.coalesce(F.length(state) == 2, F.lit(False)).cast("int")
    digits = F.coalesce(zip_.rlike("^[0-9]{5}$"), F.lit(False)).cast("int")
    return has(name) * 2 + has(number) + has(city) + two + digits


def states_agree(a: Column, b: Column, neighbors: tuple[tuple[str, str], ...] = ()) -> Column:
    """Equal states, a missing one, or a pair that is allowed in either order."""
    ok = (a == b) | a.isNull() | b.isNull()
    if neighbors:
        pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
        ok = ok | pair.isin(*["|".join(sorted(p)) for p in neighbors])
    return F.coalesce(ok, F.lit(True))


def parse_address(df: DataFrame, line: Column, names: tuple[str, ...] = PARTS) -> DataFrame:
    """``df`` with the five parts of a line: ``[PO BOX n | number] street word, city, ST zip``.

    A street's name runs to its last known street word, which is written out; the rest before state and zip is the
    city. The state is upper case and the zip five characters. A null or blank line gives nulls in all parts; a part
    that is not found is ''.
    """
    words = "|".join(STREET_WORDS)
    short = [w for w in STREET_WORDS if len(w) == 2]
    table = F.create_map(*[F.lit(x) for kv in STREET_WORDS.items() for x in kv])
    c = F.col
    steps = (
        ("_line", squeeze(F.regexp_replace(F.lower(text(line)), r"[^\w\s#-]", " "))),
        ("_zip", F.regexp_extract("_line", r"(?:^|\s)(\d{5})(?:-\d{4})?$", 1)),
        ("_rest", F.trim(F.regexp_replace("_line", r"(?:^|\s)\d{5}(?:-\d{4})?$", ""))),
        ("_state", F.regexp_extract("_rest", r"(?:^|\s)([a-z]{2})$", 1)),
        ("_state", F.when(c("_state").isin(*short), F.lit("")).otherwise(c("_state"))),
        ("_rest", F.when(c("_state") != "", F.trim(F.regexp_replace("_rest", r"(?:^|\s)[a-z]{2}$", ""))).otherwise(c("_rest"))),
        ("_box", F.regexp_extract("_rest", r"^p\s?o\s+box\s+(\w+)", 1)),
        ("_number", F.regexp_extract("_rest", r"^(\d+[a-z]?)(?:\s|$)", 1)),
        ("_rest", F.trim(F.regexp_replace("_rest", r"^p\s?o\s+box\s+\w+|^\d+[a-z]?(?:\s|$)", ""))),
        ("_street", F.regexp_extract("_rest", rf"^(.*\b(?:{words}))(?:\s|$)", 1)),
        ("_city", F.when(c("_street") != "", F.trim(c("_rest").substr(F.length("_street") + 1, F.length("_rest")))).otherwise(c("_rest"))),
        ("_last", F.element_at(F.split("_street", " "), -1)),
        ("_street", F.when(c("_street") != "", F.concat(c("_street").substr(F.lit(1), F.length("_street") - F.length("_last")), F.element_at(table, c("_last")))).otherwise(F.lit(""))),
    )
    for name, value in steps:
        df = df.withColumn(name, value)
    box = c("_box") != ""
    values = (F.when(box, F.lit("")).otherwise(c("_number")), F.when(box, F.concat(F.lit("po box "), "_box")).otherwise(c("_street")), c("_city"), F.upper("_state"), c("_zip"))
    for name, value in zip(names, values):
        df = df.withColumn(name, F.when(c("_line") != "", value))
    return df.drop("_line", "_zip", "_rest", "_state", "_box", "_number", "_street", "_city", "_last")
