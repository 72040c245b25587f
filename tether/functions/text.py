"""Column expressions over names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tether.config import Normalization

ALSO_KNOWN = r"(?:\s|^)(?:d(?:/|\s)?b(?:/|\s)?a|f(?:/|\s)?k(?:/|\s)?a|a(?:/|\s)?k(?:/|\s)?a)\s+(.*)"
#: Runs of letters and of other characters, for title case.
RUNS = r"(\p{L}+|[^\p{L}]+)"


def text(c: Column) -> Column:
    """The value as a string, null as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space trimmed at both ends and single inside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_name(c: Column, rules: Normalization | None = None) -> Column:
    """Lower case; & and + as words; without parentheses, legal forms, marks and a last number; known words replaced.

    What follows a d/b/a, f/k/a or a/k/a stands for the whole. The last number goes before blanks are squeezed, so one
    with a mark behind it stays.
    """
    rules = rules or Normalization()
    c = F.lower(text(c))
    c = F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    c = F.regexp_replace(c, r"\([^)]*\)", "")
    c = F.when(F.regexp_like(c, F.lit(ALSO_KNOWN)), F.regexp_extract(c, ALSO_KNOWN, 1)).otherwise(c)
    for old, new in rules.replacements.items():
        c = F.regexp_replace(c, rf"(?U)\b{re.escape(old)}\b", new)
    if rules.suffixes_to_remove:
        c = F.regexp_replace(c, r"(?U)\b(" + "|".join(re.escape(s) for s in rules.suffixes_to_remove) + r")\b", "")
    c = F.regexp_replace(c, r"(?U)[^\w\s]", " ")
    c = F.regexp_replace(c, r"\s+\d+$", "")
    return squeeze(c)


def title_case(c: Column) -> Column:
    """Upper case for each letter that no letter precedes, lower case for the others."""
    runs = F.regexp_extract_all(c, F.lit(RUNS), 1)
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    return F.array_join(F.transform(runs, word), "")


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams of low to high characters, with repeats; texts below ``low`` characters have none."""
    def of(k: int) -> Column:
        n = F.length(c) - (k - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: c.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(k) for k in range(low, high + 1)]))


def size_factor(n: Column) -> Column:
    """ln(1 + n) / ln 11, at most 1."""
    return F.least(F.log1p(n) / F.log1p(F.lit(10.0)), F.lit(1.0))
