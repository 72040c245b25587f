"""Metaphone codes (Philips, 1990) of English words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "AEIOU"


def metaphone(word: str) -> str:
    """The code of one word; characters other than A-Z are left out."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    w = "".join(c for i, c in enumerate(w) if c == "C" or i == 0 or w[i - 1] != c)
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, n, i = [], len(w), 0
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c, before, after = w[i], at(i - 1), at(i + 1)
        code, step = "", 1
        if c in _VOWELS:
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if i == n - 1 and before == "M" else "B"
        elif c == "C":
            if after and after in "IEY":
                if before == "S":
                    code = ""
                else:
                    code = "X" if w[i : i + 3] == "CIA" else "S"
            elif after == "H":
                code, step = ("K" if before == "S" else "X"), 2
            else:
                code = "K"
        elif c == "D":
            if after == "G" and at(i + 2) and at(i + 2) in "EYI":
                code, step = "J", 2
            else:
                code = "T"
        elif c == "G":
            if after == "H" and not (i + 2 < n and at(i + 2) in _VOWELS):
                code = "" if i + 2 < n or i > 0 else "K"
                step = 2
            elif after == "N" and (i + 2 == n or w[i:] == "GNED"):
                code = ""
            elif after and after in "IEY" and before != "G":
                code = "J"
            else:
                code = "K"
        elif c == "H":
            code = "H" if after and after in _VOWELS and before not in ("C", "S", "P", "T", "G") else ""
        elif c == "K":
            code = "" if before == "C" else "K"
        elif c == "P":
            code, step = ("F", 2) if after == "H" else ("P", 1)
        elif c == "Q":
            code = "K"
        elif c == "S":
            if after == "H":
                code, step = "X", 2
            elif w[i : i + 3] in ("SIO", "SIA"):
                code = "X"
            else:
                code = "S"
        elif c == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                code = "X"
            elif after == "H":
                code, step = "0", 2
            elif w[i : i + 3] == "TCH":
                code = ""
            else:
                code = "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if after and after in _VOWELS else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        else:  # F J L M N R
            code = c
        out.append(code)
        i += step
    return "".join(out)


def phonetic_tokens(c: Column, words: int = 5) -> Column:
    """Codes of the first words, joined by blanks; ``EMPTY`` if nothing is left."""

    @F.pandas_udf("string")
    def codes(s: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(text):
            got = [known.setdefault(w, metaphone(w)) for w in (text or "").split()[:words]]
            return " ".join(x for x in got if x) or "EMPTY"

        return s.map(one)

    return codes(c)
