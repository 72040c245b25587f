"""Edit-aware token counts over pre-token segment trees.

Byte-level BPE never merges across pre-tokens, so a document's count is the sum over its pre-tokens. A tree over them
holds the sums of counts and of characters. A match of the pre-token pattern depends on its own characters and at most
two after it, and on nothing before it. An edit therefore re-encodes from the first pre-token that ends at most one
character before it, until a new boundary past the edit falls on an old one; only these leaves and their ancestors change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tether.llm.tokens import PATTERN, SPECIAL, Encoder

_pattern = regex.compile(PATTERN)
#: Distinct pre-tokens whose counts a worker remembers; it forgets all when full.
MEMORY = 400_000


class Counter:
    """Tokens of one pre-token, remembered within bounds."""

    def __init__(self, files: tuple[str, str] | None = None):
        self.encoder = Encoder(files)
        self.known: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        out, known = [], self.known
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= MEMORY:
                    known.clear()
                n = self.encoder.pretoken_size(p)
                if len(p) <= 64:
                    known[p] = n
            out.append(n)
        return out


def split(text: str) -> list[str]:
    """Pre-tokens; the special token's string is one of its own."""
    if SPECIAL not in text:
        return _pattern.findall(text)
    out = []
    for k, part in enumerate(text.split(SPECIAL)):
        out += [SPECIAL] * bool(k) + _pattern.findall(part)
    return out


class SegmentTree:
    """Sums over leaves of (tokens, characters); level 0 is the leaves and the last level the root."""

    def __init__(self, tokens: list[int], chars: list[int]):
        leaves = np.array([tokens, chars], np.int64).reshape(2, -1)
        self.levels = [leaves]
        while self.levels[-1].shape[1] > 1:
            x = self.levels[-1]
            if x.shape[1] % 2:
                x = np.concatenate([x, np.zeros((2, 1), np.int64)], axis=1)
                self.levels[-1] = x
            self.levels.append(x[:, 0::2] + x[:, 1::2])

    @property
    def total(self) -> int:
        return int(self.levels[-1][0].sum())

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; past the end, the last leaf."""
        at, begin = 0, 0
        for x in reversed(self.levels[:-1]):
            at *= 2
            if char >= begin + x[1, at] and x[1, at + 1]:
                begin += int(x[1, at])
                at += 1
        return at, begin

    def put(self, first: int, last: int, tokens: int, chars: int) -> None:
        """Leaf ``first`` takes these sums, the leaves after it up to ``last`` become empty."""
        self.levels[0][:, first : last + 1] = 0
        self.levels[0][:, first] = tokens, chars
        for low, high in zip(self.levels, self.levels[1:]):
            first, last = first // 2, last // 2
            high[:, first : last + 1] = low[:, 2 * first : 2 * last + 2 : 2] + low[:, 2 * first + 1 : 2 * last + 2 : 2]


def apply_edits(text: str, edits: list[tuple[int, int, str]], count: Counter) -> tuple[int, int, int, str]:
    """(tokens before, tokens after, pre-tokens encoded anew, edited text).

    ``edits`` are (position, characters removed, text put there) in the old text's characters; they are cut to the
    text, taken from the last to the first, and one that reaches into a later one is cut where that begins.
    """
    pieces = split(text)
    tree = SegmentTree(count(pieces), [len(p) for p in pieces])
    before, fresh, limit = tree.total if pieces else 0, 0, len(text)
    for pos, gone, put in sorted(edits, key=lambda e: e[0], reverse=True):
        pos = max(0, min(pos, limit))
        end = max(pos, min(pos + gone, limit))
        limit = pos
        special = SPECIAL in text
        text = text[:pos] + put + text[end:]
        if special or SPECIAL in text or not pieces:  # the special string may span any number of pre-tokens
            pieces = split(text)
            tree = SegmentTree(count(pieces), [len(p) for p in pieces])
            fresh += len(pieces)
            continue
        first, begin = tree.find(max(0, pos - 2))
        edge, shift, new, stop, leaf = pos + len(put), len(put) - (end - pos), [], begin, first
        old = begin + int(tree.levels[0][1, leaf])
        n = tree.levels[0].shape[1]
        # the old boundary after each leaf, until a new one falls on it
        for m in _pattern.finditer(text, begin):
            new.append(m.group())
            stop = m.end()
            while leaf + 1 < n and old + shift < stop:
                leaf += 1
                old += int(tree.levels[0][1, leaf])
            if stop >= edge and old >= end and old + shift == stop:
                break
        else:
            leaf, stop = n - 1, len(text)
        tree.put(first, leaf, sum(count(new)), stop - begin)
        fresh += len(new)
    return before, tree.total if text else 0, fresh, text


def recount(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_edited, n_edits, n_pretokens_encoded`` of ``docs(doc_id, text, edits, ...)``.

    ``edits`` is array<struct<pos: int, gone: int, put: string>> in characters; null is none. A null text is empty.
    One row for each input row; other columns are not read.
    """

    def run(batches):
        count = Counter(files)
        for batch in batches:
            rows = []
            for doc, text, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                edits = [(e["pos"], e["gone"], e["put"] or "") for e in edits or []]
                before, after, fresh, _ = apply_edits(text.as_py() or "", edits, count)
                rows.append((doc, before, after, len(edits), fresh))
            cols = [list(c) for c in zip(*rows)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_pretokens_encoded"])

    return docs.select(F.col("doc_id").cast("long"), "text", "edits").mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_pretokens_encoded long")
