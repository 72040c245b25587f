"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of 0 to 3 bytes with the counts of the bytes that followed. The cost of a
byte is its code length when coded from the longest context that the tree knows, with escapes to shorter ones
(method C: a context of n symbols in t trials escapes with n / (t + n)), down to the uniform 1/256. The counts are
frozen after learning, so a text's code length is an exact sum over its 4-byte windows; windows over the commonest
byte pairs are looked up in a table made from the trees, all others are priced from the trees themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tether.llm.kernels import LOWER, chunks, texts_of

ORDER = 3
#: Byte pairs with a place in the table of 4-byte windows.
PAIRS = 768


@dataclass(frozen=True)
class ContextTrees:
    """Frozen counts of one language: by order, sorted keys (context and byte) with counts, contexts with totals."""

    lang: str
    keys: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    totals: tuple[np.ndarray, ...]
    kinds: tuple[np.ndarray, ...]

    def bits(self, window: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code lengths in bits of the last byte of 4-byte windows, given the ``order`` bytes before it."""
        out = np.zeros(len(window))
        todo = np.arange(len(window))
        for k in range(order, -1, -1):
            key = window[todo] & np.uint32((1 << 8 * (k + 1)) - 1)
            context = key >> np.uint32(8)
            at = np.searchsorted(self.contexts[k], context)
            at[at == len(self.contexts[k])] = 0
            known = self.contexts[k][at] == context if len(self.contexts[k]) else np.zeros(len(todo), bool)
            if known.any():
                total, kinds = self.totals[k][at[known]], self.kinds[k][at[known]]
                spot = np.searchsorted(self.keys[k], key[known])
                spot[spot == len(self.keys[k])] = 0
                seen = self.keys[k][spot] == key[known]
                out[todo[known]] += np.log2(total + kinds) - np.log2(np.where(seen, self.counts[k][spot], kinds))
                done = np.zeros(len(todo), bool)
                done[np.flatnonzero(known)[seen]] = True
                todo = todo[~done]
            if not len(todo):
                return out
        out[todo] += 8.0
        return out


def windows(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the 32-bit number of it and the three before; bytes before a text's start count as 32."""
    pad = np.full(len(buf) + ORDER, 32, np.uint32)
    pad[ORDER:] = LOWER[buf]
    out = pad[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= pad[ORDER - k : len(pad) - k] << np.uint32(8 * k)
    for k in range(ORDER):  # the first bytes of a text see no other text
        at = offsets[:-1] + k
        at = at[at < offsets[1:]]
        keep = np.uint32((1 << 8 * (k + 1)) - 1)
        blank = np.uint32(0x20202020) & ~keep
        out[at] = (out[at] & keep) | blank
    return out


def count_windows(batches):
    """Arrow batches (lang, text) to (lang, window, n), summed within each batch."""
    for batch in batches:
        lang = batch.column(0)
        for name in pc.unique(lang).to_pylist():
            own = batch.column(1).filter(pc.equal(lang, name))
            found, counts = [], []
            for _, _, b, o in chunks(*texts_of(own)):
                w, n = np.unique(windows(b, o), return_counts=True)
                found.append(w)
                counts.append(n)
            if not found:
                continue
            w, at = np.unique(np.concatenate(found), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(w)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(w), pa.string()), pa.array(w.astype(np.int64)), pa.array(n)], ["lang", "window", "n"])


def tree(lang: str, window: np.ndarray, n: np.ndarray) -> ContextTrees:
    keys, counts, contexts, totals, kinds = [], [], [], [], []
    for k in range(ORDER + 1):
        key, at = np.unique(window & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(at, n, len(key))
        ctx, where = np.unique(key >> np.uint32(8), return_inverse=True)
        keys.append(key)
        counts.append(c)
        contexts.append(ctx)
        totals.append(np.bincount(where, c, len(ctx)))
        kinds.append(np.bincount(where, minlength=len(ctx)).astype(float))
    return ContextTrees(lang, tuple(keys), tuple(counts), tuple(contexts), tuple(totals), tuple(kinds))


def learn(labelled: DataFrame, rows_per_lang: int = 1500) -> list[ContextTrees]:
    """Trees from a bounded sample: about ``rows_per_lang`` rows of ``labelled(doc_id, lang, text)`` a language.

    The sample is taken by a hash of doc_id with a rate for each language, so that it does not depend on the order of
    rows. Rows with a null lang or text are left out. No labelled rows give no trees.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_lang / n))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    taken = rows.where(u < rate[F.col("lang")]).select("lang", "text")
    counts = taken.mapInArrow(count_windows, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    out = []
    for name in sorted(sizes):
        own = table.filter(pc.equal(table["lang"], name))
        if own.num_rows:
            out.append(tree(name, own["window"].to_numpy().astype(np.uint32), own["n"].to_numpy().astype(float)))
    return out


class Pricer:
    """Sums of code lengths of whole texts under several trees."""

    def __init__(self, trees: list[ContextTrees], pairs: int = PAIRS):
        self.trees = trees
        both = np.zeros(65536)
        for t in trees:
            both += np.bincount((t.keys[1] & np.uint32(0xFFFF)).astype(np.int64), t.counts[1] / t.counts[1].sum(), 65536)
        common = np.argsort(-both, kind="stable")[:pairs]
        common = np.sort(common[both[common] > 0])
        self.m = len(common)
        self.ids = np.full(65536, self.m, np.int32)
        self.ids[common] = np.arange(self.m)
        self.table = np.zeros(((self.m + 1) ** 2, len(trees)), np.float32)
        step = self.m + 1
        for i, first in enumerate(common.tolist()):
            fits = np.flatnonzero(common >= 0)
            w = (np.uint32(first) << np.uint32(16)) | common[fits].astype(np.uint32)
            for j, t in enumerate(trees):
                self.table[i * step + fits, j] = t.bits(w)

    def bits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) under each tree (columns)."""
        out = np.zeros((len(offsets) - 1, len(self.trees)))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return out
        w = windows(buf, offsets)
        hi, lo = self.ids[w >> np.uint32(16)], self.ids[w & np.uint32(0xFFFF)]
        rare = np.flatnonzero((hi == self.m) | (lo == self.m))
        cost = self.table[hi * np.int32(self.m + 1) + lo].astype(np.float64)
        if len(rare):
            some, at = np.unique(w[rare], return_inverse=True)
            for j, t in enumerate(self.trees):
                cost[rare, j] = t.bits(some)[at]
        out[full] = np.add.reduceat(cost, offsets[full], axis=0)
        return out


def identify(docs: DataFrame, trees: list[ContextTrees]) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the posterior of the best language under equal priors) to ``docs(text, ...)``.

    Null and empty texts and texts without a letter get ``und`` and 0.0, as does every text when there are no trees.
    Ties go to the first language by name. Other columns stay as they are; a lang_pred or score column is replaced.
    """
    names = [t.lang for t in trees]
    made: list[Pricer] = []

    def score(batches):
        if not made and trees:
            made.append(Pricer(trees))
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            pred = np.full(len(text), "und", object)
            post = np.zeros(len(text))
            if trees:
                for i, j, b, o in chunks(*texts_of(text), limit=1 << 18):
                    bits = made[0].bits(b, o)
                    best = bits.argmin(axis=1)
                    gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
                    pred[i:j] = np.array(names, object)[best]
                    post[i:j] = 1.0 / np.exp2(-gap).sum(axis=1)
                pred[~lettered] = "und"
                post[~lettered] = 0.0
            keep = [k for k, f in enumerate(batch.schema) if f.name not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(pred, pa.string()), pa.array(post)],
                [*(batch.schema.names[k] for k in keep), "lang_pred", "score"],
            )

    fields = [f"`{c}` {t}" for c, t in docs.dtypes if c not in ("lang_pred", "score")]
    return docs.mapInArrow(score, ", ".join([*fields, "lang_pred string", "score double"]))


def is_held_out(modulus: int, remainder: int):
    """Whether crc32 of doc_id as text leaves ``remainder``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
