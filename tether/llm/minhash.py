"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Equal shingle sets are one class; only one document of a class goes on.
2. Each class has ``bands * rows`` minima; classes that agree on all rows of a band share a bucket. At similarity 0.75
   the chance to share none of 40 buckets of 5 rows is 2e-5.
3. Signatures (8 bits a minimum) are compared batch by batch. With a uniform prior, m matches among n give a Beta
   posterior of the match rate; a pair goes when P(similarity >= threshold | m, n) is below ``miss``.
4. Survivors are confirmed on full shingle sets.

A bucket is never expanded into all its pairs. First every member is compared with the bucket's most connected one,
which shares most with all the others and so finds the original that many copies were made from. Only members that the
confirmed links leave in different components are then compared with each other: in a bucket of a few members pair by
pair, in a larger one by what sets each member apart from one reference document (see ``alike_beside``), which gives
every pair that can link and no others of copies that only the reference makes alike. The first batches of the
signature travel with the members, so that a join keeps only the pairs that these leave possible.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tether.llm.kernels import CHUNK_BYTES, chunks, mix, shingle_sets, texts_of
from tether.llm.skew import join_counted
from tether.operators.graph import connected_components
from tether.runtime.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    width: int = 5
    numerator: int = 75
    denominator: int = 100
    bands: int = 40
    rows: int = 5
    batch: int = 25
    miss: float = 1e-6
    #: 64-bit words of the signature, 8 minima each, that the bucket joins compare.
    head: int = 5
    #: Members of a bucket up to which its pairs are made as they are: at most half as many a member.
    few: int = 8

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def signature(items: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the items, as the upper 32 bits."""
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 1024):
        h = np.multiply.outer(mul, items[i : i + 1024])
        h += add[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return low >> np.uint64(32)


def least_matches(n: int, s: Settings) -> int:
    """Fewest matches among n 8-bit minima that leave the posterior chance of the threshold at ``miss`` or more.

    P(rate >= t | m of n) under a uniform prior is the chance of at most m successes in n + 1 trials of rate t.
    """
    t = s.numerator / s.denominator
    t += (1 - t) / 256
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= s.miss:
            return m
    return n


def sign(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, 8-bit minima and band keys of each row of docs(doc_id, text)."""

    def run(batches):
        mul, add = seeds(s.hashes)
        salt = mix(np.arange(1, s.bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for batch in batches:
            ids, n, d1, d2, sig, keys, heads = batch.column(0).to_pylist(), [], [], [], [], [], []
            for i, _, b, o in chunks(*texts_of(batch.column(1))):
                for k, items in enumerate(shingle_sets(b, o, s.width)):
                    n.append(len(items))
                    if not len(items):
                        d1.append(0)
                        d2.append(ids[i + k] or 0)
                        sig.append(b"")
                        keys.append(np.zeros(0, np.int64))
                        heads.append(np.zeros(s.head, np.int64))
                        continue
                    d1.append(int(items.sum(dtype=np.uint64).astype(np.int64)))
                    d2.append(int(mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    low = signature(items, mul, add)
                    sig.append(low.astype(np.uint8).tobytes())
                    heads.append(np.frombuffer(sig[-1], np.int64, s.head))
                    acc = salt.copy()
                    for row in low.reshape(s.bands, s.rows).T:
                        acc = mix(acc ^ row)
                    keys.append(acc.view(np.int64))
            sizes = np.array([0, *map(len, keys)]).cumsum().astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), *(pa.array(c) for c in np.array(heads, np.int64).reshape(-1, s.head).T)],
                ["doc_id", "n_shingles", "d1", "d2", "sig", "bands", *heads_of(s)],
            )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>, " + ", ".join(f"{c} long" for c in heads_of(s))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def heads_of(s: Settings, prefix: str = "h") -> list[str]:
    return [f"{prefix}{k}" for k in range(s.head)]


def possible(s: Settings, x: str, y: str) -> Column:
    """Whether the words ``x0, x1, ...`` and ``y0, y1, ...`` agree in as many minima as the posterior asks for."""
    missed = F.lit(0)
    for a, b in zip(heads_of(s, x), heads_of(s, y)):
        d = F.col(a).bitwiseXOR(F.col(b))
        for shift in (4, 2, 1):  # the lowest bit of each byte becomes whether any of its bits differs
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        missed = missed + F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return missed <= 8 * s.head - least_matches(8 * s.head, s)


def prune(pairs: DataFrame, sigs: DataFrame, s: Settings) -> DataFrame:
    """(a, b, matches) of the pairs that no batch of the signature rules out."""

    def run(batches):
        stops = [*range(s.batch, s.hashes, s.batch), s.hashes]
        least = [least_matches(n, s) for n in stops]
        for batch in batches:
            x, y = (np.frombuffer(texts_of(batch.column(k))[0], np.uint8).reshape(-1, s.hashes) for k in (2, 3))
            alive, found, begin = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, m in zip(stops, least):
                found[alive] += (x[alive, begin:n] == y[alive, begin:n]).sum(axis=1)
                alive = alive[found[alive] >= m]
                begin = n
            left = batch.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([left.column(0), left.column(1), pa.array(found[alive])], ["a", "b", "matches"])

    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long, matches long")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, z) of ``docs(doc_id, text)``: the text compressed, as it is shuffled more than once."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            z = [press.compress(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])

    return docs.mapInArrow(run, "doc_id long, z binary")


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each compressed text, of which about ``CHUNK_BYTES`` are open at once."""
    press = zstandard.ZstdDecompressor()
    parts, held = [], 0

    def close():
        data = np.frombuffer(b"".join(parts), np.uint8)
        yield from shingle_sets(data, np.array([0, *map(len, parts)]).cumsum(), width)

    for z in column:
        text = press.decompress(z.as_py())
        if parts and held + len(text) > CHUNK_BYTES:
            yield from close()
            parts, held = [], 0
        parts.append(text)
        held += len(text)
    if parts:
        yield from close()


def verify(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(src, dst) of the pairs (a, b) whose full shingle sets reach the similarity."""

    def run(batches):
        for batch in batches:
            a, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            left = dict(zip(a.tolist(), sets_of(batch.column(2).take(pa.array(at)), s.width)))
            src, dst, ids = [], [], zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for (i, j), y in zip(ids, sets_of(batch.column(3), s.width)):
                x = left[i]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and s.denominator * both >= s.numerator * (len(x) + len(y) - both):
                    src.append(i)
                    dst.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, "src long, dst long")


def deltas(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(c, x, nc, nx, linked, items) of the pairs (c, x): both set sizes, whether they link, and the shingles of only one."""

    def run(batches):
        for batch in batches:
            c, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            left = dict(zip(c.tolist(), sets_of(batch.column(2).take(pa.array(at)), s.width)))
            nc, nx, linked, items = [], [], [], []
            for i, y in zip(batch.column(0).to_pylist(), sets_of(batch.column(3), s.width)):
                x = left[i]
                apart = np.setxor1d(x, y, assume_unique=True)
                whole = len(x) + len(y)
                nc.append(len(x))
                nx.append(len(y))
                # with the sum of sizes w and h shingles in only one, the similarity is (w - h) / (w + h)
                linked.append(s.denominator * (whole - len(apart)) >= s.numerator * (whole + len(apart)))
                items.append(apart.view(np.int64))
            ends = np.array([0, *map(len, items)]).cumsum().astype(np.int32)
            flat = np.concatenate(items) if items else np.zeros(0, np.int64)
            cols = [batch.column(0), batch.column(1), pa.array(nc, pa.int64()), pa.array(nx, pa.int64()), pa.array(linked, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, ["c", "x", "nc", "nx", "linked", "items"])

    left = texts.select(F.col("doc_id").alias("c"), F.col("z").alias("zc"))
    right = texts.select(F.col("doc_id").alias("x"), F.col("z").alias("zx"))
    both = pairs.join(left, "c").join(right, "x").select("c", "x", "zc", "zx")
    return both.mapInArrow(run, "c long, x long, nc long, nx long, linked boolean, items array<long>")


def alike_beside(apart: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of documents with one reference c that may link, from what sets them apart from c.

    Let D(x) be the shingles that only one of x and c has. a and b link just if at most (|a| + |b|) (1 - t) / (1 + t)
    shingles are in only one of them, which is |D(a)| + |D(b)| - 2 |D(a) & D(b)|; so D(a) and D(b) must share at
    least (f(a) + f(b)) / 2 with f(x) = |D(x)| - |x| (1 - t) / (1 + t). Of D(x) only the shingles that some other D
    has too count, from the rarest on: a shared one that leaves fewer behind it than must be shared makes no pair.
    Independent edits share next to nothing, so a group of many copies gives a few pairs a document.
    """
    k = (s.denominator - s.numerator) / (s.denominator + s.numerator)
    # all that only the bound needs is taken a little loosely, for the rounding
    f = F.size("items") - F.col("nx") * F.lit(k)
    # least f of a partner: it is in reach of x, has no negative |D|, and does not link with c where x does
    most = F.col("nx") * F.lit(s.denominator / s.numerator)
    other = F.greatest(f - 2 * F.lit(k) * most, -F.lit(k) * most)
    other = F.when(F.col("linked"), F.greatest(other, F.lit(k) * F.col("nc"))).otherwise(other)
    each = apart.where(F.col("x") != F.col("c")).select("c", "x", "linked", f.alias("f"), ((f + other) / 2 - 1e-6).alias("least"), F.explode("items").alias("item"))
    often = each.groupBy("c", "item").agg(F.count("*").alias("n")).where("n > 1")
    left = F.row_number().over(Window.partitionBy("c", "x").orderBy(F.desc("n"), "item"))
    rare = each.join(often, ["c", "item"]).withColumn("left", left).where("left >= least").drop("n", "least")
    rare = rare.join(groups.select(F.col("vertex").alias("x"), F.col("component_id").alias("g")), "x", "left").withColumn("g", F.coalesce("g", "x"))
    p, q = (rare.select("c", "item", *[F.col(h).alias(f"{v}{h}") for h in ("x", "g", "f", "left", "linked")]) for v in "ab")
    enough = F.least("aleft", "bleft") >= (F.col("af") + F.col("bf")) / 2 - 1e-6
    apart_yet = (F.col("ag") != F.col("bg")) & ~(F.col("alinked") & F.col("blinked"))
    on = (p["c"] == q["c"]) & (p["item"] == q["item"]) & (F.col("ax") < F.col("bx")) & apart_yet & enough
    return p.join(q, on).select(F.col("ax").alias("a"), F.col("bx").alias("b")).distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text, ...)``.

    Null, empty and blank texts have no shingles, link with nothing and are kept. component_id is the smallest doc_id
    reachable by links; the document that has it is kept. Repeated rows of one doc_id get the same answer. A row with
    a null doc_id takes part through its text only if some row with the same words has an id; without one its
    component is null and it is kept. Very long texts are hashed in blocks. Other columns are not read. Shingles are
    told apart by 64-bit hashes without algebraic structure, and equal sets by 128 bits of them.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    signed = scratch.save(sign(docs, s), "signed")
    slim = signed.select("doc_id", "n_shingles", "d1", "d2")
    classes = scratch.save(slim.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    heads = heads_of(s)
    first = classes.select("node", F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    own = (F.col("doc_id") == F.col("node")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    nodes = signed.where("n_shingles > 0").join(first, own, "left_semi").dropDuplicates(["d1", "d2"])
    nodes = scratch.save(nodes.select(F.col("doc_id").alias("node"), "sig", "bands", *heads), "nodes")

    bands = nodes.select(F.explode("bands").alias("key"), "node")
    shared = scratch.save(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    slots = shared.agg(F.sum("n")).first()[0] or 0
    plain = scratch.save(join_counted(bands, shared, ["key"], slots), "members")
    known = plain.groupBy("node").agg(F.sum("n").alias("known"))
    members = scratch.save(plain.join(known.join(nodes.select("node", *heads).dropDuplicates(["node"]), "node"), "node"), "members")
    scratch.drop(plain)
    scratch.settle()
    centre = members.groupBy("key").agg(F.max(F.struct("known", (-F.col("node")).alias("neg"), *heads)).alias("c"), F.count("*").alias("n"))
    centre = centre.select("key", "n", (-F.col("c.neg")).alias("first"), *[F.col(f"c.{h}").alias(f"c{h}") for h in heads])
    star = join_counted(members.drop("n"), scratch.save(centre, "centre"), ["key"], slots).where((F.col("node") != F.col("first")) & possible(s, "h", "ch"))
    likely = scratch.save(prune(star.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), nodes, s), "likely")
    scratch.settle()

    # the likeliest partner of each document first: most groups are joined by these links alone
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b")
    source = docs.select(F.col("doc_id").cast("long"), "text")
    texts = scratch.save(packed(source).join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    links = scratch.save(verify(best, texts, s), "links")
    groups = scratch.save(connected_components(links, scratch), "groups")

    def label(pairs: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            g = groups.select(F.col("vertex").alias(c), F.col("component_id").alias(f"g{c}"))
            pairs = pairs.join(g, c, "left").withColumn(f"g{c}", F.coalesce(f"g{c}", c))
        return pairs.where("ga <> gb").select("a", "b")

    rest = label(likely.join(best, ["a", "b"], "left_anti"))
    g = groups.select(F.col("vertex").alias("node"), F.col("component_id").alias("g"))
    tagged = members.select("key", "node", "known").join(g, "node", "left").withColumn("g", F.coalesce("g", "node"))
    buckets = tagged.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("n"), F.max_by("g", F.struct("known", -F.col("node"))).alias("gc"))
    # in a bucket of two the star has compared the only pair
    mixed = scratch.save(buckets.where("g0 < g1 and n > 2").select("key", "n", "gc"), "mixed")
    open_ = scratch.save(join_counted(tagged, mixed, ["key"], slots), "open")
    few = open_.where(F.col("n") <= s.few).select("key", "node", "g").join(nodes.select("node", *heads).dropDuplicates(["node"]), "node")
    x, y = (few.select("key", F.col("node").alias(c), *[F.col(h).alias(f"{c}{h}") for h in ("g", *heads)]) for c in "ab")
    near = x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("ag") != F.col("bg")) & possible(s, "ah", "bh")).select("a", "b")
    # all buckets whose centre is in one component take the most connected member of that as their reference
    hubs = tagged.groupBy("g").agg(F.max_by("node", F.struct("known", -F.col("node"))).alias("c")).withColumnRenamed("g", "gc")
    many = open_.where(F.col("n") > s.few).select("node", "gc").distinct().join(hubs, "gc")
    apart = scratch.save(deltas(many.select("c", F.col("node").alias("x")), texts, s), "apart")
    beside = alike_beside(apart, groups, s)
    across = scratch.save(prune(near.union(beside).distinct(), nodes, s).select("a", "b"), "across")
    scratch.settle()
    links2 = scratch.save(verify(rest.union(across).distinct(), texts, s), "links")
    found = groups.select(F.col("vertex").alias("src"), F.col("component_id").alias("dst")).union(links2)
    found = found.union(apart.where("linked and x <> c").select(F.col("c").alias("src"), F.col("x").alias("dst")))
    final = scratch.save(connected_components(found, scratch), "final")
    scratch.drop(nodes, members, likely, texts, open_, across, apart)
    scratch.settle()

    named = classes.join(final, F.col("node") == F.col("vertex"), "left").select("d1", "d2", "n", F.coalesce("component_id", "node").alias("c"))
    some = slim.where("n_shingles > 0")
    out = join_counted(some, scratch.save(named, "named"), ["d1", "d2"], some.count()).select("doc_id", "n_shingles", F.col("c").alias("component_id"))
    out = out.unionByName(slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
