"""Best-fit packing of token sequences in bulk-synchronous rounds.

Longer pieces go first, in bands of lengths that differ by less than the factor ``BAND``. In a round the unplaced pieces
of the band and the slots of all open gaps are range-sorted by size over the executors, and each range is swept from
large to small: a piece takes the smallest open slot that fits, its successor. What finds no partner in its range is
numbered there; the driver tells from the numbers of each range alone which slots of larger ranges these pieces get, so
each piece of a rank meets the slot of one rank and no two pieces want one slot. Then the gaps shrink. Where no gap
takes a piece any more, new sequences are opened, and the rounds go on until the band is placed.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tether.llm.tokens import Encoder
from tether.runtime.scratch import Scratch

CAPACITY = 2048
END = 0
#: lengths of one band differ by less than this factor
BAND = 4


def cut(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of the pieces of each row of ``docs(doc_id, text)``.

    A document is its ids and a closing id 0; a null text is empty and gives that id alone. Only a longer document is
    cut, into pieces of ``capacity`` ids from its end, so the first piece may be shorter.
    """

    def run(batches):
        encoder = Encoder(files)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(END)).astype("<u4")
                head = len(ids) % capacity
                stops = [*([head] if head else []), *range(head + capacity, len(ids) + 1, capacity)]
                begin = 0
                for k, stop in enumerate(stops):
                    own = ids[begin:stop]
                    rows.append((doc, k, begin, stop - begin, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
                    begin = stop
            cols = [list(c) for c in zip(*rows)] or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types)], names[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _slots(gaps: DataFrame, longest: int, shortest: int) -> DataFrame:
    """``value, kind, id, n``: a gap holds as many pieces of up to ``longest`` as fit side by side, and one in what remains."""
    whole = F.struct(F.lit(longest).cast("long").alias("value"), F.floor(F.col("gap") / longest).alias("n"))
    rest = F.struct(F.expr(f"gap % {longest}").alias("value"), F.lit(1).cast("long").alias("n"))
    each = gaps.where(F.col("gap") >= shortest).select(F.col("sequence_id").alias("id"), F.explode(F.array(whole, rest)).alias("s"))
    return each.where((F.col("s.n") > 0) & (F.col("s.value") >= shortest)).select("s.value", F.lit(0).alias("kind"), "id", "s.n")


SWEPT = "part int, kind int, sequence_id long, pid long, length long, at long, n long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], list(names))


def _sweep(batches):
    """From large to small, each piece takes the smallest open slot of its range; what has no partner there is numbered.

    Of a range only pieces that found no slot (kind 2, in order) and then slots that found no piece (kind 1, ``n`` from
    number ``at`` on) are left; kind 0 are pieces with their sequence.
    """
    part = TaskContext.get().partitionId()
    stack: list[list[int]] = []
    unmet = 0
    for batch in batches:
        rows = []
        for value, kind, key, n in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                stack.append([key, n])
            elif stack:
                top = stack[-1]
                rows.append((part, 0, top[0], key, value, 0, 0))
                top[1] -= 1
                if not top[1]:
                    stack.pop()
            else:
                rows.append((part, 2, 0, key, value, unmet, 0))
                unmet += 1
        yield _batch(rows, SWEPT)
    at = 0
    for k in range(0, len(stack), 10_000):
        rows = []
        for key, n in stack[k : k + 10_000]:
            rows.append((part, 1, key, 0, 0, at, n))
            at += n
        yield _batch(rows, SWEPT)


@dataclass(frozen=True)
class Exchange:
    """Pieces left in range ``part``, from number ``first`` on, take slots ``top``, ``top`` - 1, ... of range ``source``."""

    part: np.ndarray
    first: np.ndarray
    source: np.ndarray
    top: np.ndarray
    met: dict[int, int]
    low: dict[int, int]


def exchange(ranges: list[tuple[int, int, int]]) -> Exchange:
    """Which open slots the pieces left over go to, of ``(part, pieces, slots)`` by range from large to small.

    ``met`` is the number of pieces of a range that found a slot, ``low`` the first slot of a range that is taken.
    """
    stack: list[list[int]] = []
    rows, met, low = [], {}, {}
    for part, pieces, slots in sorted(ranges):
        done = 0
        while done < pieces and stack:
            top = stack[-1]
            take = min(pieces - done, top[1])
            rows.append((part, done, top[0], top[1] - 1))
            done += take
            top[1] -= take
            low[top[0]] = top[1]
            if not top[1]:
                stack.pop()
        met[part] = done
        low[part] = slots
        if slots:
            stack.append([part, slots])
    a = np.array(rows or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    return Exchange(*a.T, met, low)


def _resolve(plan: Exchange):
    """Kind 0: a piece and its sequence; 1 and 2: a slot and a piece that meet in (part, at); 3: a piece without a slot."""
    key = plan.part << 40 | plan.first

    def run(batches):
        for batch in batches:
            part, kind, seq, pid, length, at, n = (c.to_numpy() for c in batch.columns)
            part = part.astype(np.int64)
            out = [np.flatnonzero(kind == 0)]
            where = [(part[out[0]], at[out[0]], np.zeros(len(out[0]), np.int64))]
            slots = np.flatnonzero(kind == 1)
            begin = np.maximum(at[slots], np.array([plan.low[p] for p in part[slots].tolist()], np.int64))
            many = np.maximum(at[slots] + n[slots] - begin, 0)
            each = np.repeat(slots, many)
            spot = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(each))
            out.append(each)
            where.append((part[each], spot, np.ones(len(each), np.int64)))
            left = np.flatnonzero(kind == 2)
            met = at[left] < np.array([plan.met[p] for p in part[left].tolist()], np.int64)
            go, stay = left[met], left[~met]
            row = np.searchsorted(key, part[go] << 40 | at[go], "right") - 1
            out += [go, stay]
            where.append((plan.source[row], plan.top[row] - (at[go] - plan.first[row]), np.full(len(go), 2)))
            where.append((part[stay], at[stay], np.full(len(stay), 3)))
            own = np.concatenate(out)
            part, at, kind = (np.concatenate(c) for c in zip(*where))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (kind, part, at, seq[own], pid[own], length[own])], ["kind", "part", "at", "sequence_id", "pid", "length"])

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with ``sequence_id`` and ``offset``; no sequence exceeds ``capacity``.

    Lengths are from 1 to ``capacity``. Each row is placed once, repeated ones too. No pieces give no rows. The driver
    sees two numbers a range and a few totals a round. New sequences are opened where no gap takes a piece any more, as
    many as the pieces left of the band need at least.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark)
    base = scratch.save(pieces.withColumn("_pid", F.monotonically_increasing_id()), "numbered")
    todo = base.select(F.col("_pid").alias("pid"), "length")
    gaps = spark.range(0).select(F.col("id").alias("sequence_id"), F.col("id").alias("gap"))
    rounds: list[DataFrame] = []
    opened, below, spent = 0, capacity + 1, []
    while (longest := todo.where(F.col("length") < below).agg(F.max("length")).first()[0]) is not None:
        floor = longest // BAND
        left = todo.where((F.col("length") < below) & (F.col("length") > floor))
        below = floor + 1
        fresh = False
        while True:
            longest, shortest, n, total = left.agg(F.max("length"), F.min("length"), F.count("*"), F.sum("length")).first()
            if not n:
                break
            if fresh or not rounds:
                need = max(-(-total // capacity), -(-n // (capacity // shortest)))
                more = spark.range(opened, opened + need).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
                gaps = gaps.unionByName(more)
                opened += need
            row = F.col("length").alias("value"), F.lit(1).alias("kind"), F.col("pid").alias("id"), F.lit(1).cast("long").alias("n")
            events = _slots(gaps, longest, shortest).unionByName(left.select(*row))
            order = F.desc("value"), F.col("kind"), F.col("id")
            swept = scratch.save(events.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep, SWEPT), "swept")
            count = lambda kind, what: F.sum(F.when(F.col("kind") == kind, what).otherwise(0))
            ranges = swept.groupBy("part").agg(count(2, 1), count(1, F.col("n")), count(0, 1)).collect()
            plan = exchange([tuple(r)[:3] for r in ranges])
            if sum(r[3] for r in ranges) + sum(plan.met.values()) == 0:
                scratch.drop(swept)
                fresh = True
                continue
            fresh = False
            known = scratch.save(swept.mapInArrow(_resolve(plan), "kind long, part long, at long, sequence_id long, pid long, length long"), "known")
            slots = known.where("kind = 1").select("part", "at", "sequence_id")
            across = known.where("kind = 2").select("part", "at", "pid", "length").join(slots, ["part", "at"])
            pairs = known.where("kind = 0").select("sequence_id", "pid", "length").unionByName(across.select("sequence_id", "pid", "length"))
            taken = pairs.groupBy("sequence_id").agg(F.sum("length").alias("_sum"), F.sort_array(F.collect_list(F.struct("length", "pid")), False).alias("placed"))
            now = scratch.save(gaps.join(taken, "sequence_id", "left").select("sequence_id", "gap", "placed", (F.col("gap") - F.coalesce("_sum", F.lit(0))).alias("after")), "round")
            rounds.append(now.where("placed is not null").select("sequence_id", "gap", "placed"))
            gaps = now.where("after > 0").select("sequence_id", F.col("after").alias("gap"))
            left = known.where("kind = 3").select("pid", "length")
            scratch.drop(swept, *spent)
            spent = [known]
    fields = [*pieces.columns, "sequence_id", "offset"]
    if not rounds:
        return base.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long")).select(*fields)
    # a sequence has at most capacity pieces, so its list is bounded
    parts = []
    for r in rounds:
        spot = F.expr(f"transform(placed, (p, i) -> struct(p.pid as _pid, {capacity} - gap + aggregate(slice(placed, 1, i), 0L, (s, q) -> s + q.length) as offset))")
        parts.append(r.select("sequence_id", F.explode(spot).alias("p")).select("p._pid", "sequence_id", "p.offset"))
    spots = parts[0]
    for p in parts[1:]:
        spots = spots.unionByName(p)
    return base.join(spots, "_pid").select(*fields)


def pack(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """The pieces of ``docs(doc_id, text, ...)`` (see ``cut``) with their place (see ``place``).

    Repeated rows are packed once each; a null doc_id stays null; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    return place(scratch.save(cut(docs, capacity, files, with_ids), "pieces"), capacity, scratch)
