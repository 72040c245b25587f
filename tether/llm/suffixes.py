"""Removal of repeated byte strings by a distributed merge sort of anchored suffixes.

Of every window of ``length`` bytes the gram of ``GRAM`` bytes with the smallest hash is the anchor, so equal windows
have equal anchors at equal distances. Only anchors whose gram occurs again go on: each gives a segment, the suffix from
the anchor as far as the windows of this anchor reach, with its left context behind it. Executors sort the segments of
their documents into runs, in which equal segments are combined, deal them out so that suffixes with one gram meet, and
send them front-coded (length of the prefix shared with the entry before, and the rest). The runs are merged by a loser
tree whose comparisons start behind the prefixes already known to be shared. The shared prefixes of neighbours in the
merged order tell how far to the right of the anchor suffixes are alike, and the same of their left contexts how far to
the left: a window is a repeat if both reach over it, and all such windows but the first go. Documents with equal texts
are settled before all this by their digests.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tether.llm.kernels import Rolling, chunks, mix, texts_of
from tether.llm.skew import join_counted
from tether.runtime.scratch import Scratch

LENGTH = 100
GRAM = 24
#: Segments that a range of the exchange holds, on average.
RANGE = 20_000
#: Bytes of segments that a task holds before it sends a run.
RUN_BYTES = 4 << 20
#: Bytes of a text that are searched for anchors at once.
BLOCK = 1 << 18
#: Occurrences of a gram beyond which its windows are dealt out and merged one by one, as suffixes of their own from the
#: window's start, so that no range gets more segments of one gram than this. The result does not depend on it.
CROWD = 100_000
#: Segments of the merged order that are compared at once, unless one gram has more.
POOL = 8_000
#: What tells documents apart, in their order: no doc_id, doc_id, digest of the text.
SELF = ["none", "id", "sha"]


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: first and last window start, anchor position and 48-bit gram hash."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    at = np.arange(n - GRAM + 1)
    gram = Rolling(buf).of(at, at + GRAM)
    low = (gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    spot = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets))[: len(spot)] - np.arange(len(spot))
    p = np.flatnonzero(left >= length)
    if not len(p):
        return none, none, none, none
    a = spot[p]
    edge = np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))
    first, last = p[np.append(0, edge + 1)], p[np.append(edge, len(p) - 1)]
    return first, last, a[np.append(0, edge + 1)], (gram[a[np.append(0, edge + 1)]] >> np.uint64(16)).astype(np.int64)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m if not x else m - 1 - (x.bit_length() - 1) // 8


def front_code(entries: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix lengths, lengths of the rests (both 32-bit), and the rests, of sorted strings."""
    lcp, size, rest, before = [], [], [], b""
    for e in entries:
        k = shared(before, e, 0)
        lcp.append(k)
        size.append(len(e) - k)
        rest.append(e[k:])
        before = e
    return np.array(lcp, np.int32).tobytes(), np.array(size, np.int32).tobytes(), b"".join(rest)


def anchored(column: pa.Array, length: int):
    """Yields (row, bytes, first, last, anchor, gram) of each text: its runs of windows with one anchor."""
    for i, _, b, o in chunks(*texts_of(column), limit=BLOCK):
        if len(o) == 2 and len(b) > BLOCK:
            parts = []
            for s in range(0, len(b), BLOCK):
                sub = b[s : s + BLOCK + length - 1]
                lo, hi, at, h = anchors(sub, np.array([0, len(sub)]), length)
                parts.append((lo + s, hi + s, at + s, h))
            yield i, b, *(np.concatenate(c) for c in zip(*parts))
            continue
        lo, hi, at, h = anchors(b, o, length)
        edges = np.searchsorted(lo, o)
        for k, (x, y, s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), o[:-1].tolist(), o[1:].tolist())):
            yield i + k, b[s:e], lo[x:y] - s, hi[x:y] - s, at[x:y] - s, h[x:y]


class Run:
    """Reads a front-coded run one entry at a time; ``lcp`` is what the entry shares with the one before."""

    def __init__(self, lcp: bytes, size: bytes, rest: bytes):
        self.lcps, self.sizes, self.rest = np.frombuffer(lcp, np.int32).tolist(), np.frombuffer(size, np.int32).tolist(), rest
        self.at, self.place, self.entry, self.lcp = -1, 0, b"", 0

    def step(self) -> bool:
        self.at += 1
        if self.at >= len(self.lcps):
            return False
        self.lcp, n = self.lcps[self.at], self.sizes[self.at]
        self.entry = self.entry[: self.lcp] + self.rest[self.place : self.place + n]
        self.place += n
        return True


def merge(runs: list[Run]):
    """Yields (run, entry, shared with the entry yielded before) in sorted order, by a loser tree.

    Every player knows how much it shares with the last winner. Of two players the one that shares more is smaller;
    only players that share equally much are compared, from there on, and the loser notes what it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    entry: list[bytes | None] = [r.entry if r.step() else None for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k
    loser = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser) where both entries' lcp refers to the same last winner."""
        a, b = entry[x], entry[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        if lcp[x] != lcp[y]:
            return (x, y) if lcp[x] > lcp[y] else (y, x)
        m = shared(a, b, lcp[x])
        if m == len(a) or (m < len(b) and a[m] < b[m]):
            lcp[y] = m
            return x, y
        lcp[x] = m
        return y, x

    winner = list(range(k))
    for node in range(k - 1, 0, -1):
        pair = []
        for c in (2 * node, 2 * node + 1):
            pair.append(c - k if c >= k else winner[c])
        winner[node], loser[node] = play(*pair)
    top = winner[1] if k > 1 else 0
    while entry[top] is not None:
        yield top, entry[top], lcp[top]
        run = runs[top]
        if run.step():
            entry[top], lcp[top] = run.entry, run.lcp
        else:
            entry[top] = None
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def entry_of(data: bytes, first: int, last: int, anchor: int, length: int) -> bytes:
    """A segment: the suffix from the anchor to the end of the last window, its left context, and how long that is."""
    return data[anchor : last + length] + data[first:anchor] + (anchor - first).to_bytes(4, "big")


def repeated_windows(entries: list[bytes], known: list[int], places: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Spans (key, begin, end) of the windows of sorted segments that another one starts earlier with.

    ``known`` is what an entry shares with the one before, ``places`` the (key, begin) of each segment. The window
    that starts d bytes before the anchor is the same in two segments if they share length - d bytes from the anchor
    on, so lie in one stretch of the order whose shared prefixes are that long, and the d bytes before it likewise.
    """
    n = len(entries)
    if n < 2:
        return []
    left = np.array([int.from_bytes(e[-4:], "big") for e in entries])
    reach = np.array([len(e) - 4 for e in entries]) - left
    key, begin = np.array(places, np.int64).reshape(-1, 2).T
    anchor = begin + left
    context = [e[r:-4][::-1] for e, r in zip(entries, reach.tolist())]
    order = sorted(range(n), key=context.__getitem__)
    back = np.array([0] + [shared(context[x], context[y], 0) for x, y in zip(order, order[1:])])
    ahead = np.array(known)
    ahead[0] = 0
    by_place = np.lexsort((anchor, key))
    side = np.empty(n, np.int64)
    gone_row, gone_d = [], []
    for d in range(int(left.max()) + 1):
        own = by_place[((length - reach <= d) & (d <= left))[by_place]]
        if len(own) < 2:
            continue
        side[order] = (back < d).cumsum()
        right = (ahead < length - d).cumsum()
        # the first of each class in the order of places stays
        _, first = np.unique(right[own] * (n + 1) + side[own], return_index=True)
        again = np.ones(len(own), bool)
        again[first] = False
        gone_row.append(own[again])
        gone_d.append(np.full(int(again.sum()), d))
    if not gone_row or not sum(map(len, gone_row)):
        return []
    row, d = np.concatenate(gone_row), np.concatenate(gone_d)
    order = np.lexsort((d, row))
    row, d = row[order], d[order]
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(d) != 1))
    i, j = np.append(0, cut + 1), np.append(cut, len(row) - 1)
    return list(zip(key[row[i]].tolist(), (anchor[row[i]] - d[j]).tolist(), (anchor[row[i]] - d[i] + length).tolist()))


@dataclass(frozen=True)
class Repeats:
    """``docs(none, id, sha, n_bytes, n_rows, key, first)`` of each document, and ``spans(key, spans)`` of the first of their text."""

    docs: DataFrame
    spans: DataFrame


def _self() -> list[Column]:
    id = F.col("doc_id").cast("long")
    return [id.isNull().alias("none"), F.coalesce(id, F.lit(0)).alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha")]


def find_repeats(docs: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> Repeats:
    """What to remove from each text of ``docs(doc_id, text, ...)``.

    Null texts are empty. Order is by doc_id, a null doc_id last, then by the text's digest, then by start; rows with
    one doc_id (or none) and one text are one document and have the same result, while different texts under one
    doc_id are different documents. Texts below ``length`` bytes lose nothing.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(*_self(), "text")

    def survey(batches):
        for batch in batches:
            n, grams = [], []
            for _, text, _, _, _, h in anchored(batch.column(3), length):
                n.append(len(text))
                g, times = np.unique(h, return_counts=True)
                # a gram's hash in the upper bits, and how often the document has it
                grams.append(g << 15 | np.minimum(times, 32767))
            sizes = pa.array(np.array([0, *map(len, grams)]).cumsum().astype(np.int32))
            flat = np.concatenate(grams).astype(np.int64) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.ListArray.from_arrays(sizes, pa.array(flat))], [*SELF, "n_bytes", "grams"])

    seen = scratch.save(docs.mapInArrow(survey, "none boolean, id long, sha binary, n_bytes long, grams array<long>"), "survey")
    each = seen.groupBy(*SELF).agg(F.min("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))
    # in sorted partitions these ids are in the order of the documents
    keys = scratch.save(each.orderBy(*SELF).withColumn("key", F.monotonically_increasing_id()), "keys")
    first = scratch.save(keys.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")), "first")
    slim = scratch.save(join_counted(keys, first, ["sha"], keys.count()).drop("n"), "slim")
    firsts = slim.where(F.col("n_bytes") >= length).where("key = first").select("key", *SELF)
    each = seen.join(firsts, SELF).select("key", F.explode("grams").alias("g"))
    each = scratch.save(each.select("key", F.shiftright("g", 15).alias("gram"), (F.col("g") % 32768).alias("times")), "grams")
    counts = scratch.save(each.groupBy("gram").agg(F.count("*").alias("n"), F.sum("times").alias("all")).where("all > 1"), "counts")
    crowd = F.col("all") > CROWD
    hits = join_counted(each, counts, ["gram"], each.count())
    hits = hits.groupBy("key").agg(F.collect_list(F.when(~crowd, F.col("gram"))).alias("grams"), F.collect_list(F.when(crowd, F.col("gram"))).alias("crowds"), F.sum("times").alias("times"))
    hits = scratch.save(hits.join(firsts, "key"), "hits")
    scratch.drop(each, counts, first)
    scratch.drop(seen, keys)
    scratch.settle()
    total = hits.agg(F.sum("times")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE)

    def sort_runs(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            spans: list[tuple[int, int, int]] = []
            local: dict[bytes, tuple[int, int, int]] = {}
            held = 0
            for k, text, lo, hi, at, h in anchored(batch.column(1), length):
                key, data = keys[k], text.tobytes()
                own = np.isin(h, batch.column(2)[k].values.to_numpy())
                found = [zip(lo[own].tolist(), hi[own].tolist(), at[own].tolist(), _range(h[own].astype(np.uint64), ranges))]
                crowd = np.isin(h, batch.column(3)[k].values.to_numpy())
                if crowd.any():
                    p = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[crowd].tolist(), hi[crowd].tolist())])
                    found.append(zip(p.tolist(), p.tolist(), p.tolist(), _range(Rolling(text).of(p, p + length), ranges)))
                for first, last, anchor, part in chain(*found):
                    entry = entry_of(data, first, last, anchor, length)
                    mine, other = (key, first, part), local.get(entry)
                    if other is None:
                        local[entry] = mine
                        held += len(entry) + 150
                    elif other != mine:
                        later = max(other, mine)
                        local[entry] = min(other, mine)
                        begin, end = later[1], later[1] + len(entry) - 4
                        if spans and spans[-1][0] == later[0] and spans[-1][1] <= begin <= spans[-1][2]:
                            spans[-1] = (later[0], spans[-1][1], max(end, spans[-1][2]))
                        else:
                            spans.append((later[0], begin, end))
                            held += 150
                if held >= RUN_BYTES:
                    yield _batch(_runs(local), spans)
                    spans, local, held = [], {}, 0
            yield _batch(_runs(local), spans)

    schema = "range long, lcp binary, size binary, rest binary, places binary, key long, begin long, end long"
    work = scratch.save(docs.join(hits, SELF).select("key", "text", "grams", "crowds").mapInArrow(sort_runs, schema), "runs")
    scratch.settle()

    def merge_runs(table: pa.Table) -> pa.Table:
        lcp, size, rest, places = (table.column(c).to_pylist() for c in ("lcp", "size", "rest", "places"))
        runs = [Run(*x) for x in zip(lcp, size, rest)]
        spots = [np.frombuffer(p, np.int64).reshape(-1, 2).tolist() for p in places]
        spans: list[tuple[int, int, int]] = []
        pool: tuple[list, list, list] = ([], [], [])
        begin = 0  # of the group of suffixes with one gram in the pool

        def compare() -> None:
            spans.extend(repeated_windows(*pool, length))
            for c in pool:
                c.clear()

        for r, entry, known in merge(runs):
            mine = tuple(spots[r][runs[r].at])
            if pool[0] and known == len(entry) == len(pool[0][-1]):
                best = pool[2][-1]
                if best != mine:
                    later = max(best, mine)
                    spans.append((later[0], later[1], later[1] + len(entry) - 4))
                    pool[2][-1] = min(best, mine)
                continue
            if known < GRAM:
                if len(pool[0]) - begin == 1:  # a lone suffix repeats nothing
                    for c in pool:
                        c.pop()
                if len(pool[0]) > POOL:
                    compare()
                begin = len(pool[0])
                known = 0
            for c, x in zip(pool, (entry, known, mine)):
                c.append(x)
        compare()
        cols = [list(c) for c in zip(*spans)] or [[]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("key", "begin", "end"), cols)})

    # a given number of partitions is not coalesced by bytes, which say little of the work
    runs = work.where("range is not null").select("range", "lcp", "size", "rest", "places").repartition(ranges, "range")
    merged = runs.groupBy("range").applyInArrow(merge_runs, "key long, begin long, end long")
    ready = work.where("end is not null").select("key", "begin", "end")
    spans = merged.unionByName(ready).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop(work, hits)
    scratch.settle()
    return Repeats(slim, spans)


def _range(h: np.ndarray, ranges: int) -> list[int]:
    """The range that all suffixes of a gram fall in. Grams are anchors for their small hashes, so these are mixed anew."""
    return ((mix(h) >> np.uint64(33)).astype(np.int64) * ranges >> 31).tolist()


def _runs(local: dict[bytes, tuple[int, int, int]]) -> list[tuple]:
    """A front-coded run of the segments of each range."""
    order = sorted(local)
    part = np.array([local[e][2] for e in order], np.int64)
    rows = []
    for p in np.unique(part).tolist():
        own = [order[k] for k in np.flatnonzero(part == p).tolist()] if len(order) else []
        rows.append((p, *front_code(own), np.array([local[e][:2] for e in own], np.int64).tobytes()))
    return rows


def _batch(rows: list[tuple], spans: list[tuple]) -> pa.RecordBatch:
    """Rows of runs and of spans in one schema."""
    r, s = len(rows), len(spans)
    run = [list(c) for c in zip(*rows)] or [[]] * 5
    span = np.array(spans, np.int64).reshape(-1, 3).T
    cols = [
        pa.array(run[0] + [None] * s, pa.int64()),
        *(pa.array(c + [None] * s, pa.binary()) for c in run[1:]),
        *(pa.concat_arrays([pa.nulls(r, pa.int64()), pa.array(c)]) for c in span),
    ]
    return pa.RecordBatch.from_arrays(cols, ["range", "lcp", "size", "rest", "places", "key", "begin", "end"])


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of spans sorted by begin; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["begin"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["begin"], s["end"]))
    return out


def _cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def removed(docs: DataFrame, found: Repeats, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of docs."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data, runs = (text.as_py() or "").encode(), union_of(spans)
                rows.append((key, sum(b - a for a, b in runs), len(runs), hashlib.sha256(_cut(data, runs)).hexdigest()))
            cols = [list(c) for c in zip(*rows)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["key", "r", "s", "sha2"])

    spans = found.spans.join(found.docs.select("key", *SELF), "key")
    cut = docs.select(*_self(), "text").join(spans, SELF).select("key", "text", "spans").mapInArrow(run, "key long, r long, s long, sha2 string").dropDuplicates(["key"])
    copy = (F.col("key") > F.col("first")) & (F.col("n_bytes") >= length)
    out = found.docs.join(cut, "key", "left").withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "n_bytes",
        pick(F.col("n_bytes"), F.col("r"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("s"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha2"), F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def kept_texts(docs: DataFrame, found: Repeats, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; a character that a cut splits goes with it.

    Documents of which nothing is left go; those that were empty or null before stay. All columns stay, and a column
    ``n_chars`` is set to the characters left where there is a text.
    """
    names = docs.columns
    spot = names.index("text")

    def run(batches):
        for batch in batches:
            texts, left = [], []
            for k, (text, spans) in enumerate(zip(batch.column(spot), batch.column(len(names)).to_pylist())):
                t = text.as_py()
                if spans:
                    t = _cut(t.encode(), union_of(spans)).decode("utf-8", "ignore")
                if t or not spans:
                    texts.append(t)
                    left.append(k)
            kept = batch.take(pa.array(left, pa.int64()))
            cols = [*kept.columns[:spot], pa.array(texts, pa.string()), *kept.columns[spot + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(cols, names)

    mine = [f"_{c}" for c in SELF]
    own = [F.col(c).alias(f"_{c}") for c in SELF]
    copies = found.docs.where((F.col("key") > F.col("first")) & (F.col("n_bytes") >= length)).select(*own)
    spans = found.spans.join(found.docs.select("key", *own), "key").select(*mine, F.col("spans").alias("_spans"))
    alive = docs.select("*", *[c.alias(m) for c, m in zip(_self(), mine)]).join(copies, mine, "left_anti").join(spans, mine, "left")
    out = alive.select(*[F.col(f"`{c}`") for c in names], "_spans")
    cut = out.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
    if "n_chars" not in names:
        return cut
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
