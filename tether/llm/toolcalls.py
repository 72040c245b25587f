"""Chat formatting with linked tool calls.

Calls and results meet in a hash join by call identifier. The calls of a message are ordered so that a call stands
behind those whose results its arguments name (``$call:<id>``), arguments are validated against the tool's schema, and
the message becomes canonical JSON: sorted keys, no blanks, characters as they are.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFERENCE = "$call:"
#: Levels of nesting up to which JSON is read.
DEPTH = 100
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _finite(number: str) -> float:
    x = float(number)
    if x in (float("inf"), float("-inf")):
        raise ValueError("beyond the range of numbers")
    return x


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def read_json(raw: str):
    """The value of a JSON text; ValueError if it is none, is nested too deeply, or has a lone surrogate or no finite number."""
    try:
        value = json.loads(raw, parse_float=_finite, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    level = [value]
    for _ in range(DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            break
    else:
        raise ValueError("nested too deeply")
    if "\\u" in raw:
        canonical(value).encode()  # a lone surrogate is a UnicodeEncodeError, which is a ValueError
    return value


def read_calls(raw: str | None) -> list[dict] | None:
    """The calls of a message, each with id, name and arguments; None if the JSON is not a list of such objects.

    JSON that ``read_json`` refuses is not such a list. Arguments that are a string stay one if it is no JSON.
    """
    if raw is None or not raw.strip():
        return []
    try:
        calls = read_json(raw)
    except ValueError:
        return None
    if not isinstance(calls, list) or not all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
        return None
    out = []
    for c in calls:
        a = c.get("arguments", {})
        if isinstance(a, str):  # arguments are often JSON in JSON
            try:
                a = read_json(a)
            except ValueError:
                pass
        out.append({"id": c["id"], "name": c["name"], "arguments": a})
    return out


def _is(value, kind: str) -> bool:
    return isinstance(value, _TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def problems(value, schema: dict, at: str = "arguments") -> list[str]:
    """What breaks a schema of type, enum, minimum, maximum, required, properties, additionalProperties and items."""
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below the minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above the maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for n, v in enumerate(value):
            out += problems(v, schema["items"], f"{at}[{n}]")
    return out


def references(value) -> set[str]:
    """Call ids that arguments name at any depth."""
    if isinstance(value, str):
        return {value[len(REFERENCE) :]} if value.startswith(REFERENCE) else set()
    if isinstance(value, dict):
        value = list(value.values())
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def ordered(calls: list[dict]) -> tuple[list[dict], set[int]]:
    """Calls in topological order, the first listed first among those that are free; and the places of those on a cycle.

    Of calls with one id, a reference means the first. Calls on or behind a cycle come last, as listed.
    """
    place: dict[str, int] = {}
    for n, c in enumerate(calls):
        place.setdefault(c["id"], n)
    waits = [{place[r] for r in references(c["arguments"]) if r in place} for c in calls]
    after: dict[int, list[int]] = {}
    for n, w in enumerate(waits):
        for m in w:
            after.setdefault(m, []).append(n)
    left = [len(w) for w in waits]
    free = [n for n, k in enumerate(left) if not k]
    out = []
    while free:
        n = heapq.heappop(free)
        out.append(n)
        for m in after.get(n, ()):
            left[m] -= 1
            if not left[m]:
                heapq.heappush(free, m)
    stuck = [n for n in range(len(calls)) if n not in set(out)]
    return [calls[n] for n in out + stuck], set(range(len(out), len(calls))) if stuck else set()


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def format_message(role: str | None, text: str | None, raw: str | None, results: dict[str, str | None], schemas: dict[str, dict]) -> tuple[int, int, int, str]:
    """(calls, linked calls, valid calls, canonical JSON) of one message; an unreadable list of calls is kept as text."""
    calls = read_calls(raw)
    if calls is None:
        return 0, 0, 0, canonical({"role": role, "content": text, "unreadable_calls": raw})
    calls, cyclic = ordered(calls)
    out, linked, valid = [], 0, 0
    for n, c in enumerate(calls):
        wrong = problems(c["arguments"], schemas[c["name"]]) if c["name"] in schemas else ["no such tool"]
        if n in cyclic:
            wrong.append("waits for itself")
        entry = c | ({"result": results[c["id"]]} if c["id"] in results else {}) | ({"problems": wrong} if wrong else {})
        linked += c["id"] in results
        valid += not wrong
        out.append(entry)
    return len(out), linked, valid, canonical({"role": role, "content": text} | ({"tool_calls": out} if out else {}))


def format_chat(messages: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``conv_id, turn, role, n_calls, n_linked, n_valid, json`` of each row of messages.

    ``messages(conv_id, turn, role, text, tool_calls, ...)`` has calls as a JSON list, or null; ``results(call_id,
    content, ...)`` has at most one content for a call that counts, the smallest of several. Calls without a result
    stay unlinked, results without a call are left out. Repeated rows come out as often; nulls stay null. Rows are
    grouped by message only, and a message's calls are as many as its own text lists. A list of calls that is no JSON,
    is nested over ``DEPTH`` levels, or holds a lone surrogate, NaN or an infinite number is kept as text.
    """
    m = messages.select("conv_id", "turn", "role", "text", "tool_calls").groupBy("conv_id", "turn", "role", "text", "tool_calls").agg(F.count("*").alias("times"))
    m = m.withColumn("mid", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text", "tool_calls")), 256))

    def ids(batches):
        for batch in batches:
            mid, call = [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = dict.fromkeys(c["id"] for c in read_calls(raw) or [])
                mid += [k] * len(own)
                call += own
            yield pa.RecordBatch.from_arrays([pa.array(mid, pa.string()), pa.array(call, pa.string())], ["mid", "call_id"])

    wanted = m.where("tool_calls is not null").select("mid", "tool_calls").mapInArrow(ids, "mid string, call_id string")
    one = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"))
    met = wanted.join(one, "call_id").groupBy("mid").agg(F.collect_list(F.struct("call_id", "content")).alias("met"))

    def write(batches):
        for batch in batches:
            rows = []
            for role, text, raw, got in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 6))):
                rows.append(format_message(role, text, raw, {g["call_id"]: g["content"] for g in got or []}, schemas))
            cols = [list(c) for c in zip(*rows)] or [[]] * 4
            more = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), *more], ["conv_id", "turn", "role", "times", "n_calls", "n_linked", "n_valid", "json"])

    kinds = dict(messages.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, times long, n_calls int, n_linked int, n_valid int, json string"
    joined = m.join(met, "mid", "left").select("conv_id", "turn", "role", "text", "tool_calls", "times", "met")
    out = joined.mapInArrow(write, schema)
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("again", "times")
