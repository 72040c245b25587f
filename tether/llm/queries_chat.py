"""Query of the chat formatting operator.

The conversations have no tool calls, so each turn is given three: one counts its words, one reports that count, and
one compares it with the turn before. They are listed in the reverse of the order in which they can run. Turns without
words have no count, which leaves calls unlinked, and turns without a role fail validation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tether.llm import toolcalls

SCHEMAS = {
    "count_words": {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}}},
    "report": {"type": "object", "required": ["count", "role"], "properties": {"count": {"type": "string"}, "role": {"type": "string", "enum": ["assistant", "system", "user"]}}},
    "compare": {"type": "object", "required": ["now", "then"], "properties": {"now": {"type": "string"}, "then": {"type": "string"}}},
}


def with_calls(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and tool_calls as a JSON list."""

    def name(tool: str, back: int = 0):
        return F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"), F.lit(tool))

    def call(tool: str, **arguments):
        args = F.to_json(F.struct(*[v.alias(k) for k, v in arguments.items()]))
        return F.concat(F.lit('{"id":'), _quoted(name(tool)), F.lit(f',"name":"{tool}","arguments":'), args, F.lit("}"))

    refer = lambda c: F.concat(F.lit(toolcalls.REFERENCE), c)
    calls = F.concat_ws(
        ",",
        call("compare", now=refer(name("report")), then=refer(name("count_words", 1))),
        call("report", count=refer(name("count_words")), role=F.col("role")),
        call("count_words", text=F.col("text"), turn=F.col("turn")),
    )
    return conversations.select("conv_id", "turn", "role", "text", F.concat(F.lit("["), calls, F.lit("]")).alias("tool_calls"))


def _quoted(c):
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)


def results_of(conversations: DataFrame) -> DataFrame:
    """call_id and content of the calls that gave a result."""
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    counted = conversations.select("conv_id", "turn", "role", n.alias("n")).where("n > 0")
    kind = F.explode(F.array(F.lit("count_words"), F.lit("report"))).alias("tool")
    rows = counted.select("conv_id", "turn", "role", "n", kind)
    content = F.when(F.col("tool") == "report", F.concat_ws(": ", "role", F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "tool").alias("call_id"), content.alias("content"))


def op9_tool_call_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return toolcalls.format_chat(with_calls(talks), results_of(talks), SCHEMAS)
