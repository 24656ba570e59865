"""Tool-call linking for chat data, with DataFrame functions only.

Calls and results are hash-joined by conversation and identifier, calls are put in topological
order (a call comes after the call whose result it depends on), arguments are validated against
the tools' schemas, and each linked call is serialised as canonical JSON (sorted keys, no blanks).

Levels come from pointer doubling, so a chain of n dependent calls takes log2(n) joins, and no
conversation is gathered in one task. ``position`` numbers a conversation's calls in topological order: by level, then
turn, then identifier.

Defined results: calls without conversation or identifier, and results without a call, are rows of their own that are
not linked, with the errors ``call:unidentified`` and ``result:orphan`` and no message; of several calls or
results of one identifier the first by turn, then by text, counts, and ``copies`` tells how many
calls there were; an unknown dependency is no dependency; calls on or behind a cycle have a null level,
come last and have the error ``cycle``; unreadable arguments and unknown tools are errors; a call without a result
has a null ``result``; texts are taken whole; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, numbered, read_table, store

#: Tool -> argument -> (JSON type, whether it is required).
Schemas = dict[str, dict[str, tuple[str, bool]]]

_TYPE_NAMES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$"}


def argument_errors(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """The sorted errors of the parsed arguments (a variant, null if unreadable), joined by ``;``."""
    errors = F.when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed), F.lit("")).startswith("OBJECT"), F.array(F.lit("arguments:unreadable")))
    keys = F.map_keys(F.from_json(F.to_json(parsed), "map<string,string>"))
    for tool, fields in schemas.items():
        found = [F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(k, F.lit(":unknown")))]
        for field, (kind, required) in sorted(fields.items()):
            value = F.schema_of_variant(F.variant_get(parsed, f"$.{field}", "variant"))
            there = F.array_contains(keys, field)
            wrong = F.when(there & ~F.coalesce(value.rlike(_TYPE_NAMES[kind]), F.lit(False)), F.array(F.lit(f"{field}:type")))
            missing = F.when(~there, F.array(F.lit(f"{field}:missing"))) if required else F.lit(None)
            found.append(F.coalesce(wrong, missing, F.array().cast("array<string>")))
        errors = errors.when(name == tool, F.array_sort(F.concat(*found)))
    return F.array_join(errors.otherwise(F.array(F.lit("name:unknown"))), ";")


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` from ``conv_id, call_id, depends_on``: how many calls must come before; null on or behind a cycle."""
    ids = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    known = calls.join(ids, (calls["conv_id"] == ids["c"]) & (calls["depends_on"] == ids["i"]), "left")
    now = store(known.select("conv_id", "call_id", F.col("i").alias("up"), F.when(F.col("i").isNotNull(), 1).otherwise(0).cast("long").alias("level")), "call-levels")
    rounds = now.count().bit_length() + 1  # a chain without a cycle is resolved by then
    for _ in range(rounds):
        if not now.where("up is not null").take(1):
            break
        up = now.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("up").alias("next"), F.col("level").alias("more"))
        doubled = now.join(up, (now["conv_id"] == up["c"]) & (now["up"] == up["i"]), "left")
        new = store(doubled.select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "call-levels")
        drop(now)
        now = new
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _json(c: str) -> Column:
    """The column's text as a JSON string, or ``null``."""
    boxed = F.to_json(F.struct(F.col(c).alias("x")))
    return F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.substr(boxed, F.lit(6), F.length(boxed) - 6))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each identified call, and for each call or result that links with nothing.

    calls: ``conv_id, turn, call_id, name, arguments, depends_on``; results: ``conv_id, turn, call_id, content``.
    """
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = calls.where(known).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("call"), F.count("*").alias("copies")).select("conv_id", "call_id", "copies", "call.*")
    first = store(first, "calls")
    answer = results.where(known).groupBy(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri")).agg(F.min(F.struct("turn", "content")).alias("answer"))
    deep = numbered(first.select("conv_id", "turn", "call_id").join(levels(first).withColumnsRenamed({"conv_id": "c", "call_id": "i"}), (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i"))).withColumn("last", F.coalesce("level", F.lit(2**62))), ["conv_id"], ["last", "turn", "call_id"], "position")
    deep = deep.select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level", "position")
    # One row a key on either side: a hash join has no long lists.
    both = first.join(answer.hint("shuffle_hash"), (F.col("conv_id") == F.col("rc")) & (F.col("call_id") == F.col("ri")), "full_outer")
    joined = both.join(deep.hint("shuffle_hash"), (F.col("conv_id") == F.col("lc")) & (F.col("call_id") == F.col("li")), "left").withColumn("result", F.col("answer.content"))
    parsed = joined.withColumn("parsed", F.try_parse_json(F.coalesce("arguments", F.lit(""))))
    checked = parsed.withColumn("problems", argument_errors(F.col("name"), F.col("parsed"), schemas))
    error = F.concat_ws(";", F.when(F.col("problems") != "", F.col("problems")), F.when(F.col("level").isNull(), F.lit("cycle")))
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")), F.lit(',"depends_on":'), _json("depends_on"), F.lit(',"id":'), _json("call_id"), F.lit(',"name":'), _json("name"), F.lit(',"result":'), _json("result"), F.lit("}")
    )
    call = F.col("call_id").isNotNull()
    own = lambda c: F.when(call, c)
    error = own(error).otherwise("result:orphan")
    linked = checked.select(
        F.coalesce("conv_id", "rc").alias("conv_id"), F.coalesce("call_id", "ri").alias("call_id"), own(F.col("turn")).otherwise(F.col("answer.turn")).alias("turn"), F.coalesce("copies", F.lit(0)).alias("copies"), "level", "position",
        (call & F.col("answer").isNotNull()).alias("linked"), error.alias("error"), (error == "").alias("valid"), own(message).alias("message"),
    )
    none = lambda t: F.lit(None).cast(t)
    lost = lambda df, n, why: df.where(~known).select("conv_id", "call_id", "turn", F.lit(n).cast("long").alias("copies"), none("long").alias("level"), none("long").alias("position"), F.lit(False).alias("linked"), F.lit(why).alias("error"), F.lit(False).alias("valid"), none("string").alias("message"))
    return linked.unionByName(lost(calls, 1, "call:unidentified")).unionByName(lost(results, 0, "result:orphan"))


#: The tools of the query below.
TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "lookup": {"key": ("string", True), "exact": ("boolean", False)},
    "compute": {"value": ("number", True), "unit": ("string", False)},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads a chat as tool use: assistant turns call, the turn after each answers, and each call builds on the one two turns before. A turn's whole text is the query or key argument."""
    n = F.length("text")
    tool = F.element_at(F.array(*map(F.lit, ("search", "lookup", "compute"))), (F.pmod(F.col("turn"), F.lit(3)) + 1).cast("int"))
    value = _json("text")
    limit = F.when(n % 7 == 0, F.lit("")).when(n % 11 == 0, F.concat(F.lit(', "limit": "'), n, F.lit('"'))).otherwise(F.concat(F.lit(', "limit": '), n))
    arguments = (
        F.when(tool == "search", F.concat(F.lit('{"query": '), value, limit, F.lit("}")))
        .when(tool == "lookup", F.concat(F.lit('{"key": '), value, F.when(n % 5 == 0, F.lit(', "depth": 1')).otherwise(F.lit(', "exact": true')), F.lit("}")))
        .otherwise(F.concat(F.lit('{"value": '), F.when(n % 13 == 0, F.lit("[1]")).otherwise(n.cast("string")), F.lit(', "unit": "chars"}')))
    )
    calls = turns.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn")).alias("call_id"), tool.alias("name"), F.when(n % 17 == 0, F.lit("{broken")).otherwise(arguments).alias("arguments"), F.concat(F.lit("c"), F.col("turn") - 2).alias("depends_on"))
    results = turns.where("role <> 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*conversation_calls(read_table(spark, sf_dir, "conversations")), TOOLS)


OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, length(text) AS n, to_json(text) :: VARCHAR AS v FROM conversations),
c0 AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, 'c' || (turn - 2) AS depends_on, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'compute' END AS name, n, v, n % 17 = 0 AS broken
  FROM t WHERE role = 'assistant'
),
c1 AS (
  SELECT *,
    CASE WHEN broken THEN 'null'
      WHEN name = 'search' THEN '{' || CASE WHEN n % 7 = 0 THEN '' WHEN n % 11 = 0 THEN '"limit":"' || n || '",' ELSE '"limit":' || n || ',' END || '"query":' || v || '}'
      WHEN name = 'lookup' THEN '{' || CASE WHEN n % 5 = 0 THEN '"depth":1,' ELSE '"exact":true,' END || '"key":' || v || '}'
      ELSE '{"unit":"chars","value":' || CASE WHEN n % 13 = 0 THEN '[1]' ELSE n :: VARCHAR END || '}' END AS args,
    CASE WHEN broken THEN 'arguments:unreadable'
      WHEN name = 'search' THEN CASE WHEN n % 7 = 0 THEN 'limit:missing' WHEN n % 11 = 0 THEN 'limit:type' ELSE '' END
      WHEN name = 'lookup' THEN CASE WHEN n % 5 = 0 THEN 'depth:unknown' ELSE '' END
      ELSE CASE WHEN n % 13 = 0 THEN 'value:type' ELSE '' END END AS error
  FROM c0
),
pick AS (SELECT *, count(*) OVER (PARTITION BY conv_id, call_id) AS copies, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, args) AS k FROM c1),
c AS (SELECT * FROM pick WHERE k = 1),
r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS turn, min_by(text, (turn, text)) AS content FROM t WHERE role <> 'assistant' GROUP BY ALL),
lev AS (
  SELECT conv_id, call_id, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.call_id = c.depends_on)
  UNION ALL
  SELECT c.conv_id, c.call_id, lev.level + 1 FROM c JOIN lev ON c.conv_id = lev.conv_id AND c.depends_on = lev.call_id
)
SELECT c.conv_id, c.call_id, c.turn, c.copies, CAST(lev.level AS BIGINT) AS level, row_number() OVER (PARTITION BY c.conv_id ORDER BY lev.level, c.turn, c.call_id) AS position, r.conv_id IS NOT NULL AS linked, c.error, c.error = '' AS valid,
  '{"arguments":' || c.args || ',"depends_on":"' || c.depends_on || '","id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(to_json(r.content) :: VARCHAR, 'null') || '}' AS message
FROM c JOIN lev ON c.conv_id = lev.conv_id AND c.call_id = lev.call_id LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
UNION ALL
SELECT conv_id, call_id, turn, 0, NULL, NULL, false, 'result:orphan', false, NULL FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
