"""Chat formatting: tool calls linked with their results.

Calls and results are hash-joined by identifier, calls are ordered so that each follows those it depends on, arguments are
validated against the tools' schemas, and every call comes out as one line of canonical JSON (keys sorted, no
space, no missing keys). A conversation's calls stay rows: nothing gathers a conversation into one value or one task.

Order. A call's level is one more than the highest of those it depends on, 0 if there is none. Levels are found in rounds that
settle what hangs on settled calls alone, and that hang a call which waits for a call with one open dependency on that
dependency instead: a chain halves each round. Calls on a cycle, or behind one, get no level and come last. Places in a
conversation come from ranges of its order, numbered each and added up.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Tool -> parameter -> (type, required). Types: string, integer, number, boolean, object, array.
Schemas = dict[str, dict[str, tuple[str, bool]]]
#: What the messages of `conversations` are read as, see `turns_as_calls`.
REPLY: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True)}}
CALL = "struct<id:string,name:string,arguments:string,after:array<string>>"


def extracted(messages: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages hold as JSON objects.

    {"tool_calls": [{"id", "name", "arguments", "after": [ids]}]} holds calls, {"tool_call_id", "content"} a result. Arguments are a JSON value or
    a string of JSON. A text that is null or no such object holds nothing; a result may have a null id.
    """
    body = F.when(F.col(text_col).startswith("{"), F.try_parse_json(text_col))
    rows = messages.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), body.alias("body")).where("body IS NOT NULL")
    calls = rows.select("conv_id", "turn", F.posexplode(F.try_variant_get("body", "$.tool_calls", "array<variant>")).alias("pos", "call"))
    arguments = F.coalesce(F.try_variant_get("call", "$.arguments", "string"), F.to_json(F.try_variant_get("call", "$.arguments", "variant")))
    calls = calls.select("conv_id", "turn", "pos", F.try_variant_get("call", "$.id", "string").alias("call_id"), F.try_variant_get("call", "$.name", "string").alias("name"), arguments.alias("arguments"), F.try_variant_get("call", "$.after", "array<string>").alias("after"))
    answers = rows.where(F.try_variant_get("body", "$.tool_call_id", "variant").isNotNull())
    results = answers.select("conv_id", "turn", F.try_variant_get("body", "$.tool_call_id", "string").alias("call_id"), F.try_variant_get("body", "$.content", "string").alias("content"))
    return calls, results


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a log of plain turns: a user's turn calls for a reply, and depends on the user's turn two before; the
    assistant's turn that comes next is the result. Ids are conversation and turn."""
    ident = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    asks = messages.where("role = 'user'")
    calls = asks.select("conv_id", "turn", F.lit(0).alias("pos"), ident(turn).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments"), F.when(turn >= 2, F.array(ident(turn - 2))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def errors(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, in the order of the schema; an empty array if nothing is."""
    kinds = {"string": "STRING", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}

    def fits(value: Column, kind: str) -> Column:
        found = F.schema_of_variant(value)
        if kind != "integer":
            return found.rlike(f"^{kinds[kind]}$")
        # An integer is a number without a fraction, however it is written and however long it is.
        number = F.try_variant_get(value, "$", "double")
        return (found == "BIGINT") | (found.startswith("DECIMAL") & F.try_variant_get(value, "$", "string").rlike(r"^-?\d+(\.0*)?$")) | ((found == "DOUBLE") & (number == F.floor(number).cast("double")))

    known = F.lit(None).cast("array<string>")
    for tool, parameters in sorted(schemas.items()):
        found = []
        for p, (kind, required) in sorted(parameters.items()):
            value = F.try_variant_get(parsed, f"$['{p}']", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            wrong = ~missing & ~fits(value, kind)
            found.append(F.when(wrong, F.lit(f"{p} is not {kind}")))
            if required:
                found.append(F.when(missing, F.lit(f"{p} is missing")))
        known = F.when(name == tool, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")).otherwise(known)
    no_object = F.array(F.lit("arguments are no object"))
    return F.when(name.isNull() | ~F.coalesce(name.isin(*sorted(schemas)), F.lit(False)), F.array(F.lit("unknown tool"))).when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), no_object).otherwise(known)


def levels(calls: DataFrame) -> DataFrame:
    """(node, level) of calls (node, conv_id, call_id, after), one row a call_id of a conversation; level null on or behind a cycle.
    Dependencies on unknown calls count for nothing. Rounds grow with the logarithm of the longest chain; each is written."""
    on = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), F.col("node").alias("to"))
    deps = calls.select("node", "conv_id", F.explode(F.array_distinct("after")).alias("on"))
    #: A call's level is at least `least`, and `far` more than that of `to`.
    open_ = written(deps.join(on.hint("shuffle_hash"), (F.col("conv_id") == F.col("c")) & (F.col("on") == F.col("d"))).select("node", "to", F.lit(1).cast("long").alias("far"), F.lit(0).cast("long").alias("least")), "calls-open")
    done = written(calls.select("node").join(open_.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(0).cast("long")), "calls-levels")
    settled, tables = done, [done]
    while not open_.isEmpty():
        waits = open_.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("to").alias("next"), F.max("far").alias("step"), F.max("least").alias("floor"))
        # What a call waits for: a settled one gives a number, one with a single open dependency is passed over.
        via = waits.where("n = 1 AND next <> node").join(settled.select(F.col("node").alias("next")), "next", "left_anti").select(F.col("node").alias("to"), "next", "step", "floor")
        reach = settled.select(F.col("node").alias("to"), "level").join(via.hint("shuffle_hash"), "to", "full_outer")
        met = open_.join(reach.hint("shuffle_hash"), "to", "left").select(
            "node", F.when(F.col("level").isNotNull(), None).otherwise(F.coalesce("next", "to")).alias("to"), F.when(F.col("next").isNotNull() & F.col("level").isNull(), F.col("far") + F.col("step")).otherwise(F.col("far")).alias("far"),
            F.greatest("least", F.col("far") + F.coalesce("level", "floor")).alias("least"))
        met = met.groupBy("node", "to").agg(F.max("far").alias("far"), F.max("least").alias("least"))
        met = written(met, "calls-met")
        floor = met.groupBy("node").agg(F.max("least").alias("floor"), F.count("to").alias("n"))
        settled = written(floor.where("n = 0").select("node", F.col("floor").alias("level")), "calls-levels")
        if settled.isEmpty():
            break
        tables.append(settled)
        open_ = written(met.where("to IS NOT NULL").join(floor.hint("shuffle_hash"), "node").select("node", "to", "far", F.col("floor").alias("least")), "calls-open")
    found = functools.reduce(DataFrame.unionByName, tables)
    return calls.select("node").join(found.hint("shuffle_hash"), "node", "left").select("node", F.col("level").cast("int").alias("level"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with their number, from 1, in the order inside a group. A large group is no task of its own: ranges of the whole
    order are numbered each, and the counts of a group's earlier ranges are added."""
    keys = [group, *order]
    dealt = written(rows.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()), "calls-order")
    before = Window.partitionBy("g").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col(group).alias("g"), F.col("range_")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("g", F.col("range_").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range_", group).orderBy(*order)
    nth = dealt.withColumn("nth", F.row_number().over(inside))
    return nth.join(counts.hint("shuffle_hash"), (F.col("range_") == F.col("r")) & F.col(group).eqNullSafe(F.col("g"))).withColumn("nth", (F.col("nth") + F.col("before")).cast("int")).drop("g", "r", "before", "range_")


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, call_id, name, level, place, status, errors, result_turn, json: a row per call and per result that is not linked.

    calls: (conv_id, turn, pos, call_id, name, arguments, after); results: (conv_id, turn, call_id, content). Status: answered, unanswered, duplicate
    (a call whose id an earlier one of the conversation has; it is linked with nothing), orphan (a result without call), extra
    (a result of a call that an earlier one answers, or one of that turn and lesser text). place numbers a conversation's calls from
    1 in topological order, duplicates, orphans and extras last. Rows that repeat another in all columns count once;
    a null id, or one in no conversation, is never linked, but its row stays.
    """
    calls = written(calls.distinct().withColumn("node", F.monotonically_increasing_id()), "calls")
    results = written(results.distinct().withColumn("node", F.monotonically_increasing_id()), "calls-results")
    named = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    lone = lambda kind: F.concat(F.lit(kind), F.col("node").cast("string"))  # noqa: E731  a key of its own
    keyed = lambda df, kind: df.withColumn("key", F.when(named, F.concat(F.lit("i"), "call_id")).otherwise(lone(kind)))
    first = lambda *order: F.row_number().over(Window.partitionBy("conv_id", "key").orderBy(*order))
    calls = keyed(calls, "c").withColumn("nth", first("turn", "pos", "name", "arguments", F.xxhash64("after")))
    calls = calls.withColumn("key", F.when(F.col("nth") > 1, lone("c")).otherwise(F.col("key")))
    calls = written(calls, "calls-keyed")
    level = levels(calls.where(named & (F.col("nth") == 1)).select("node", "conv_id", "call_id", "after"))
    answers = keyed(results, "r").withColumn("again", first("turn", "content"))
    a, r = calls.alias("a"), answers.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("key").alias("r_key"), F.col("turn").alias("result_turn"), "content", "again").hint("shuffle_hash").alias("r")
    both = a.join(r, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("key") == F.col("r_key")), "full_outer")
    state = F.when(F.col("node").isNull(), "orphan").when(F.col("nth") > 1, "duplicate").when(F.col("r_key").isNull(), "unanswered").when(F.col("again") > 1, "extra").otherwise("answered")
    own = F.col("status").isin("answered", "unanswered", "duplicate")
    both = both.withColumn("status", state).select(
        F.when(F.col("node").isNull(), F.col("r_conv")).otherwise(F.col("conv_id")).alias("conv_id"), F.when(F.col("node").isNull(), F.col("r_id")).otherwise(F.col("call_id")).alias("call_id"), "status", "result_turn", "content",
        F.when(own, F.col("turn")).otherwise(F.col("result_turn")).alias("turn"), *[F.when(own, F.col(c)).alias(c) for c in ("node", "pos", "name", "arguments", "after")])
    both = written(both.withColumn("row", F.monotonically_increasing_id()), "calls-linked")
    late = F.col("status").isin("duplicate", "orphan", "extra")
    slim = both.select("conv_id", "row", "node", late.alias("late"), "turn", "pos", "call_id", "name", F.md5(F.col("arguments").cast("binary")).alias("by_arguments"), F.md5(F.col("content").cast("binary")).alias("by_content"))
    slim = slim.join(level.hint("shuffle_hash"), "node", "left").withColumn("by_level", F.when(F.col("late") | F.col("node").isNull(), 0).when(F.col("call_id").isNull() | F.col("conv_id").isNull(), 0).otherwise(F.coalesce("level", F.lit(2147483647))))
    open_level = F.when(~F.col("late") & (F.col("by_level") < 2147483647), F.col("by_level")).cast("int")
    placed = numbered(slim, "conv_id", "late", "by_level", "turn", "pos", "call_id", "name", "by_arguments", "by_content", "row").select("row", F.col("nth").alias("place"), open_level.alias("level"))
    rows = both.join(placed.hint("shuffle_hash"), "row").withColumn("parsed", F.try_parse_json("arguments"))
    wrong = F.when(F.col("node").isNotNull(), errors(F.col("name"), F.col("parsed"), schemas)).otherwise(F.array().cast("array<string>"))
    # Canonical: the keys stand in sorted order here, those of arguments are sorted by the parser.
    parts = [("after", F.to_json(F.coalesce("after", F.array().cast("array<string>")))), ("arguments", F.coalesce(F.to_json("parsed"), F.lit("null"))), ("id", _text("call_id")), ("name", _text("name")), ("result", _text("content")), ("status", _text("status"))]
    line = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts]), F.lit("}"))
    return rows.select("conv_id", "call_id", "name", "level", "place", "status", F.array_join(wrong, "; ").alias("errors"), "result_turn", line.alias("json"))


def _text(name: str) -> Column:
    """A string as JSON, null as null."""
    value = F.to_json(F.array(F.col(name)))
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.substring(value, F.lit(2), F.length(value) - 2))


ORACLE = """
WITH RECURSIVE m AS (SELECT DISTINCT * FROM conversations),
c AS (SELECT conv_id, turn, concat_ws('-', conv_id, turn) AS call_id, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM m WHERE role = 'user'),
r AS (SELECT conv_id, concat_ws('-', conv_id, turn - 1) AS call_id, turn AS result_turn, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM m WHERE role = 'assistant'),
o AS (SELECT conv_id, turn FROM c WHERE nth = 1),
v AS (SELECT conv_id, turn, 0 AS level FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.conv_id = o.conv_id AND p.turn = o.turn - 2)
  UNION ALL SELECT o.conv_id, o.turn, v.level + 1 FROM o JOIN v ON o.conv_id = v.conv_id AND o.turn = v.turn + 2),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(CASE WHEN coalesce(r.nth, 1) = 1 THEN c.turn END, r.result_turn) AS turn, c.turn AS asked, c.text, r.result_turn, r.content,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN c.nth > 1 THEN 'duplicate' WHEN r.call_id IS NULL THEN 'unanswered' WHEN r.nth > 1 THEN 'extra' ELSE 'answered' END AS status
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND c.nth = 1),
k AS (SELECT j.*, status IN ('orphan', 'duplicate', 'extra') AS late, status IN ('orphan', 'extra') AS bare, CASE WHEN status IN ('answered', 'unanswered') THEN v.level END AS level FROM j LEFT JOIN v ON v.conv_id = j.conv_id AND v.turn = j.asked)
SELECT conv_id, call_id, CASE WHEN NOT bare THEN 'reply' END AS name, level::INTEGER AS level,
  row_number() OVER (PARTITION BY conv_id ORDER BY late, level, turn, md5(content))::INTEGER AS place, status,
  CASE WHEN NOT bare AND text IS NULL THEN 'text is missing' ELSE '' END AS errors, result_turn,
  concat('{"after":', CASE WHEN NOT bare AND asked >= 2 THEN concat('["', conv_id, '-', asked - 2, '"]') ELSE '[]' END,
    ',"arguments":', CASE WHEN bare THEN 'null' ELSE concat('{', CASE WHEN text IS NOT NULL THEN concat('"text":', to_json(text), ',') ELSE '' END, '"turn":', asked, '}') END,
    ',"id":', to_json(call_id), ',"name":', CASE WHEN bare THEN 'null' ELSE '"reply"' END,
    ',"result":', coalesce(to_json(content)::VARCHAR, 'null'), ',"status":"', status, '"}') AS json
FROM k
"""
