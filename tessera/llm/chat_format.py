"""Chat formatting with tool-call linking, in DataFrame functions only.

A message is a call message if its text is a JSON object with a tool_calls array of {id, name, arguments}, and a result
message if its role is tool and its text is a JSON object with tool_call_id. Calls and results are hash-joined by
conversation and identifier. A result depends on its call, a call on the results that its arguments name as
"$ref:<id>"; messages are ordered by their turn, but none before what it depends on: order_turn is the greatest turn
along its dependencies and order_depth counts those at that turn, so (order_turn, order_depth, turn) sorts a
conversation. Dependencies are resolved round by round, one round for each step of the longest chain; messages on a
cycle are never resolved and keep their own turn (in_cycle). Messages without calls or results depend on nothing and
are not joined. Arguments are held against the schema of the tool: it must
be known, no required argument may be missing, none may be unknown or of another type. Each message becomes one line of
canonical JSON (sorted keys, no spaces, arguments as objects); a call message keeps its content and the object's other
fields, but for role, which is the row's.

All work is by row or by call: no conversation is gathered, so one may hold any share of all rows.

Defined cases: a null text has content null; null or empty texts and other JSON have no calls; a null conv_id or turn is
kept and never linked; of several calls (or results) with one identifier in a conversation, the first by turn counts for
the link, all are serialised; repeated rows each come out; other columns are not read; broken JSON is plain content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

# The tools of the production query (tool, argument, type, required).
TOOLS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
    ("weather", "city", "string", True),
    ("weather", "days", "integer", False),
    ("python", "code", "string", True),
)
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"


def tool_table(spark: SparkSession, tools=TOOLS) -> DataFrame:
    """(name, argument, kind, required) of the tools, a list given as a parameter."""
    if not tools:
        return spark.range(0).select(F.lit("").alias("name"), F.lit("").alias("argument"), F.lit("").alias("kind"), F.lit(True).alias("required"))
    rows = [F.struct(F.lit(n).alias("name"), F.lit(a).alias("argument"), F.lit(k).alias("kind"), F.lit(r).alias("required")) for n, a, k, r in tools]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _kind(value):
    """The JSON type of a variant."""
    said = F.schema_of_variant(value)
    return (
        F.when(said.isNull() | (said == "VOID"), "null").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said == "BIGINT", "integer")
        .when(said.startswith("DECIMAL") | (said == "DOUBLE") | (said == "FLOAT"), "number").when(said.startswith("ARRAY"), "array").otherwise("object")
    )


def _kind_fits(found, wanted):
    return (found == wanted) | ((wanted == "number") & (found == "integer"))


def _text(value):
    """A string as JSON; null stays."""
    said = F.to_json(F.array(value))
    return F.when(value.isNotNull(), said.substr(F.lit(2), F.length(said) - 2))


def _entry(key, value):
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def _object(entries):
    """A JSON object of entries (key, value as JSON)."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def check_arguments(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls(conv_id, turn, nth, name, arguments) with column valid."""
    key = ["conv_id", "turn", "nth"]
    # the tools are a parameter list, so these joins are with a table of fixed size
    names = tools.groupBy("name").agg(F.collect_set(F.when(F.col("required"), F.col("argument"))).alias("required"), F.map_from_entries(F.collect_list(F.struct("argument", "kind"))).alias("kinds"))
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments")).withColumn("given", F.expr("try_variant_get(parsed, '$', 'map<string,variant>')"))
    joined = parsed.join(F.broadcast(names), "name", "left")
    kinds = F.transform_values("given", lambda k, v: _kind(v))
    good = (
        F.col("kinds").isNotNull() & F.col("given").isNotNull()
        & (F.size(F.array_except("required", F.map_keys("given"))) == 0)
        & F.forall(F.map_entries(kinds), lambda e: F.coalesce(_kind_fits(e["value"], F.try_element_at("kinds", e["key"])), F.lit(False)))
    )
    return joined.withColumn("valid", F.coalesce(good, F.lit(False))).select(*key, "call_id", "name", "arguments", "valid")


def order(messages: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, turn, order_turn, order_depth, in_cycle) of the turns that needs(conv_id, turn, on) mentions.

    Round by round, a turn whose needs are all resolved takes its place behind the last of them.
    """
    key = ["conv_id", "turn"]
    needs = cut(needs.distinct())
    nodes = cut(needs.select(*key).union(needs.select("conv_id", F.col("on").alias("turn"))).distinct())
    free = nodes.join(needs.select(*key).distinct(), key, "left_anti")
    done = cut(free.select(*key, F.col("turn").alias("order_turn"), F.lit(0).alias("order_depth")))
    while True:
        before = done.select("conv_id", F.col("turn").alias("on"), "order_turn", "order_depth")
        waiting = needs.join(done.select(*key), key, "left_anti").join(before, ["conv_id", "on"], "left")
        ready = waiting.groupBy(*key).agg(F.bool_and(F.col("order_turn").isNotNull()).alias("all"), F.max(F.struct("order_turn", "order_depth")).alias("last")).where("all")
        moved = cut(ready.select(*key, F.greatest("turn", "last.order_turn").alias("order_turn"), F.when(F.col("turn") > F.col("last.order_turn"), 0).otherwise(F.col("last.order_depth") + 1).alias("order_depth")))
        if moved.isEmpty():
            break
        done = cut(done.union(moved))
    return nodes.join(done, key, "left").select(*key, F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_depth", F.lit(0)).alias("order_depth"), F.col("order_turn").isNull().alias("in_cycle"))


def format_messages(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, turn, role, order_turn, order_depth, n_calls, n_answered, n_invalid, answers_turn, in_cycle, message for each row of messages(conv_id, turn, role, text)."""
    rows = messages.select("conv_id", "turn", "role", "text")
    objectlike = F.col("text").rlike(r"^\s*\{")
    calls_of = F.when(objectlike, F.from_json("text", _CALLS)["tool_calls"])
    answer_of = F.when(objectlike & (F.col("role") == "tool"), F.get_json_object("text", "$.tool_call_id"))
    has_calls = F.coalesce(F.size(calls_of) > 0, F.lit(False))
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    none = F.lit(0).cast("long")
    special = has_calls | answer_of.isNotNull()
    exploded = rows.where(has_calls).select("conv_id", "turn", F.posexplode(calls_of).alias("nth", "c")).select("conv_id", "turn", "nth", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"))
    calls = cut(check_arguments(exploded.distinct(), tools))
    results = cut(rows.where(answer_of.isNotNull()).select("conv_id", "turn", answer_of.alias("call_id")).distinct())
    by_id = ["conv_id", "call_id"]
    first_call = calls.groupBy(*by_id).agg(F.min("turn").alias("call_turn"))
    first_result = results.groupBy(*by_id).agg(F.min("turn").alias("result_turn"))
    links = cut(results.join(first_call, by_id))
    refs = calls.select("conv_id", "turn", F.explode(F.regexp_extract_all("arguments", F.lit(r'"\$ref:([^"]+)"'), F.lit(1))).alias("call_id")).join(first_result, by_id)
    needs = links.select("conv_id", "turn", F.col("call_turn").alias("on")).union(refs.select("conv_id", "turn", F.col("result_turn").alias("on")))
    ordered = order(rows, needs.where("turn is not null and on is not null"))
    answered = first_result.join(first_call, by_id).select(*by_id, F.lit(True).alias("answered"))
    per_turn = (
        calls.join(answered, by_id, "left").groupBy("conv_id", "turn")
        .agg(F.count("*").alias("n_calls"), F.count_if(F.coalesce("answered", F.lit(False))).alias("n_answered"), F.count_if(~F.col("valid")).alias("n_invalid"))
    )
    per_result = links.groupBy("conv_id", "turn").agg(F.min("call_turn").alias("answers_turn"))
    canonical = F.transform(
        calls_of,
        lambda c: _object(
            F.array(
                _entry("arguments", F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), _text(c["arguments"]), F.lit("{}"))),
                _entry("id", F.coalesce(_text(c["id"]), F.lit("null"))),
                _entry("name", F.coalesce(_text(c["name"]), F.lit("null"))),
            )
        ),
    )
    # the object's other fields stay; its role is that of the row
    given = F.expr("try_variant_get(try_parse_json(text), '$', 'map<string,variant>')")
    own = F.map_entries(F.map_filter(given, lambda k, v: ~k.isin("role", "tool_calls", "content")))
    others = F.coalesce(F.transform(own, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))
    content = F.coalesce(F.to_json(F.try_element_at(given, F.lit("content"))), F.lit("null"))
    known = F.array(_entry("content", content), _entry("role", F.coalesce(_text(F.col("role")), F.lit("null"))), _entry("tool_calls", F.concat(F.lit("["), F.array_join(canonical, ","), F.lit("]"))))
    called = _object(F.array_sort(F.concat(known, others)))
    # only messages with calls or results are joined; all others keep their place and need no shuffle
    key = ["conv_id", "turn"]
    linked = rows.where(special).withColumn("message", F.when(has_calls, called).otherwise(plain))
    both = linked.join(per_turn, key, "left").join(per_result, key, "left").join(ordered, key, "left")
    zero = lambda c: F.coalesce(c, none).alias(c)
    placed = both.select("conv_id", "turn", "role", F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_depth", F.lit(0)).alias("order_depth"), zero("n_calls"), zero("n_answered"), zero("n_invalid"), "answers_turn", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), "message")
    rest = rows.where(~special).select("conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_depth"), none.alias("n_calls"), none.alias("n_answered"), none.alias("n_invalid"), F.lit(None).cast("long").alias("answers_turn"), F.lit(False).alias("in_cycle"), plain.alias("message"))
    return rest.unionByName(placed)
