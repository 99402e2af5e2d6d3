"""Chat formatting: tool-call linking. DataFrame functions only.

Calls and results are joined by identifier, calls are ordered after the calls whose results they name, arguments are
parsed and checked against schemas, and each call is serialised as canonical JSON (keys in order at every depth, no spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import Workspace

def canonical_json(values: Column) -> Column:
    """A map of strings to JSON texts as one JSON object, keys in code-point order."""
    sorted_ = F.array_sort(F.map_entries(values))
    return F.concat(F.lit("{"), F.array_join(F.transform(sorted_, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def json_text(value: Column) -> Column:
    """A string as a JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", "$1")


def parsed_json(text: Column) -> Column:
    """A JSON text as canonical JSON (keys in code-point order at every depth, no spaces, one spelling of a number), null if
    it is not one whole JSON value. Numbers in exponent notation come out as floating point."""
    alone = F.to_json(F.try_parse_json(text))
    inside = F.to_json(F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit(',"b":0}'))))
    return F.when(inside == F.concat(F.lit('{"a":'), alone, F.lit(',"b":0}')), alone)


def fits(argument: Column, kind: Column) -> Column:
    """Whether a canonical JSON text is of a schema's type."""
    own = F.schema_of_variant(F.try_parse_json(argument))
    whole = own.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    return (
        F.when(kind == "string", own == "STRING")
        .when(kind == "integer", whole)
        .when(kind == "number", whole | own.rlike("^(DOUBLE|FLOAT|DECIMAL)"))
        .when(kind == "boolean", own == "BOOLEAN")
        .when(kind == "array", own.startswith("ARRAY"))
        .when(kind == "object", own.startswith("OBJECT"))
        .otherwise(F.lit(False))
    )


def call_levels(calls: DataFrame, needs: DataFrame, space: Workspace) -> DataFrame:
    """(call_id, level): 0 for calls that need no other, else one more than the highest level they need.

    needs has call_id and needed. Needs of unknown calls do not count. Calls on or behind a cycle get null. Each round
    takes the levels found so far, and lets a call that waits for one call only, which itself waits for one only, wait for
    the latter's at their joint distance: chains take as many rounds as their length has binary digits. Rounds end when
    nothing is open, or when none has found a level for so many rounds that any chain would have ended.
    """
    known = calls.filter("call_id is not null").select("call_id").distinct()
    open_ = needs.select("call_id", "needed").distinct().join(known, "call_id", "left_semi").join(known.withColumnRenamed("call_id", "needed"), "needed", "left_semi")
    open_ = space.keep(open_.select("call_id", "needed", F.lit(1).cast("long").alias("far"), F.lit(0).cast("long").alias("low")), "needs")
    levels = space.keep(known.join(open_, "call_id", "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    waiting, idle = open_.select("call_id").distinct().count(), 0
    while waiting and idle <= waiting.bit_length():
        met = open_.join(levels.select(F.col("call_id").alias("needed"), "level"), "needed", "left")
        least = met.groupBy("call_id").agg(F.max(F.greatest("low", F.col("level") + F.col("far"))).alias("least"), F.count_if(F.col("level").isNull()).alias("left"))
        state = space.keep(met.join(least, "call_id"), "state")
        fresh = state.filter("left = 0").select("call_id", F.col("least").alias("level")).distinct()
        still = state.filter("left > 0 and level is null").select("call_id", "needed", "far", F.col("least").alias("low"), "left")
        one = still.filter("left = 1")
        ahead = one.select(F.col("call_id").alias("needed"), F.col("needed").alias("then"), F.col("far").alias("more"), F.col("low").alias("base"))
        jumped = one.join(ahead, "needed", "left").select("call_id", F.coalesce("then", "needed").alias("needed"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.greatest("low", F.col("base") + F.col("far")).alias("low"))
        levels = space.keep(levels.union(fresh), "level")
        open_ = space.keep(jumped.union(still.filter("left > 1").drop("left")), "needs")
        left = open_.select("call_id").distinct().count()
        waiting, idle = left, idle + 1 if left == waiting else 0
    return known.join(levels, "call_id", "left")


def _entries(values: Column) -> Column:
    return F.coalesce(F.array_sort(F.map_entries(values)), F.array().cast("array<struct<key:string,value:string>>"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, space: Workspace) -> DataFrame:
    """One row per call: conv_id, call_id, turn, name, level, n_results, valid, problems, json.

    calls: conv_id, call_id, turn, name, arguments (map of names to JSON texts), needs (array of call_ids).
    results: call_id, turn, content; several results of one call are joined in turn order, by one of each content.
    schemas: name, argument, kind (string, integer, number, boolean, array, object), required. A call without schema, with
    an unknown or ill-typed argument, with one that is no JSON, or without a required one has problems. Calls are in
    topological order by (level, turn, call_id). Of calls with one id the least by (turn, name, arguments) stays; calls
    without id all stay, on level 0 and without results. A text that is no JSON is serialised as a string, and a null
    argument as null. Results without call are left out (lone_results reports them); other columns are ignored. Empty tables
    give an empty table.
    """
    own = ["conv_id", "turn", "name", "arguments", "needs"]
    plain = calls.select("call_id", "conv_id", F.col("turn"), "name", _entries(F.col("arguments")).alias("arguments"), "needs")
    named = plain.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "name", "arguments", "conv_id", "needs")).alias("c")).select("call_id", *(F.col(f"c.{k}") for k in own))
    named = space.keep(named.withColumn("row", F.col("call_id")).union(plain.filter("call_id is null").select("call_id", *own, F.concat(F.lit("\0"), F.uuid()).alias("row"))), "calls")
    levels = call_levels(named, named.select("call_id", F.explode("needs").alias("needed")), space)

    given = named.select("row", "name", F.explode("arguments").alias("x")).select("row", "name", F.col("x.key").alias("argument"), F.coalesce("x.value", F.lit("null")).alias("value"))
    given = given.withColumn("parsed", parsed_json(F.col("value")))
    checked = given.join(schemas.select("name", "argument", "kind").dropDuplicates(["name", "argument"]), ["name", "argument"], "left")
    wrong = F.when(F.col("parsed").isNull(), "json:").when(F.col("kind").isNull(), "unknown:").when(~F.coalesce(fits(F.col("parsed"), F.col("kind")), F.lit(False)), "type:")
    checked = checked.select("row", "argument", F.coalesce("parsed", json_text(F.col("value"))).alias("value"), F.concat(wrong, "argument").alias("problem"))
    checked = checked.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("argument", "value"))).alias("values"), F.collect_set("problem").alias("problems"))
    needed = schemas.groupBy("name").agg(F.collect_set(F.when(F.col("required"), F.col("argument"))).alias("required"), F.lit(True).alias("has"))
    answers = results.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_results"), F.transform(F.sort_array(F.collect_set(F.struct("turn", "content"))), lambda x: x["content"]).alias("contents"))
    out = named.join(levels, "call_id", "left").join(answers, "call_id", "left").join(checked, "row", "left").join(needed, "name", "left")
    empty = F.array().cast("array<string>")
    missing = F.transform(F.array_except(F.coalesce("required", empty), F.transform("arguments", lambda x: x["key"])), lambda x: F.concat(F.lit("missing:"), x))
    problems = F.sort_array(F.concat(F.coalesce("problems", empty), missing, F.when(F.col("has").isNull(), F.array(F.lit("no schema"))).otherwise(empty)))
    body = F.create_map(
        F.lit("arguments"), canonical_json(F.coalesce("values", F.create_map().cast("map<string,string>"))),
        F.lit("id"), F.coalesce(json_text(F.col("call_id")), F.lit("null")),
        F.lit("name"), F.coalesce(json_text(F.col("name")), F.lit("null")),
        F.lit("results"), F.coalesce(F.to_json("contents"), F.lit("[]")),
    )
    out = out.withColumn("problems", problems)
    level = F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")).cast("int").alias("level")
    return out.select("conv_id", "call_id", "turn", "name", level, F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), (F.size("problems") == 0).alias("valid"), F.array_join("problems", ",").alias("problems"), canonical_json(body).alias("json"))


def lone_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results (conv_id, call_id, turn, content) whose call is not in calls, as rows like those of link_calls: one for each
    call_id, or for each conversation and turn if that is null, on level 0, with the problem "no call" and without name and
    arguments. Rows that repeat a content are counted and serialised once. Empty tables give an empty table."""
    lone = results.join(calls.filter("call_id is not null").select("call_id"), "call_id", "left_anti")
    alone = F.when(F.col("call_id").isNull(), F.struct("conv_id", "turn"))
    lone = lone.groupBy("call_id", alone.alias("alone")).agg(F.min("conv_id").alias("conv_id"), F.min("turn").alias("turn"), F.count("*").alias("n_results"), F.transform(F.sort_array(F.collect_set(F.struct("turn", "content"))), lambda x: x["content"]).alias("contents"))
    said = F.create_map(F.lit("id"), F.coalesce(json_text(F.col("call_id")), F.lit("null")), F.lit("results"), F.to_json("contents"))
    return lone.select("conv_id", "call_id", "turn", F.lit(None).cast("string").alias("name"), F.lit(0).alias("level"), "n_results", F.lit(False).alias("valid"), F.lit("no call").alias("problems"), canonical_json(said).alias("json"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations, whose turns name no tools.

    A user's turn is a call, named by its form (question with a question mark, else statement), with its text, its number
    of words and, if it is the conversation's first, the text of its system turns as arguments; it needs the user's turn
    before it. Every other turn that is not a system's is a result of the latest call at its turn or before, whatever its
    role; one without a call before it has no call_id. Rows without conversation or turn are left out; different texts of
    one turn and role are one text, joined in their order.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn", "role").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("text"))
    ident = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    system = turns.filter("role = 'system'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("system"))
    asked = turns.filter("role = 'user'").withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).join(system, "conv_id", "left")
    order = Window.partitionBy("conv_id").orderBy("turn", ~F.col("role").eqNullSafe("user"))
    said = turns.filter("role is null or role <> 'system'").withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(order)).filter("role is null or role <> 'user'")
    results = said.select("conv_id", F.when(F.col("asked").isNotNull(), ident(F.col("asked"))).alias("call_id"), "turn", F.col("text").alias("content"))
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    arguments = F.create_map(F.lit("text"), json_text(F.col("text")), F.lit("n_words"), words.cast("string"))
    led = F.create_map(F.lit("text"), json_text(F.col("text")), F.lit("n_words"), words.cast("string"), F.lit("system"), json_text(F.array_join("system", "\n")))
    arguments = F.when(F.col("before").isNull() & F.col("system").isNotNull(), led).otherwise(arguments)
    needs = F.when(F.col("before").isNotNull(), F.array(ident(F.col("before")))).otherwise(F.array().cast("array<string>"))
    return asked.select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.when(F.col("text").contains("?"), "question").otherwise("statement").alias("name"), arguments.alias("arguments"), needs.alias("needs")), results


SCHEMAS = T.StructType([T.StructField("name", T.StringType()), T.StructField("argument", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("required", T.BooleanType())])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Calls of plain conversations, linked, and their turns without a call: see turns_as_calls, link_calls and lone_results."""
    spark = conversations.sparkSession
    space = Workspace(spark, "chat")
    calls, results = turns_as_calls(conversations)
    schemas = spark.createDataFrame([(n, a, k, must) for n in ("question", "statement") for a, k, must in (("text", "string", True), ("n_words", "integer", True), ("system", "string", False))], SCHEMAS)
    calls, results = space.keep(calls, "calls"), space.keep(results, "results")
    return link_calls(calls, results, schemas, space).union(lone_results(calls, results))
