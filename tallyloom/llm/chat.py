"""Chat formatting: tool calls and results linked, ordered, validated and written as canonical JSON.

In DataFrame functions only.  A message's text is plain, or a JSON object:

* an assistant's may have ``tool_calls``: objects with ``id``, ``name``, ``arguments`` (an
  object, or a string that holds one) and, if a call needs others' results, ``after``: ids;
* a tool's has ``tool_call_id`` and ``content``;
* a system's may have ``tools``: objects with ``name`` and ``parameters`` in the manner of
  JSON schema.  ``type``, ``properties``, ``required``, ``additionalProperties`` (if false),
  ``items``, ``enum``, ``minimum``, ``maximum``, ``minLength`` and ``maxLength`` are held
  against the arguments, at any depth; other keywords aren't.

Calls and results meet in a hash join on conversation and id.  Calls are ordered by level:
one above the highest call they come after, found by joining the last level with what waits
for it until none is added, however deep; a
message's calls are written in that order.  A conversation in order of (anchor_turn, level,
turn), nulls last, has every result after its call, and results in the order in which the
calls need them; messages are never gathered by conversation, so one of any length is no
single task's work.  Plain messages, all but a few, are formatted where they
are read.

Defined results: null texts are messages with null content; texts that aren't such JSON, or
not of a fitting role, are plain; of calls with one id in a conversation the first counts
and the rest are repeats without links; a result without its call is an orphan and keeps its
turn; calls in a cycle have no level; a call to a tool without a schema isn't validated; a call doesn't wait for calls of later messages or for
unknown ids; arguments that are missing or null count as an empty object; numbers keep the
digits they are written with;
rows that are alike come out alike; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, table

#: Levels that are read together again as one table, so that a deep chain's plan stays small.
COMPACT = 32

_JSON_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}


def _literal(text: Column) -> Column:
    """A JSON string, or null."""
    written = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(written, F.lit(6), F.length(written) - 6))


def _object(*fields: tuple[str, Column]) -> Column:
    """A JSON object of values that are JSON already, keys in order."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields, key=lambda f: f[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _shape(v: Column) -> Column:
    """BIGINT, STRING, OBJECT and so on: the first word of a variant's schema."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _of_types(v: Column, names: Column) -> Column:
    """Whether a variant is of one of the types of JSON schema; unknown names are no type."""
    shape = _shape(v)
    number = shape.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    whole = number & (F.expr("try_variant_get(value, '$', 'double')") % 1 == 0)
    known = F.create_map(*[F.lit(x) for pair in _JSON_TYPES.items() for x in pair])
    return F.exists(names, lambda n: F.when(n == "number", number).when(n == "integer", whole).otherwise(F.coalesce(shape == F.element_at(known, n), F.lit(False))))


def _calls(messages: DataFrame) -> DataFrame:
    """A row for each call: conv_id, key and turn of its message, index, id, name, arguments, after."""
    listed = messages.select("conv_id", "key", "turn", F.expr("posexplode(try_variant_get(body, '$.tool_calls', 'array<variant>'))").alias("index", "call"))
    raw = F.expr("variant_get(call, '$.arguments')")
    inner = F.expr("try_parse_json(try_variant_get(call, '$.arguments', 'string'))")
    return listed.select(
        "conv_id",
        "key",
        "turn",
        "index",
        F.expr("try_variant_get(call, '$.id', 'string')").alias("id"),
        F.expr("try_variant_get(call, '$.name', 'string')").alias("name"),
        F.when(_shape(raw) == "STRING", F.coalesce(inner, raw)).otherwise(raw).alias("arguments"),
        F.expr("try_variant_get(call, '$.after', 'array<string>')").alias("after"),
    )


#: A step to the items of an array; keys are written as in JSON pointers.
_ITEMS = "/\x00"


def _step(key: str) -> Column:
    return F.concat(F.col("path"), F.lit("/"), F.replace(F.replace(F.col(key), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def _nested(first: DataFrame, deeper) -> DataFrame:
    """``first`` and all that ``deeper`` finds below it, level by level."""
    now = materialised(first)
    found = now
    while now.head(1):
        now = materialised(deeper(now))
        found = found.unionByName(now)
    return found


def _schemas(systems: DataFrame) -> DataFrame:
    """A row for each place in the schema of a conversation's tool, with what holds there."""
    tools = systems.select("conv_id", F.expr("explode(try_variant_get(body, '$.tools', 'array<variant>'))").alias("tool"))
    named = tools.select(
        "conv_id",
        F.expr("try_variant_get(tool, '$.name', 'string')").alias("name"),
        F.lit("").alias("path"),
        F.expr("to_json(coalesce(try_variant_get(tool, '$.parameters', 'variant'), parse_json('{}')))").alias("schema"),
    ).dropDuplicates(["conv_id", "name"])

    def deeper(rows: DataFrame) -> DataFrame:
        read = rows.withColumn("v", F.try_parse_json("schema"))
        properties = read.select("conv_id", "name", "path", F.expr("explode(try_variant_get(v, '$.properties', 'map<string,variant>'))").alias("key", "below"))
        items = read.select("conv_id", "name", F.concat("path", F.lit(_ITEMS)).alias("path"), F.expr("try_variant_get(v, '$.items', 'variant')").alias("below")).filter("below IS NOT NULL")
        both = properties.select("conv_id", "name", _step("key").alias("path"), "below").unionByName(items)
        return both.select("conv_id", "name", "path", F.to_json("below").alias("schema"))

    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    root = F.when(F.col("path") == "", F.array(F.lit("object")))
    closed = F.coalesce(get("additionalProperties", "boolean") == F.lit(False), F.lit(False))
    return _nested(named, deeper).withColumn("v", F.try_parse_json("schema")).select(
        "conv_id",
        "name",
        "path",
        F.coalesce(get("type", "array<string>"), F.when(_shape(F.expr("try_variant_get(v, '$.type', 'variant')")) == "STRING", F.array(get("type", "string"))), root).alias("types"),
        F.coalesce(get("required", "array<string>"), F.array().cast("array<string>")).alias("required"),
        F.when(closed, F.coalesce(F.map_keys(get("properties", "map<string,variant>")), F.array().cast("array<string>"))).alias("allowed"),
        F.transform(get("enum", "array<variant>"), lambda x: F.to_json(x)).alias("enum"),
        *[get(k, "double").alias(k) for k in ("minimum", "maximum", "minLength", "maxLength")],
    )


def _invalid(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(key, index, faults) of calls to tools with a schema: places of the arguments at which they break it."""
    known = calls.join(schemas.select("conv_id", "name").distinct(), ["conv_id", "name"], "left_semi")
    given = F.when(F.coalesce(_shape(F.col("arguments")), F.lit("VOID")) == "VOID", F.lit("{}")).otherwise(F.to_json("arguments"))
    roots = known.select("conv_id", "key", "index", "name", F.lit("").alias("path"), given.alias("value"))

    def deeper(rows: DataFrame) -> DataFrame:
        read = rows.withColumn("v", F.parse_json("value"))
        fields = read.select("conv_id", "key", "index", "name", "path", F.expr("explode(try_variant_get(v, '$', 'map<string,variant>'))").alias("step", "below"))
        items = read.select("conv_id", "key", "index", "name", F.concat("path", F.lit(_ITEMS)).alias("path"), F.expr("explode(try_variant_get(v, '$', 'array<variant>'))").alias("below"))
        both = fields.select("conv_id", "key", "index", "name", _step("step").alias("path"), "below").unionByName(items)
        # what no schema speaks of needn't be looked into
        return both.select("conv_id", "key", "index", "name", "path", F.to_json("below").alias("value")).join(schemas.select("conv_id", "name", "path"), ["conv_id", "name", "path"], "left_semi")

    places = _nested(roots, deeper).join(schemas, ["conv_id", "name", "path"]).withColumn("written", F.col("value")).withColumn("value", F.parse_json("written"))
    keys = F.map_keys(F.expr("try_variant_get(value, '$', 'map<string,variant>')"))
    shape = _shape(F.col("value"))
    number = F.when(~shape.isin("STRING", "OBJECT", "ARRAY", "BOOLEAN", "VOID"), F.expr("try_variant_get(value, '$', 'double')"))
    length = F.when(shape == "STRING", F.length(F.expr("try_variant_get(value, '$', 'string')")))
    broken = [
        ~_of_types(F.col("value"), F.col("types")),
        (shape == "OBJECT") & (F.size(F.array_except("required", keys)) > 0),
        (shape == "OBJECT") & (F.size(F.array_except(keys, F.col("allowed"))) > 0),
        ~F.array_contains("enum", F.col("written")),
        (number < F.col("minimum")) | (number > F.col("maximum")),
        (length < F.col("minLength")) | (length > F.col("maxLength")),
    ]
    wrong = F.lit(False)
    for b in broken:
        wrong = wrong | F.coalesce(b, F.lit(False))
    return places.groupBy("key", "index").agg(F.count_if(wrong).alias("faults"))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of calls, each id once; without a level where calls wait for each other."""
    ids = calls.select("conv_id", "id").distinct()
    needs = calls.select("conv_id", "id", "turn", F.explode("after").alias("need"))
    known = calls.select("conv_id", F.col("id").alias("need"), F.col("turn").alias("need_turn"))
    waits = materialised(needs.join(known, ["conv_id", "need"]).filter("need_turn <= turn").select("conv_id", "id", "need").distinct())
    waiting = waits.groupBy("conv_id", "id").agg(F.count("*").alias("open"))
    # calls that wait for so many others, and the level that they have reached
    state = materialised(ids.join(waiting, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("level")))
    done = [state.filter("open = 0").drop("open")]
    while done[-1].head(1) and state.filter("open > 0").head(1):
        met = waits.join(done[-1].withColumnRenamed("id", "need"), ["conv_id", "need"]).groupBy("conv_id", "id").agg(F.count("*").alias("met"), F.max("level").alias("highest"))
        rest = state.filter("open > 0").join(met, ["conv_id", "id"], "left")
        state = materialised(rest.select("conv_id", "id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("level", F.coalesce(F.col("highest") + 1, F.lit(0))).alias("level")))
        done.append(state.filter("open = 0").drop("open"))
        if len(done) > COMPACT:
            done = [materialised(reduce(DataFrame.unionByName, done[:-1])), done[-1]]
    return ids.join(reduce(DataFrame.unionByName, done), ["conv_id", "id"], "left")


def formatted(conversations: DataFrame) -> DataFrame:
    """A row for each message (conv_id, turn, role, text) with its JSON, place and links."""
    body = F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text"))
    has = lambda path, kind: F.expr(f"try_variant_get(body, '{path}', '{kind}')").isNotNull()
    kind = (
        F.when((F.col("role") == "assistant") & has("$.tool_calls", "array<variant>"), "call")
        .when((F.col("role") == "tool") & has("$.tool_call_id", "string"), "result")
        .when((F.col("role") == "system") & has("$.tools", "array<variant>"), "tools")
        .otherwise("plain")
    )
    read = conversations.select("conv_id", "turn", "role", "text", body.alias("body")).withColumn("kind", kind)
    plain = read.filter(F.col("kind").isin("plain", "tools")).select(
        "conv_id",
        "turn",
        "role",
        "kind",
        F.when(F.col("kind") == "plain", _object(("content", _literal(F.col("text"))), ("role", _literal(F.col("role")))))
        .otherwise(_object(("content", F.to_json("body")), ("role", _literal(F.col("role")))))
        .alias("message"),
        F.col("turn").alias("anchor_turn"),
        F.lit(0).alias("level"),
        F.lit(0).cast("long").alias("n_calls"),
        F.lit(0).cast("long").alias("n_linked"),
        F.lit(0).cast("long").alias("n_invalid"),
    )
    keyed = materialised(
        read.filter(F.col("kind").isin("call", "result", "tools")).select(
            "*", F.xxhash64("conv_id", "turn", "role", "text").alias("key")
        ).drop("body")
    ).withColumn("body", F.parse_json("text"))

    every = _calls(keyed.filter("kind = 'call'").dropDuplicates(["key"]))
    first = every.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "key", "index")).alias("f"))
    calls = every.join(first.select(F.col("f.key").alias("key"), F.col("f.index").alias("index"), F.col("id").alias("own")), ["key", "index"], "left")
    chosen = calls.filter(F.col("own").isNotNull()).drop("own")
    results = keyed.filter("kind = 'result'").withColumn("id", F.expr("variant_get(body, '$.tool_call_id', 'string')"))
    answered = results.select("conv_id", "id").distinct().withColumn("answered", F.lit(1))
    levels = _levels(chosen)
    place = chosen.select("conv_id", "id", F.col("turn").alias("call_turn")).join(levels, ["conv_id", "id"])
    faults = _invalid(calls, _schemas(keyed.filter("kind = 'tools'").dropDuplicates(["key"])))

    linked = calls.join(answered, ["conv_id", "id"], "left").join(levels, ["conv_id", "id"], "left").join(faults, ["key", "index"], "left")
    one = _object(
        ("arguments", F.coalesce(F.to_json("arguments"), F.lit("null"))),
        ("id", _literal(F.col("id"))),
        ("name", _literal(F.col("name"))),
    )
    by_message = _by_message(linked.withColumn("one", one))
    content = F.expr("variant_get(body, '$.content')")
    call_rows = keyed.filter("kind = 'call'").join(by_message, "key", "left").select(
        "conv_id",
        "turn",
        "role",
        "kind",
        _object(
            ("content", F.coalesce(F.to_json(content), F.lit("null"))),
            ("role", _literal(F.col("role"))),
            ("tool_calls", F.concat(F.lit("["), F.coalesce("calls", F.lit("")), F.lit("]"))),
        ).alias("message"),
        F.col("turn").alias("anchor_turn"),
        F.lit(0).alias("level"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("n_invalid", F.lit(0)).cast("long").alias("n_invalid"),
    )
    result_rows = results.join(place, ["conv_id", "id"], "left").select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("call_turn").isNull(), "orphan").otherwise("result").alias("kind"),
        _object(
            ("content", F.coalesce(F.to_json(content), F.lit("null"))),
            ("role", _literal(F.col("role"))),
            ("tool_call_id", _literal(F.col("id"))),
        ).alias("message"),
        F.coalesce("call_turn", "turn").alias("anchor_turn"),
        F.when(F.col("call_turn").isNull(), 0).otherwise(F.col("level") + 1).cast("int").alias("level"),
        F.lit(0).cast("long").alias("n_calls"),
        F.col("call_turn").isNotNull().cast("long").alias("n_linked"),
        F.lit(0).cast("long").alias("n_invalid"),
    )
    return plain.unionByName(call_rows).unionByName(result_rows)


def _by_message(linked: DataFrame) -> DataFrame:
    """A message's calls; their number is bounded by the length of its text."""
    return linked.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("level").isNull().alias("none"), "level", "index", "one"))).alias("list"),
        F.count("*").alias("n_calls"),
        F.sum(F.when(F.col("own").isNotNull(), F.coalesce("answered", F.lit(0))).otherwise(0)).alias("n_linked"),
        F.count_if(F.col("faults") > 0).alias("n_invalid"),
    ).withColumn("calls", F.concat_ws(",", F.col("list.one")))


def op3_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of all conversations as canonical JSON, with its place and links."""
    return formatted(table(spark, sf_dir, "conversations"))


#: For conversations without tool calls, results and tools; tests hold those against expected messages.
ORACLE_SQL = """
SELECT conv_id, turn, role, 'plain' AS kind,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS message,
  turn AS anchor_turn, 0 AS level, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid
FROM conversations
"""
