"""Chats as canonical JSON lines, with tool calls linked to their results.

A turn may hold tool calls (``{"tool_calls": [{"id", "name", "arguments",
"after"}, ...]}``) or a result (``{"tool_call_id", "content"}``); any other user
turn counts as a call of ``reply`` named by conversation and turn, any other
assistant turn as the result of the turn before it, all else as a message.

Calls and results meet in a hash join on conversation and identifier, which both
sides reach pre-aggregated to one row per identifier. They are ordered so that a
call comes before its result and after the results it names: every event has the
place ``(at, depth)``, its own turn unless something it needs comes later, then
that turn and a greater depth (the longest way from there). Only conversations in
which something needs what comes later are looked at further. There every event
chooses the need that pushes it back furthest; where the chosen ways lead is found
by doubling pointers, and events whose other needs turn out to lead further choose
again, until none does. So the rounds grow with the logarithm of the depth, times
the few times that choices change; each round is a written table. A way with more
steps than there are events never ends.

Arguments are checked against the tool's schema and written as canonical JSON
(sorted keys, no white space). Nothing is gathered by conversation, so one may hold
any share of all rows. Everything is DataFrame expressions.

Defined results: one row per event; a null id names nothing (its call is
``open``, its result an ``orphan``); null conversations are one conversation; of
equal identifiers the first in turn order is linked (all of them, if a turn
comes twice), others are ``duplicate``; events that need each other, and all that
need one of these, are ``cyclic`` and stay at their turn; events without a turn
stay where they are and push nothing; arguments that are no JSON object are an
error and are kept as a string; an empty table has no events; other columns are
ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.texts import written
from tessera.session import checkpointed

#: What a tool takes: field: (JSON type, required, least length or value).
TOOLS = {"reply": {"prompt": ("string", True, 1), "turn": ("integer", True, 0)}}

TURN = (
    "struct<tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>, "
    "tool_call_id: string, content: string>"
)
#: JSON types by the names that variants give them.
TYPES = {"string": "STRING", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}

CALL = "struct<seq: int, kind: string, call_id: string, name: string, arguments: string, after: array<string>, content: string>"


def events(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, seq, kind, call_id, name, arguments, after, content`` of all turns."""
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = turns.withColumn("json", F.from_json(F.when(F.ltrim("text").startswith("{"), F.col("text")), TURN))
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")

    def event(kind: str, call_id=none, name=none, arguments=none, content=none) -> Column:
        fields = (F.lit(0), F.lit(kind), call_id, name, arguments, nothing, content)
        return F.array(F.struct(*fields).cast(CALL))

    def named(turn) -> Column:
        return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))

    calls = F.transform(
        "json.tool_calls",
        lambda c, i: F.struct(i, F.lit("call"), c["id"], c["name"], c["arguments"], F.coalesce(c["after"], nothing), none).cast(CALL),
    )
    prompt = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    found = (
        F.when(F.size("json.tool_calls") > 0, calls)
        .when(F.col("json.tool_call_id").isNotNull(), event("result", F.col("json.tool_call_id"), content=F.col("json.content")))
        .when(F.col("role") == "user", event("call", named(F.col("turn")), F.lit("reply"), prompt))
        .when(F.col("role") == "assistant", event("result", named(F.col("turn") - 1), content=F.col("text")))
        .otherwise(event("message", content=F.col("text")))
    )
    return parsed.select("conv_id", "turn", "role", F.explode(found).alias("e")).select("conv_id", "turn", "role", "e.*")


def problems(tools: dict[str, dict[str, tuple]]) -> Column:
    """What is wrong with the arguments of a call, as sorted texts."""
    value = F.try_parse_json("arguments")
    keys = F.json_object_keys("arguments")
    found = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, fields in tools.items():
        checks = [F.transform(F.array_except(keys, F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")), lambda k: F.concat(F.lit("extra "), k))]
        for field, (kind, required, least) in fields.items():
            path = "$." + field
            present = F.array_contains(keys, field) & F.variant_get(value, path, "string").isNotNull()
            fits = F.schema_of_variant(F.variant_get(value, path, "variant")).rlike(f"^({TYPES[kind]})$")
            size = F.length(F.variant_get(value, path, "string")) if kind == "string" else F.variant_get(value, path, "double") if kind in ("integer", "number") else F.lit(None)
            one = F.when(~present, F.lit(f"missing {field}") if required else F.lit(None)).when(~fits, F.lit(f"type {field}"))
            if least is not None:
                one = one.when(size < least, F.lit(f"small {field}"))
            checks.append(F.array(one))
        own = F.sort_array(F.filter(F.concat(*checks), lambda x: x.isNotNull()))
        found = found.when(F.col("name") == name, own)
    broken = F.when(keys.isNull() | value.isNull(), F.array(F.lit("no object")))
    return F.coalesce(broken, found, F.array(F.lit("unknown tool")))


def linked(found: DataFrame) -> DataFrame:
    """Events with the first call and the first result of their identifier, as (turn, seq)."""
    here = F.struct("turn", "seq")
    ids = (
        found.where(F.col("call_id").isNotNull())
        .groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
        .agg(
            F.min(F.when(F.col("kind") == "call", here)).alias("call_at"),
            F.min(F.when(F.col("kind") == "result", here)).alias("result_at"),
            F.count(F.when(F.col("kind") == "call", 1)).alias("n_calls"),
            F.count(F.when(F.col("kind") == "result", 1)).alias("n_results"),
        )
    )
    same = found["conv_id"].eqNullSafe(ids["_conv"]) & (found["call_id"] == ids["_call"])
    return found.join(ids, same, "left").drop("_conv", "_call")


def conversation() -> Column:
    """A conversation's id as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def needs(spark, events_linked: DataFrame) -> DataFrame:
    """``conv, node, parent``: which event (turn, seq) comes after which, in conversations where one needs a later one."""
    here, child = F.struct("turn", "seq"), ["conv_id", "turn", "seq"]
    answers = events_linked.where((F.col("kind") == "result") & F.col("call_at").isNotNull()).select(*child, F.col("call_at").alias("parent"))
    asked = events_linked.where((F.col("kind") == "call") & (F.size("after") > 0)).select(*child, F.explode("after").alias("needed"))
    ids = events_linked.where(F.col("call_id").isNotNull()).groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call")).agg(F.coalesce(F.first("result_at", True), F.first("call_at", True)).alias("parent"))
    chains = asked.join(ids, asked["conv_id"].eqNullSafe(ids["_conv"]) & (asked["needed"] == ids["_call"])).select(*child, "parent")
    edges = answers.unionByName(chains).where(F.col("turn").isNotNull() & F.col("parent.turn").isNotNull())
    edges = checkpointed(spark, edges.select(conversation().alias("conv"), here.alias("node"), "parent").distinct())
    late = edges.where(F.col("parent") >= F.col("node")).select("conv").distinct()
    return edges.join(late, "conv", "left_semi")


def followed(chosen: DataFrame, most: int) -> DataFrame:
    """``conv, node, end, far``: where the chosen ways of ``chosen`` (conv, node, choice) end, and after how many steps.

    Pointers are doubled until all of them are at an end or longer than ``most``.
    """
    far = F.when(F.col("choice").isNull(), 0).otherwise(1).cast("bigint")
    ways = written(chosen.select("conv", "node", F.coalesce("choice", "node").alias("end"), far.alias("far"), F.lit(True).alias("open")), "ways")
    while not ways.where("open").isEmpty():
        onward = ways.select("conv", F.col("node").alias("end"), F.col("end").alias("_end"), F.col("far").alias("_far"))
        doubled = F.col("far") + F.col("_far")
        ways = written(ways.join(onward, ["conv", "end"]).select("conv", "node", F.col("_end").alias("end"), doubled.alias("far"), ((F.col("_far") > 0) & (doubled <= most)).alias("open")), "ways")
    return ways.drop("open")


def ordered(spark, events_linked: DataFrame) -> DataFrame:
    """``conv, turn, seq, at, depth, cyclic`` of the events that something later pushes back."""
    edges = needs(spark, events_linked)
    turn = edges.schema["node"].dataType["turn"].dataType
    if edges.isEmpty():
        return spark.createDataFrame([], T.StructType([T.StructField("conv", T.StringType()), T.StructField("turn", turn), T.StructField("seq", T.IntegerType()), T.StructField("at", turn), T.StructField("depth", T.IntegerType()), T.StructField("cyclic", T.BooleanType())]))
    edges = written(edges, "needs")
    place = lambda cyclic, at, depth: F.struct(cyclic.alias("cyclic"), at.cast(turn).alias("at"), depth.cast("bigint").alias("depth"))
    own = place(F.lit(False), F.col("node.turn"), F.lit(0))
    nodes = edges.select("conv", "node").unionByName(edges.select("conv", F.col("parent").alias("node"))).distinct()
    state = written(nodes.select("conv", "node", own.alias("place"), F.lit(None).cast(edges.schema["node"].dataType).alias("choice")), "places")
    most = state.groupBy("conv").count().agg(F.max("count")).first()[0]
    while True:
        up = state.select("conv", F.col("node").alias("parent"), F.col("place").alias("_up"))
        pushed = F.when(F.col("_up.cyclic"), F.col("_up")).otherwise(place(F.lit(False), F.col("_up.at"), F.col("_up.depth") + 1))
        best = edges.join(up, ["conv", "parent"]).groupBy("conv", "node").agg(F.max(F.struct(pushed.alias("place"), "parent")).alias("best"))
        further = F.coalesce(F.col("best.place") > F.col("place"), F.lit(False))
        chosen = state.join(best, ["conv", "node"], "left").select("conv", "node", F.when(further, F.col("best.parent")).otherwise(F.col("choice")).alias("choice"), further.alias("further"))
        chosen = written(chosen, "choices")
        if chosen.where("further").isEmpty():
            break
        endless = F.col("far") > most
        found = F.when(endless, place(F.lit(True), F.lit(0), F.lit(0))).otherwise(place(F.lit(False), F.col("end.turn"), F.col("far")))
        ended = followed(chosen, most).select("conv", "node", found.alias("place"))
        state = written(ended.join(chosen.select("conv", "node", "choice"), ["conv", "node"]), "places")
    moved = state.where("place.cyclic OR place.depth > 0")
    at = F.when(F.col("place.cyclic"), F.col("node.turn")).otherwise(F.col("place.at"))
    return moved.select("conv", "node.turn", "node.seq", at.alias("at"), F.col("place.depth").cast("int").alias("depth"), F.col("place.cyclic").alias("cyclic"))


def format_chats(conversations: DataFrame, tools: dict[str, dict[str, tuple]] = TOOLS) -> DataFrame:
    """``conv_id, at, depth, turn, seq, kind, call_id, status, n_errors, line`` of every event.

    Within a conversation the order is by ``at, depth, turn, seq``; ``line`` is
    one canonical JSON object.
    """
    spark = conversations.sparkSession
    found = checkpointed(spark, linked(events(conversations)))
    places = ordered(spark, found)
    places = places.select(*(F.col(c).alias(f"_{c}") for c in places.columns))
    same = (conversation() == places["_conv"]) & (found["turn"] == places["_turn"]) & (found["seq"] == places["_seq"])
    here = F.struct("turn", "seq")
    first = F.when(F.col("kind") == "call", F.col("call_at")).otherwise(F.col("result_at"))
    several = F.when(F.col("kind") == "call", F.col("n_calls")).otherwise(F.col("n_results")) > 1
    status = (
        F.when(F.col("kind") == "message", F.lit("message"))
        .when(F.coalesce(F.col("_cyclic"), F.lit(False)), F.lit("cyclic"))
        .when(F.coalesce(several & (here > first), F.lit(False)), F.lit("duplicate"))
        .when(F.col("kind") == "call", F.when(F.col("result_at").isNotNull(), F.lit("answered")).otherwise(F.lit("open")))
        .otherwise(F.when(F.col("call_at").isNotNull(), F.lit("linked")).otherwise(F.lit("orphan")))
    )
    out = found.join(places, same, "left").withColumn("status", status)
    out = out.withColumn("errors", F.when(F.col("kind") == "call", problems(tools)).otherwise(F.array().cast("array<string>")))
    value = F.try_parse_json("arguments")
    # Variants keep the keys of an object sorted; a text that is no JSON stays a text.
    arguments = F.when(F.col("kind") == "call", F.coalesce(F.to_json(value), quoted("arguments")))
    pairs = [
        ("arguments", arguments),
        ("call_id", quoted("call_id")),
        ("content", quoted("content")),
        ("conv_id", quoted("conv_id")),
        ("errors", F.when(F.size("errors") > 0, F.to_json("errors"))),
        ("kind", quoted("kind")),
        ("name", quoted("name")),
        ("role", quoted("role")),
        ("status", quoted("status")),
        ("turn", quoted("turn")),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{key}":'), text) for key, text in pairs)), F.lit("}"))
    return out.select(
        "conv_id",
        F.coalesce("_at", "turn").alias("at"),
        F.coalesce("_depth", F.lit(0)).alias("depth"),
        "turn",
        "seq",
        "kind",
        "call_id",
        "status",
        F.size("errors").alias("n_errors"),
        line.alias("line"),
    )


def quoted(column: str) -> Column:
    """A value as JSON, null for null."""
    return F.when(F.col(column).isNotNull(), F.btrim(F.to_json(F.array(column)), F.lit("[]")))
