"""Tool-call linking and canonical chat records, in DataFrame operations only.

Calls and results meet in a shuffled hash join on their conversation and identifier. Links and stated dependencies order the
messages: a message's place is (turn, level), raised where it would not come after what it depends on; rounds run only as deep as
the longest chain of messages out of order. Arguments are parsed once, checked against the tool's schema and written as
canonical JSON: keys in order, no white space. A record is one exchange, so a conversation of any length is many small
rows, not one long one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import cut, discard

#: Tables of moves kept apart before they are merged, so that the plan does not grow with the rounds.
STEPS = 8
#: Names of JSON schema types, and what Spark calls the types of parsed values.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no white space; null for null and for what is not JSON."""
    return F.to_json(F.try_parse_json(text))


def valid(name: Column, text: Column, schemas: dict) -> Column:
    """Whether a call's arguments fit its tool's schema: an object with all that is required, each value of its kind.

    ``schemas``: tool -> {"required": [...], "properties": {parameter: {"type": ..., "minLength": n, "maxLength": n, "minimum": n, "maximum": n}},
    "additionalProperties": bool}. Unknown tools, null arguments and broken JSON are not valid.
    """
    value = F.try_parse_json(text)
    kind = lambda v: F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), r"^([A-Z]+)", 1)
    out = F.lit(False)
    for tool, schema in schemas.items():
        checks = [kind(value) == "OBJECT"]
        for p, rule in schema.get("properties", {}).items():
            part = F.try_variant_get(value, f"$['{p}']", "variant")
            fits = kind(part).isin(KINDS[rule["type"]]) if "type" in rule else F.lit(True)
            size, value_of = F.length(F.try_variant_get(value, f"$['{p}']", "string")), F.try_variant_get(value, f"$['{p}']", "double")
            for bound, holds in (("minLength", size.__ge__), ("maxLength", size.__le__), ("minimum", value_of.__ge__), ("maximum", value_of.__le__)):
                if bound in rule:
                    fits = fits & F.coalesce(holds(rule[bound]), F.lit(False))
            checks.append(part.isNull() | fits)
        checks += [F.try_variant_get(value, f"$['{p}']", "variant").isNotNull() for p in schema.get("required", [])]
        if schema.get("additionalProperties") is False:
            keys = F.json_object_keys(text)
            checks.append(F.size(F.array_except(keys, F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>"))) == 0)
        out = F.when(name == tool, reduce(lambda a, b: a & b, checks)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def hash_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that hashes ``right``, the side with the shorter rows, per partition; neither side is sorted or broadcast."""
    return left.join(right.hint("shuffle_hash"), on, how)


def places(nodes: DataFrame, edges: DataFrame, max_depth: int = 100) -> DataFrame:
    """A topological order: ``id``, ``turn``, ``level`` such that (turn, level) rises along every edge (``before``, ``after``).

    ``nodes``: ``id`` (of any type that can be compared, one row each) and ``turn``. A message keeps its turn unless something it depends on comes later.
    Edges to unknown ids are ignored. Rounds end when nothing moves; what still moves after ``max_depth`` rounds (a cycle, or so deep a chain out of order) has
    null level. A round looks only at what depends on messages that moved in the round before, and writes only those that move.
    """
    edges = cut(edges)
    start = cut(nodes.select("id", F.struct("turn", F.lit(0).cast("long").alias("level")).alias("at")))
    moved, steps = start, []
    latest = lambda: reduce(DataFrame.unionByName, [start, *steps])
    for _ in range(max_depth):
        ends = edges.join(moved.select(F.col("id").alias("before"), F.col("at").alias("b")), "before").groupBy(F.col("after").alias("id")).agg(F.max("b").alias("b"))
        # places only rise, so the latest is the greatest
        now = latest().join(ends, "id").groupBy("id").agg(F.max("at").alias("at"), F.max("b").alias("b"))
        moved = cut(now.where("at <= b").select("id", F.struct(F.col("b.turn").alias("turn"), (F.col("b.level") + 1).alias("level")).alias("at")))
        if moved.isEmpty():
            break
        if len(steps) == STEPS:
            merged = cut(reduce(DataFrame.unionByName, steps).groupBy("id").agg(F.max("at").alias("at")))
            discard(*steps)
            steps = [merged]
        steps.append(moved)
    discard(edges)
    out = latest().groupBy("id").agg(F.max("at").alias("at"))
    out = out.join(moved.select("id", F.lit(True).alias("late")), "id", "left")
    return out.select("id", "at.turn", F.when(F.col("late").isNull(), F.col("at.level")).alias("level"))


def _firsts(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of each key (``conv_id``, ``call_id``) the first row by ``columns``, and all other rows of it; a row with half a key is a first."""
    keyed = rows.where("conv_id is not null and call_id is not null")
    least = cut(keyed.groupBy("conv_id", "call_id").agg(F.min(F.struct(columns)).alias("x"), F.count(F.lit(1)).alias("n")))
    firsts = least.select("conv_id", "call_id", "x.*").unionByName(rows.where("conv_id is null or call_id is null").select("conv_id", "call_id", *columns))
    many = least.where("n > 1").select("conv_id", "call_id", "x")
    if many.isEmpty():
        return firsts, firsts.limit(0)
    # equal rows are counted before they move
    kinds = keyed.groupBy("conv_id", "call_id", *columns).agg(F.count(F.lit(1)).alias("n")).join(many, ["conv_id", "call_id"])
    left = kinds.withColumn("n", F.col("n") - F.when(F.struct(columns).eqNullSafe(F.col("x")), 1).otherwise(0)).where("n > 0")
    return firsts, left.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("conv_id", "call_id", *columns)


def link(calls: DataFrame, results: DataFrame, schemas: dict, depends: DataFrame | None = None) -> DataFrame:
    """One row per exchange: a call with its result, a call or a result without the other, and each repeat.

    ``calls``: ``conv_id``, ``turn``, ``call_id``, ``name``, ``arguments`` (JSON). ``results``: ``conv_id``, ``turn``, ``call_id``, ``content``. An
    identifier counts inside its conversation. ``depends``: ``conv_id``, ``before`` and ``after``, call ids of which the result of the one comes before the call of the
    other. Returns ``conv_id``, ``call_id``, ``call_turn``, ``result_turn``, the places of both in topological order (``call_place``, ``call_level``, ``result_place``,
    ``result_level``), ``status`` (linked, unanswered, orphan, repeated_call, repeated_result), ``valid`` and ``record`` (canonical JSON of the exchange). Defined cases: with a null
    conversation or a null id a row links with nothing and has no place; of calls, and of results, with one conversation and id
    the first by turn (then by name and text) is linked and each other is a row of its own, a repeat without a place; null or broken arguments are
    not valid and null in the record; empty tables give an empty result; other columns are ignored.
    """
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments")
    r = results.select("conv_id", "turn", "call_id", "content")
    (first_c, more_c), (first_r, more_r) = _firsts(c, ["turn", "name", "arguments"]), _firsts(r, ["turn", "content"])
    first_c = first_c.select("conv_id", "call_id", F.col("turn").alias("call_turn"), "name", "arguments", F.lit(True).alias("is_call"))
    first_r = first_r.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("turn").alias("result_turn"), "content", F.lit(True).alias("is_result"))
    both = hash_join(first_r, first_c, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "full")
    status = F.when(F.col("is_call") & F.col("is_result"), "linked").when(F.col("is_call"), "unanswered").otherwise("orphan")
    both = both.select(F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_id").alias("call_id"), "call_turn", "name", "arguments", "result_turn", "content", status.alias("status"))
    both = cut(both)
    node = lambda kind, ident="call_id": F.struct("conv_id", F.col(ident).alias("call_id"), F.lit(kind).alias("kind"))
    keyed = both.where("conv_id is not null and call_id is not null")
    asked, answered = keyed.where("status <> 'orphan'"), keyed.where("status <> 'unanswered'")
    edges = keyed.where("status = 'linked'").select(node("call").alias("before"), node("result").alias("after"))
    if depends is not None:
        edges = edges.unionByName(depends.where("conv_id is not null").select(node("result", "before").alias("before"), node("call", "after").alias("after")))
    nodes = asked.select(node("call").alias("id"), F.col("call_turn").alias("turn")).unionByName(answered.select(node("result").alias("id"), F.col("result_turn").alias("turn")))
    placed = places(nodes, edges).select("id.*", "turn", "level")
    at = F.struct("turn", "level")
    placed = placed.groupBy("conv_id", "call_id").agg(F.max(F.when(F.col("kind") == "call", at)).alias("c"), F.max(F.when(F.col("kind") == "result", at)).alias("r"))
    placed = placed.select("conv_id", "call_id", F.col("c.turn").alias("call_place"), F.col("c.level").alias("call_level"), F.col("r.turn").alias("result_place"), F.col("r.level").alias("result_level"))
    out = hash_join(both, placed, ["conv_id", "call_id"], "left")
    out = out.unionByName(more_c.withColumnRenamed("turn", "call_turn").withColumn("status", F.lit("repeated_call")), allowMissingColumns=True)
    out = out.unionByName(more_r.withColumnRenamed("turn", "result_turn").withColumn("status", F.lit("repeated_result")), allowMissingColumns=True)
    record = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return out.select("conv_id", "call_id", "call_turn", "result_turn", "call_place", "call_level", "result_place", "result_level", "status", valid(F.col("name"), F.col("arguments"), schemas).alias("valid"), record.alias("record"))
