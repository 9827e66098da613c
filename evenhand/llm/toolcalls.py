"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import cut, remove, salted_rank, temporary

#: Fixed names of JSON schema types, and of the keywords that are checked and that say nothing about a value.
TYPES = ("string", "integer", "number", "boolean", "object", "array", "null")
KEYWORDS = {
    "type", "enum", "const", "anyOf", "oneOf", "allOf", "not", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "items",
    "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
}
NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "format", "deprecated", "readOnly", "writeOnly"}


def check_schema(schema, path: str = "$") -> None:
    """ValueError where a schema asks for what ``schema_errors`` does not check: nothing is 'ok' unseen."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: a schema is an object, true or false")
    if unknown := set(schema) - KEYWORDS - NOTES:
        raise ValueError(f"{path}: unsupported keywords {sorted(unknown)}")
    kinds = schema.get("type", [])
    if unknown := set([kinds] if isinstance(kinds, str) else kinds) - set(TYPES):
        raise ValueError(f"{path}: unknown types {sorted(unknown)}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    if schema.get("multipleOf", 1) <= 0:
        raise ValueError(f"{path}: multipleOf is above 0")
    for k in ("anyOf", "oneOf", "allOf"):
        for i, x in enumerate(schema.get(k, [])):
            check_schema(x, f"{path}.{k}[{i}]")
    for k, x in schema.get("properties", {}).items():
        check_schema(x, f"{path}.{k}")
    for k in ("not", "items", "additionalProperties"):
        if k in schema:
            check_schema(schema[k], f"{path}.{k}")


def _is(value, kind: str) -> bool:
    if kind == "number" or kind == "integer":
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (whole or kind == "number" and isinstance(value, float))
    return isinstance(value, {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}[kind])


def same_json(a, b) -> bool:
    """Whether two JSON values are equal: numbers by value (1 is 1.0), and never a boolean."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_json, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return set(a) == set(b) and all(same_json(a[k], b[k]) for k in a)
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def _number_errors(value, schema: dict, path: str) -> list[str]:
    beyond = {"minimum": lambda x: value < x, "maximum": lambda x: value > x, "exclusiveMinimum": lambda x: value <= x, "exclusiveMaximum": lambda x: value >= x}
    out = [f"{path}: out of bounds" for k, bad in beyond.items() if k in schema and bad(schema[k])]
    if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
        out.append(f"{path}: not a multiple")
    return out


def schema_errors(value, schema, path: str = "$") -> list[str]:
    """What of ``value`` breaks ``schema``, as (KEYWORDS of) JSON Schema has it; a number without a fraction is an integer."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    kind = schema.get("type")
    kinds = [kind] if isinstance(kind, str) else kind or []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and not any(same_json(value, x) for x in schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and not same_json(value, schema["const"]):
        out.append(f"{path}: not the constant")
    for x in schema.get("allOf", []):
        out += schema_errors(value, x, path)
    if "anyOf" in schema and all(schema_errors(value, x, path) for x in schema["anyOf"]):
        out.append(f"{path}: fits none of anyOf")
    if "oneOf" in schema and sum(not schema_errors(value, x, path) for x in schema["oneOf"]) != 1:
        out.append(f"{path}: does not fit one of oneOf")
    if "not" in schema and not schema_errors(value, schema["not"], path):
        out.append(f"{path}: fits not")
    sizes = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems"), dict: ("minProperties", "maxProperties")}.get(type(value))
    if sizes and not schema.get(sizes[0], 0) <= len(value) <= schema.get(sizes[1], len(value)):
        out.append(f"{path}: out of bounds")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{path}: does not match")
    if isinstance(value, dict):
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known or other is not False:
                out += schema_errors(value[k], known.get(k, other), f"{path}.{k}")
            else:
                out.append(f"{path}.{k}: unexpected")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            out += schema_errors(x, schema.get("items", True), f"{path}[{i}]")
        if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value):
            out.append(f"{path}: repeated items")
    elif _is(value, "number"):
        out += _number_errors(value, schema, path)
    return out


def number(value: int | float) -> str:
    """One spelling for each number, as in RFC 8785: shortest digits, an exponent from 1e21 on and below 1e-6, no fraction of zeros, no -0.

    Whole numbers that no double holds keep all their digits.
    """
    if isinstance(value, int) and (abs(value) < 10**21 or value.bit_length() > 1000 or int(float(value)) != value):
        return str(value)
    value = float(value)
    if not math.isfinite(value):
        raise ValueError("not a JSON number")
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent  # the value is 0.text * 10 ** point
    if 0 < point <= 21:
        text = text[:point].ljust(point, "0") + ("." + text[point:] if len(text) > point else "")
    elif -6 < point <= 0:
        text = "0." + "0" * -point + text
    else:
        text = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + text


def canonical(value) -> str:
    """JSON as RFC 8785 has it: sorted keys (by UTF-16), no spaces, characters as they are, one spelling a number; ValueError for infinities and lone surrogates."""

    def write(x) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(f"{write(k)}:{write(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(write, x)) + "]"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return number(x)
        return json.dumps(x, ensure_ascii=False)

    text = write(value)
    text.encode()
    return text


def _write(schemas: dict[str, dict]):
    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("repeated key")
        return out

    def one(call_id, name, arguments, result, linked) -> tuple[str, list[str] | None, str]:
        whole = lambda args: canonical({"arguments": args, "id": call_id, "name": name, "result": result})
        try:
            args = json.loads(arguments, object_pairs_hook=unique, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
            text = whole(args)
        except (TypeError, ValueError, RecursionError):
            return "bad_json", ["$: not JSON"], whole(None)
        if name not in schemas:
            return "unknown_tool", ["$: no schema"], text
        found = schema_errors(args, schemas[name])
        if found:
            return "invalid", [x.encode("utf-8", "replace").decode() for x in found], text
        return "ok" if linked else "no_result", None, text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.astype(object).where(b.notna(), None)
            rows = [one(*r) for r in zip(b["call_id"], b["name"], b["arguments"], b["result"], b["linked"], strict=True)]
            yield pd.DataFrame({
                "conv_id": b["conv_id"], "call_id": b["call_id"], "level": b["level"].astype("Int64"), "place": b["place"], "own": b["own"],
                "status": [r[0] for r in rows], "errors": [r[1] for r in rows], "json": [r[2] for r in rows],
            })

    return run


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, level) of every call; level is the longest way down its dependencies, null on or behind a cycle.

    ``edges`` has (call_id, needs). Where each call has one dependency at most, pointer jumping finds depths in as
    many rounds as the logarithm of the longest chain; what still points on after enough rounds for all calls in one
    chain goes round a cycle. Calls with several dependencies are peeled off after those that they need.
    """
    with temporary(calls.sparkSession) as keep:
        out = _levels(calls, edges)
        keep(out)
    return out


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    known = calls.select(F.col("call_id").alias("needs"))
    edges = edges.filter("call_id IS NOT NULL AND needs IS NOT NULL").distinct().join(known, "needs", "left_semi").select("call_id", "needs")
    edges = cut(edges.join(calls.select("call_id"), "call_id", "left_semi"), "edges")
    degree = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("needs"))
    if degree.filter("n > 1").isEmpty():
        depth = F.when(F.col("needs").isNull(), 0).otherwise(1).cast("long")
        step = cut(calls.join(degree, "call_id", "left").select("call_id", F.col("needs").alias("to"), depth.alias("level")), "step")
        for _ in range(step.count().bit_length() + 1):
            if step.filter("to IS NOT NULL").isEmpty():
                break
            up = step.select(F.col("call_id").alias("to"), F.col("to").alias("far"), F.col("level").alias("more"))
            new = step.join(up, "to", "left").select("call_id", F.col("far").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
            last, step = step, cut(new, "step")
            remove(calls.sparkSession, last.scratch_path)
        return cut(step.select("call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level")), "levels")
    done = cut(calls.join(edges, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")), "done")
    while True:
        ready = edges.join(done.withColumnsRenamed({"call_id": "needs"}), "needs", "left").groupBy("call_id").agg(
            F.max("level").alias("low"), F.max(F.col("level").isNull()).alias("open")
        )
        new = ready.filter("NOT open").join(done, "call_id", "left_anti").select("call_id", (F.col("low") + 1).alias("level"))
        new = cut(new, "done")
        if new.isEmpty():
            return cut(calls.select("call_id").join(done, "call_id", "left"), "levels")
        last, done = done, cut(done.unionByName(new), "done")
        remove(calls.sparkSession, last.scratch_path)


#: Calls of a conversation whose levels fall into one block of this many are sorted together, up to so many rows.
LEVEL_BLOCK, WIDE = 1024, 1 << 16


def places(rows: DataFrame) -> DataFrame:
    """Add ``place``: calls of a conversation numbered from 0 by (level, turn, call_id), those without a level last.

    Blocks of levels are ranked by themselves; a block of many rows is cut at each level, and by turns. Turns and
    call_ids decide in the end, so a conversation that holds a third of all calls is still many tasks.
    """
    block = F.coalesce(F.floor(F.col("level") / LEVEL_BLOCK), F.lit(1 << 40)).cast("long")
    rows = cut(rows.withColumn("block", block), "blocks")
    wide = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WIDE)
    wide = wide.select(F.col("conv_id").alias("wc"), F.col("block").alias("wb"), F.lit(True).alias("wide"))
    rows = rows.join(wide, rows["conv_id"].eqNullSafe(wide["wc"]) & (rows["block"] == wide["wb"]), "left").drop("wc", "wb")
    narrow = F.col("wide").isNull()
    # no turn comes first, as in the order by turn
    turns = F.when(F.col("turn").isNull(), F.lit(-(1 << 60))).otherwise(F.floor(F.col("turn") / 64)).cast("long")
    coarse = [F.col("block"), F.when(narrow, 0).otherwise(F.coalesce("level", F.lit(0))), F.when(narrow, 0).otherwise(turns)]
    fine = [F.col("level").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("call_id").asc_nulls_first()]
    ranked = salted_rank(rows, ["conv_id"], coarse, fine, "place")
    return ranked.withColumn("place", F.col("place") - 1).drop("block", "wide")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every row of ``calls`` with its place, result, verdict and canonical JSON.

    ``calls`` has conv_id, call_id (string, unique), needs (array of call_ids), name, arguments (JSON text) and turn
    (a whole number); ``results`` has call_id and content; other columns are not read, whatever their names. Results are
    hash-joined by identifier; where several results name one call, that with the smallest content holds (null only
    where all are null); results of no call are left out. ``level`` orders calls topologically; ``place`` numbers a
    conversation's calls from 0 by (level, turn, call_id), those without a level last; rows whose conversation is null
    are numbered together. Names of calls outside the table are no dependencies.

    Schemas are checked first: one with a keyword or type that is not known is an error, as its calls could not be judged.

    status: 'ok', 'no_result', 'invalid' (``errors`` lists all places where the arguments break the schema),
    'unknown_tool', 'bad_json' (also null arguments, repeated keys, NaN, numbers beyond a double's range and lone
    surrogates) or, before any of these, 'no_id' (null call_id), 'repeated' (of rows that share a call_id, that of
    smallest (conv_id, turn, name, arguments, needs), nulls first, is the call) and 'cycle'. The last three have
    no level, and the first two of them no result. Empty and long texts are texts like any other; an empty table of
    calls gives an empty table, one of results gives 'no_result'.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    order = ["conv_id", "turn", "name", "arguments", "needs"]
    calls = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), "needs", "name", "arguments", "turn")
    # equal rows are counted before they meet by identifier
    calls = calls.groupBy("call_id", *order).agg(F.count(F.lit(1)).alias("n"))
    calls = cut(calls.withColumn("key", F.struct(*order)), "calls")
    least = calls.groupBy("call_id").agg(F.min("key").alias("least"))
    calls = calls.join(least.filter("call_id IS NOT NULL").withColumnRenamed("call_id", "of"), F.col("call_id") == F.col("of"), "left")
    first = F.coalesce(F.col("key").eqNullSafe(F.col("least")) & F.col("of").isNotNull(), F.lit(False))
    calls = calls.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    own = F.when(F.col("call_id").isNull(), "no_id").when(first & (F.col("copy") == 1), "call").otherwise("repeated")
    calls = cut(calls.select("call_id", *order, own.alias("own")), "calls")
    linked = calls.filter("own = 'call'")
    ranks = levels(linked.select("call_id"), linked.select("call_id", F.explode("needs").alias("needs")))
    best = results.filter("call_id IS NOT NULL").groupBy(F.col("call_id").cast("string").alias("call_id")).agg(F.min("content").alias("result"), F.lit(True).alias("linked"))
    rows = linked.join(ranks, "call_id").join(best, "call_id", "left").select("call_id", *order, "own", "level", "result", F.coalesce("linked", F.lit(False)).alias("linked"))
    other = calls.filter("own <> 'call'").withColumns({"level": F.lit(None).cast("long"), "result": F.lit(None).cast(results.schema["content"].dataType), "linked": F.lit(False)})
    rows = places(rows.unionByName(other))
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", "call_id", "level", "place", "own", "name", "arguments", "result", "linked")
    out = rows.mapInPandas(_write(schemas), f"conv_id {kind}, call_id string, level long, place long, own string, status string, errors array<string>, json string")
    status = F.when(F.col("own") != "call", F.col("own")).when(F.col("level").isNull(), "cycle").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("own")


#: The tool that the registered query reads chats as: each user turn asks, the turn after it answers.
CHAT_SCHEMAS = {
    "ask": {
        "type": "object",
        "properties": {
            "prompt": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 0},
            "words": {"type": "integer", "minimum": 3},
        },
        "required": ["prompt", "turn", "words"],
        "additionalProperties": False,
    }
}


def as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a chat table: a user turn calls 'ask', an assistant turn answers the user turn before it.

    A call needs the call two turns earlier in its conversation; identifiers are 'conversation:turn', with '~' for a
    null conversation or turn. Rows that share an identifier are for ``link_calls`` to tell apart; a call with a null
    turn needs nothing.
    """
    part = lambda c: F.coalesce(c.cast("string"), F.lit("~"))
    key = lambda t: F.concat(part(F.col("conv_id")), F.lit(":"), part(t))
    text = F.col("text")
    users = turns.filter("role = 'user'")
    arguments = F.to_json(F.struct(text.alias("prompt"), F.col("turn").alias("turn"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("words")))
    calls = users.select("conv_id", key(F.col("turn")).alias("call_id"), F.when(F.col("turn").isNotNull(), F.array(key(F.col("turn") - 2))).alias("needs"), F.lit("ask").alias("name"), arguments.alias("arguments"), "turn")
    results = turns.filter("role = 'assistant' AND turn IS NOT NULL").select(key(F.col("turn") - 1).alias("call_id"), text.alias("content"))
    return calls, results


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    calls, results = as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = link_calls(calls, results, CHAT_SCHEMAS)
    return out.select("conv_id", "call_id", "level", "place", "status", F.md5(F.col("json").cast("binary")).alias("json_md5"))


#: DuckDB SQL of op4_tool_calls.
SQL = r"""
WITH u0 AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), '~') || ':' || coalesce(CAST(turn AS VARCHAR), '~') AS call_id,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM conversations WHERE role = 'user'),
u1 AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY conv_id NULLS FIRST, turn NULLS FIRST,
         '{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' END NULLS FIRST) AS rn FROM u0),
u AS (SELECT * FROM u1 WHERE rn = 1),
a AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '~') || ':' || CAST(turn - 1 AS VARCHAR) AS call_id, min(text) AS result FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1),
g AS (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) = 2 THEN 0 ELSE 1 END AS new FROM u),
h AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS level FROM h),
j AS (SELECT l.conv_id, l.call_id, l.turn, l.text, l.words, l.rn, l.level, a.result, a.call_id IS NOT NULL AS linked FROM l LEFT JOIN a ON l.call_id = a.call_id
      UNION ALL SELECT conv_id, call_id, turn, text, words, rn, NULL, NULL, false FROM u1 WHERE rn > 1)
SELECT conv_id, call_id, CAST(level AS BIGINT) AS level,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn NULLS FIRST, call_id, rn) - 1 AS BIGINT) AS place,
       CASE WHEN rn > 1 THEN 'repeated' WHEN words < 3 OR coalesce(text, '') = '' OR turn IS NULL OR turn < 0 THEN 'invalid' WHEN linked THEN 'ok' ELSE 'no_result' END AS status,
       md5('{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' END
           || CASE WHEN turn IS NULL THEN '' ELSE '"turn":' || turn || ',' END || '"words":' || words || '},"id":"' || call_id
           || '","name":"ask","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}') AS json_md5
FROM j
"""
