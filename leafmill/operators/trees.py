"""JSON trees of any depth as VARIANT: walked level by level, summed, and rewritten in place.

A text is parsed once. It is null as a tree where it is null, isn't JSON, or repeats a member's name within an
object. Members of an object come in the order of their names, numbers in their plain form.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import let
from leafmill.shared import cut

#: Results of this version have marks of their own (a fixed value).
SECOND = "universal_document_semantics_v2"
TOKENS = ("input_tokens", "output_tokens", "estimated_image_tokens")
#: Members that make an object one to be marked (fixed values).
MARKED = ("confidence", "verified", "value")
#: Trees up to this depth are marked by one expression, which the analyzer has to resolve level by level.
LEVELS = 12


def walk(rows: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """Every node of the trees in the JSON column ``tree``: the ``keys`` of its row, ``depth, path, node``.

    The root has depth 0 and an empty path; it stands for its row even where there is no tree (a null node). Places
    in arrays are counted from 0. A level is written before the next one is made of it, without a shuffle; rows
    that repeat keep their nodes apart only if ``keys`` tell them apart.
    """
    tvf = rows.sparkSession.tvf
    level = cut(rows.select(*keys, F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"), F.try_parse_json(tree).alias("node")))
    out = level
    while level.take(1):
        children = level.withColumnsRenamed({"path": "__path", "node": "__node"}).lateralJoin(tvf.variant_explode(F.col("__node").outer()))
        step = F.coalesce("key", F.col("pos").cast("string"))
        level = cut(children.select(*keys, (F.col("depth") + 1).alias("depth"), F.concat("__path", F.array(step)).alias("path"), F.col("value").alias("node")))
        out = out.unionByName(level)
    return out


def _number(path: str) -> Column:
    """A member that is a number; texts of digits are none."""
    return F.to_json(F.try_variant_get("node", path, "variant")).try_cast("decimal(38,6)")


def token_metrics(rows: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """Sums of the token counts anywhere in a tree, and its calls, by ``keys``; a sum of nothing is missing.

    An object with input or output tokens is a call; ``stats.totalApiCalls`` tells the calls of what has no such object.
    ``compat_calls`` adds the two, so that a result with both counts its calls twice.
    """
    nodes = walk(rows, keys, tree).select(*keys, *[_number(f"$.{t}").alias(t) for t in TOKENS], _number("$.stats.totalApiCalls").alias("told"))
    entry = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    sums = nodes.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in TOKENS], F.count_if(entry).alias("entries"), F.coalesce(F.sum("told"), F.lit(0)).alias("told"))
    calls = F.when(F.col("entries") > 0, F.col("entries")).otherwise(F.col("told"))
    counts = {"api_calls": calls, "compat_calls": F.col("entries") + F.col("told")}
    return sums.select(*keys, *[F.nullif(F.col(t), F.lit(0)).cast("double").alias(t) for t in TOKENS], *[F.nullif(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()])


def depth_of(tree: Column) -> Column:
    """How deep the arrays and objects of a tree are nested: the highest count of open brackets outside of texts."""
    brackets = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.to_json(tree), r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    step = lambda a, c: let(a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(a["most"], n).alias("most")))
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def _review(node: Column) -> Column:
    shown = F.coalesce(F.try_variant_get(node, "$.value", "string"), F.lit(""))
    level = F.lower(F.coalesce(F.try_variant_get(node, "$.confidence", "string"), F.lit("")))
    verified = F.coalesce(F.to_json(F.try_variant_get(node, "$.verified", "variant")) == "true", F.lit(False))
    return ~verified | (level == "low") | shown.contains("[?]") | ~shown.rlike(r"(?U)\S")


def _marked(node: Column, depth: int) -> Column:
    """The JSON text of a node, marked down to ``depth`` levels of brackets."""
    text = F.coalesce(F.to_json(node), F.lit("null"))
    if depth == 0:
        return text
    name = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    members = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
    listed = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))

    def written(s):
        mark = F.exists(s["items"], lambda e: F.coalesce(e["key"].isin(*MARKED), F.lit(False)))
        kept = F.filter(s["items"], lambda e: ~mark | (e["key"] != "needs_review"))
        inner = F.transform(kept, lambda e: F.concat(F.when(e["key"].isNull(), "").otherwise(F.concat(name(e["key"]), F.lit(":"))), _marked(e["value"], depth - 1)))
        review = F.when(mark, F.array(F.concat(F.lit('"needs_review":'), _review(node).cast("string")))).otherwise(F.array().cast("array<string>"))
        ends = lambda a, b: F.when(s["object"], a).otherwise(b)
        # the members are mentioned once: the expression grows with the depth, not with its power
        return F.when(s["items"].isNull(), text).otherwise(F.concat(ends("{", "["), F.array_join(F.concat(inner, review), ","), ends("}", "]")))

    return let(F.struct(F.coalesce(members, listed).alias("items"), members.isNotNull().alias("object")), written)


def _mark(node):
    if isinstance(node, dict):
        if node.keys() & {"confidence", "verified", "value"}:
            value = node.get("value")
            shown = "" if value is None else value if isinstance(value, str) else "true" if value is True else "false" if value is False else json.dumps(value)
            level = str(node.get("confidence") if node.get("confidence") is not None else "").lower()
            node["needs_review"] = node.get("verified") is not True or level == "low" or "[?]" in shown or not shown.strip()
        for x in list(node.values()):
            _mark(x)
    elif isinstance(node, list):
        for x in node:
            _mark(x)


@F.pandas_udf(T.StringType())
def _deep(results: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        tree = json.loads(text)
        _mark(tree)
        return json.dumps(tree, ensure_ascii=False, separators=(",", ":"))

    return results.map(one)


def mark_review_fields(rows: DataFrame, column: str) -> DataFrame:
    """Results as JSON in ``column``, every object with a confidence, value or verification marked by ``needs_review``.

    To be reviewed unless verified, of some confidence, certain and not blank. Second-version results, texts that
    aren't JSON and nulls stay as they are. One pass finds how deep the trees go, so that the second marks them in
    one projection; rows nested more than ``LEVELS`` deep, where there are any, are read apart and go through Python.
    """
    tree = F.try_parse_json(column)
    depth = depth_of(tree)
    deepest = rows.agg(F.max(depth)).first()[0] or 0
    own = F.coalesce(F.try_variant_get(tree, "$.universal_schema", "string") == SECOND, F.lit(False))
    depths = min(deepest, LEVELS)
    marked = let(tree, lambda t: F.when(t.isNull() | own, F.col(column)).otherwise(_marked(t, depths)))
    if deepest <= LEVELS:
        return rows.withColumn(column, marked)
    far = F.coalesce(depth > LEVELS, F.lit(False)) & ~own
    return rows.where(~far).withColumn(column, marked).unionByName(rows.where(far).withColumn(column, _deep(column)))
