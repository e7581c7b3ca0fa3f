"""Structured data of pages as VARIANT: every object at any depth with every property, walked in the JVM.

Scripts are parsed once. A round descends one level for all pages together: objects and lists hand on what they hold, objects are
nodes. A node's place is the path of positions that leads to it, so that sorted places give parents before children. A VARIANT keeps an
object's properties in order of their names, so siblings under different properties come in that order, not in that of the script.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import written
from ..sources.html import ADDRESS_PARTS

ITEMS, OBJECT = "array<variant>", "map<string,variant>"
#: Lists in lists, and addresses in lists, are rendered to this depth; what is deeper is shown as JSON.
RENDERED = 2
#: Prefix of the properties of a node's first offer among its own.
OFFER = "offers."


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(_kind(v), F.lit(kind))


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", ITEMS)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", OBJECT)


def roots(pages: DataFrame, *keys: str, scripts: str = "jsonld") -> DataFrame:
    """(keys, path, v): top-level objects of an array of scripts; lists are opened, ``@graph`` once, broken scripts skipped."""
    read = F.filter(F.transform(scripts, lambda raw, s: F.struct(s.alias("s"), F.try_parse_json(raw).alias("v"))), lambda x: x["v"].isNotNull())
    each = T.exploded(pages, *keys, x=read).select(*keys, "x.s", "x.v")
    objects = lambda listed, at: F.filter(F.transform(listed, lambda x, i: F.struct(i.alias(at), x.alias("v"))), lambda x: _is(x["v"], "OBJECT"))
    top = T.exploded(each, *keys, "s", x=objects(F.coalesce(_items(F.col("v")), F.array("v")), "i")).select(*keys, "s", "x.i", "x.v")
    graph = F.try_variant_get(F.col("v"), "$['@graph']", ITEMS)
    opened = T.exploded(top, *keys, "s", "i", x=objects(F.coalesce(graph, F.array("v")), "g"))
    return opened.select(*keys, F.array("s", "i", "x.g").alias("path"), F.col("x.v").alias("v"))


def walk(pages: DataFrame, *keys: str, scripts: str = "jsonld") -> DataFrame:
    """(keys, path, node): every object of the scripts. One pass a level; only objects and lists that hold others go on."""
    level, found = written(roots(pages, *keys, scripts=scripts).withColumn("is_object", F.lit(True)), "json-level"), []
    while not level.isEmpty():
        found.append(level.where("is_object"))
        held = F.coalesce(_items(F.col("v")), F.map_values(_object(F.col("v"))))
        kinds = F.transform(held, lambda x, k: F.struct(k.alias("k"), x.alias("x"), _kind(x).alias("kind")))
        inner = F.filter(kinds, lambda e: F.startswith(e["kind"], F.lit("OBJECT")) | F.startswith(e["kind"], F.lit("ARRAY")))
        below = T.exploded(level, *keys, "path", e=inner)
        level = written(below.select(*keys, F.concat("path", F.array("e.k")).alias("path"), F.col("e.x").alias("v"), F.startswith("e.kind", F.lit("OBJECT")).alias("is_object")), "json-level")
    return reduce(DataFrame.unionByName, found or [level]).drop("is_object").withColumnRenamed("v", "node")


def types(node: Column) -> Column:
    kind = _object(node)["@type"]
    return F.when(_is(kind, "STRING"), F.array(kind.cast("string"))).otherwise(F.coalesce(F.transform(_items(kind), lambda x: x.cast("string")), F.array().cast("array<string>")))


def _scalar(v: Column, kind: Column) -> Column:
    whole = kind.isin("BIGINT") | F.startswith(kind, F.lit("DECIMAL")) & F.endswith(kind, F.lit(",0)"))
    # A fraction without its trailing zeros but one, as a double is shown.
    fraction = F.regexp_replace(F.regexp_replace(v.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    return (
        F.when(kind == "STRING", F.trim(v.cast("string"))).when(kind == "BOOLEAN", F.initcap(v.cast("string"))).when(whole, v.cast("string"))
        .when(F.startswith(kind, F.lit("DECIMAL")), fraction).when(kind == "VOID", F.lit(None)).otherwise(v.cast("string"))
    )


def _shown(v: Column, depth: int) -> Column:
    """A property as text, empty or null where nothing is said. Each value and its kind are looked at once: both cost a walk of all it holds."""
    joined = lambda parts, by: F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), by)

    def of_kind(t: Column) -> Column:
        x, kind = t["x"], t["kind"]
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        if not depth:
            return F.when(nested, F.to_json(x)).otherwise(_scalar(x, kind))
        listed = joined(F.transform(_items(x), lambda y: _shown(y, depth - 1)), "; ")
        parts = F.array(*(F.try_variant_get(x, f"$.{k}", "variant") for k in ADDRESS_PARTS))
        named = T.let(joined(F.transform(F.filter(parts, lambda y: y.isNotNull()), lambda y: _shown(y, 0)), ", "), lambda n: F.when(n != "", n).otherwise(F.to_json(x)))
        return F.when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), named).otherwise(_scalar(x, kind))

    return T.let(F.struct(v.alias("x"), _kind(v).alias("kind")), of_kind)


def rendered(v: Column, depth: int = RENDERED) -> Column:
    """A property as text: lists by ``; ``, addresses and names by ``, ``, other objects as JSON; null where nothing is said."""
    return T.let(_shown(v, depth), lambda s: F.nullif(s, F.lit("")))


def _told(node: Column, first_offer: bool) -> Column:
    """(key, text) of all properties of a node that say something; with ``first_offer`` its first offer's too, under ``offers.``."""
    texts = lambda held, prefix: F.filter(F.transform(held, lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("key"), _shown(e["value"], RENDERED).alias("text"))), lambda e: F.coalesce(e["text"], F.lit("")) != "")
    own = texts(F.map_entries(_object(node)), "")
    if not first_offer:
        return own
    listed = F.try_variant_get(node, "$.offers", ITEMS)
    first = F.coalesce(F.try_variant_get(node, "$.offers", OBJECT), _object(F.try_element_at(F.filter(listed, lambda x: _is(x, "OBJECT")), F.lit(1))))
    return F.concat(own, F.coalesce(texts(F.map_entries(first), OFFER), F.slice(own, 1, 0)))


def properties(nodes: DataFrame, *keys: str, first_offer: bool = True) -> DataFrame:
    """(keys, path, property, text): every property of every node that says something, by any name; with ``first_offer`` the first offer's under ``offers.``."""
    each = T.exploded(nodes, *keys, "path", e=_told(F.col("node"), first_offer))
    return each.select(*keys, "path", F.col("e.key").alias("property"), "e.text")


def flattened(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, nodes): a page's nodes in order of their places, each as types, past, offer and values - all its properties, by name.

    The same shape as the parser's column, which facts and offers are made from; a page's script bounds its size.
    """
    m = F.col("m")
    told = nodes.select(*keys, "path", types(F.col("node")).alias("types"), F.map_from_entries(_told(F.col("node"), True)).alias("m"))
    offer = lambda *names: F.coalesce(*(m[f"{OFFER}{n}"] for n in names))
    wanted = F.map_filter(
        F.create_map(F.lit("price"), offer("price"), F.lit("priceCurrency"), offer("priceCurrency"), F.lit("availability"), offer("availability"), F.lit("url"), offer("url"), F.lit("frequency"), offer("billingDuration", "priceSpecification")),
        lambda _, v: v.isNotNull(),
    )
    flat = F.struct("types", F.coalesce(m["endDate"], m["startDate"]).alias("past"), wanted.alias("offer"), F.map_filter("m", lambda k, _: ~F.startswith(k, F.lit(OFFER))).alias("values"))
    packed = told.select(*keys, "path", flat.alias("n")).groupBy(*keys).agg(F.collect_list(F.struct("path", "n")).alias("all"))
    # Only the path is compared: maps have no order.
    listed = F.array_sort("all", lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    return packed.select(*keys, F.transform(listed, lambda x: x["n"]).alias("nodes"))


def with_nodes(pages: DataFrame, *keys: str, scripts: str = "jsonld") -> DataFrame:
    """``pages`` (unique by ``keys``) with the column ``nodes`` made from their scripts."""
    found = flattened(walk(pages, *keys, scripts=scripts), *keys)
    rest = pages.drop("nodes") if "nodes" in pages.columns else pages
    none = F.array().cast(found.schema["nodes"].dataType)
    # Merged: nodes compress so well that their size on disk would have them sent whole to the driver.
    return rest.join(found.hint("merge"), [*keys], "left").withColumn("nodes", F.coalesce("nodes", none))
