"""Structured data walked as VARIANT against a walk of the same scripts in Python."""

import json

from sievemark.operators import structured
from sievemark.sources import html

SCRIPTS = [
    '[{"@graph":[{"@type":"Product","name":" Gourde ","offers":[{"@type":"Offer","price":"29.00","priceCurrency":"EUR","availability":"InStock","seller":{"@type":["Organization",3],"name":"A","address":{"streetAddress":"1 rue","addressLocality":"Paris"}}}]}]},{"@type":["Y","Z"],"a":{"@type":"W","l":[1,[2,"x"],{"q":true}]}}]',
    "{bad", '{"@type":"Event","endDate":"2020-01-01","areaServed":["Paris",{"name":"Lyon"}],"b":true,"e":"","f":1.5,"n":null,"offers":{"price":10,"url":"u"}}', "3", "null", '{"@graph":[1,{"@graph":[{"x":1}]}]}', '"text"', "[]", "{}",
    '{"@type":"Deep","a":' * 8 + "1" + "}" * 8,
]


def walked(value):
    """Objects in order of their properties' names, parents first."""
    if isinstance(value, dict):
        yield value
        for k in sorted(value):
            yield from walked(value[k])
    elif isinstance(value, list):
        for x in value:
            yield from walked(x)


def test_nodes_and_properties(spark):
    pages = spark.createDataFrame([(1, SCRIPTS), (2, []), (3, None), (4, SCRIPTS[:1] * 2)], "id int, jsonld array<string>")
    got = {r.id: r.nodes for r in structured.with_nodes(pages, "id").collect()}
    for i, scripts in ((1, SCRIPTS), (4, SCRIPTS[:1] * 2)):
        want = [html.flat(n) for root in html.roots(scripts) for n in walked(root)]
        assert len(got[i]) == len(want)
        for a, b in zip(got[i], want):
            assert (a.types, a.past, a.offer) == (b["types"], b["past"], dict(b["offer"]))
            assert all(a["values"].get(k) == v for k, v in b["values"] if k != "offers")
    assert got[2] == got[3] == []


def test_any_property_at_any_depth(spark):
    pages = spark.createDataFrame([(1, SCRIPTS)], "id int, jsonld array<string>")
    nodes = structured.walk(pages, "id")
    rows = {(tuple(r.path), r.property): r.text for r in structured.properties(nodes, "id").collect()}
    assert {v for (_, p), v in rows.items() if p == "seller"} == {"A"} and {v for (_, p), v in rows.items() if p == "l"} == {'1; 2; x; {"q":true}'}
    assert max(len(p) for p, _ in rows) == 10 and not any(p in ("e", "n") for _, p in rows)
    plan = structured.properties(nodes, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert all(json.loads(r.j) is not None for r in nodes.selectExpr("to_json(node) AS j").collect())


def test_nodes_are_not_sent_whole_to_the_driver(spark):
    pages = spark.createDataFrame([(1, SCRIPTS)], "id int, jsonld array<string>")
    plan = structured.with_nodes(pages, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_only_nations_are_sent_whole_to_the_driver(spark):
    from sievemark.catalog.structured import product_pages

    plan = product_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1


def test_a_value_is_looked_at_once(spark):
    """Each look walks all that the value holds, so the plan must not repeat it a branch."""
    pages = spark.createDataFrame([(1, SCRIPTS)], "id int, jsonld array<string>")
    plan = structured.properties(structured.walk(pages, "id"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") + plan.count("schemaOfVariant") + plan.count("SchemaOfVariant") < 50
