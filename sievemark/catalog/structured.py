"""Structured data over the given tables: every part as the page of a product that a supplier offers, its JSON-LD walked as VARIANT.

The SQL twins walk the same scripts as JSON trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, offers, structured
from ..plans import siteaudit

KEYS = ("site_id", "page_ord", "url")


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, page_ord, url, jsonld): a site per supplier, a page per part, with the supplier's place as a nested address."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    first = read("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    # Merged: tables of keys and repeated names are small on disk and large in memory, so none but the nations is sent whole to the driver.
    t = read("part").join(first.hint("merge"), "p_partkey").join(read("supplier").hint("merge"), "s_suppkey").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    is_a = lambda k: F.lit(k).alias("@type")
    address = F.struct(is_a("PostalAddress"), F.col("n_name").alias("addressLocality"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("addressCountry"))
    seller = F.struct(is_a("Organization"), F.col("s_name").alias("name"), address.alias("address"))
    stock = F.when(F.col("p_partkey") % 3 == 0, "OutOfStock").otherwise("InStock")
    offer = F.struct(is_a("Offer"), F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), F.lit("EUR").alias("priceCurrency"), stock.alias("availability"), seller.alias("seller"))
    product = F.struct(F.array(F.lit("Product"), F.lit("Thing")).alias("@type"), F.col("p_name").alias("name"), F.struct(is_a("Brand"), F.col("p_brand").alias("name")).alias("brand"), F.array(offer).alias("offers"), F.col("p_size").cast("bigint").alias("size"))
    site = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".test"))
    script = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.array(product).alias("@graph")))
    return t.select(site.alias("site_id"), F.col("p_partkey").cast("int").alias("page_ord"), F.concat(F.lit("https://"), site, F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"), F.array(script, F.lit("{broken")).alias("jsonld"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.walk(product_pages(spark, sf_dir), *KEYS)


def structured_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects per site and type, and how deep they lie below their root."""
    n = _nodes(spark, sf_dir).select("site_id", F.explode(structured.types(F.col("node"))).alias("type"), (F.size("path") - 3).alias("depth"))
    return n.groupBy("site_id", "type").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


def structured_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property of every object, by any name."""
    p = structured.properties(_nodes(spark, sf_dir), *KEYS, first_offer=False)
    return p.groupBy("property").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), F.min("text").alias("first_text"))


def structured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the sites from their objects."""
    found = facts.node_candidates(structured.with_nodes(product_pages(spark, sf_dir), *KEYS))
    return found.groupBy("site_id", "field", "value").agg(F.count("*").alias("n"), F.min("page_ord").alias("first_page"))


def structured_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of the sites from their objects."""
    found = offers.node_offers(structured.with_nodes(product_pages(spark, sf_dir), *KEYS), siteaudit.AS_OF)
    return found.select("site_id", "page_ord", "name", "url", "offer_type", "candidate_role", "price_value", "currency", "availability", "confidence")


QUERIES = {f.__name__: f for f in (structured_nodes, structured_properties, structured_facts, structured_offers)}

_TREE = """WITH f AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1),
d AS (
  SELECT 's' || s_suppkey || '.test' AS site_id, p_partkey::INT AS page_ord,
    json_object('@graph', [json_object('@type', ['Product', 'Thing'], 'name', p_name, 'brand', json_object('@type', 'Brand', 'name', p_brand),
      'offers', [json_object('@type', 'Offer', 'price', p_retailprice::DECIMAL(12, 2)::VARCHAR, 'priceCurrency', 'EUR', 'availability', CASE WHEN p_partkey % 3 = 0 THEN 'OutOfStock' ELSE 'InStock' END,
        'seller', json_object('@type', 'Organization', 'name', s_name, 'address', json_object('@type', 'PostalAddress', 'addressLocality', n_name, 'addressCountry', 'R' || n_regionkey)))],
      'size', p_size::BIGINT)]) AS j
  FROM part JOIN f USING (p_partkey) JOIN supplier USING (s_suppkey) JOIN nation ON s_nationkey = n_nationkey),
t AS MATERIALIZED (SELECT site_id, page_ord, u.key, u.value, u.type, u.id, u.parent, u.fullkey FROM d, json_tree(d.j) u),
o AS MATERIALIZED (SELECT site_id, page_ord, id, value, fullkey FROM t WHERE type = 'OBJECT' AND fullkey <> '$'),
k AS MATERIALIZED (SELECT o.site_id, o.page_ord, o.id, c.key, c.type, c.value FROM o JOIN t c ON c.site_id = o.site_id AND c.page_ord = o.page_ord AND c.parent = o.id),
s AS (SELECT site_id, page_ord, id, CASE WHEN type = 'ARRAY' THEN value::VARCHAR[] ELSE [value->>'$'] END AS types FROM k WHERE key = '@type'),
x AS MATERIALIZED (
  SELECT k.site_id, k.page_ord, k.id, k.key, s.types, CASE WHEN k.type = 'OBJECT' THEN nullif(concat_ws(', ', value->>'$.name', value->>'$.addressLocality', value->>'$.addressCountry'), '')
    WHEN k.type = 'ARRAY' AND key = '@type' THEN array_to_string(types, '; ') WHEN k.type = 'ARRAY' THEN NULL ELSE value->>'$' END AS text
  FROM k JOIN s USING (site_id, page_ord, id))"""

ORACLES = {
    "structured_nodes": f"""{_TREE}
SELECT site_id, unnest(types) AS type, count(*) AS n, max(len(regexp_extract_all(replace(fullkey, '$."@graph"[0]', ''), '\\.|\\['))::INT) AS depth FROM o JOIN s USING (site_id, page_ord, id) GROUP BY 1, 2""",
    # The list of offers is shown as its objects are: an offer has neither name nor address, so as JSON.
    "structured_properties": f"""{_TREE},
y AS (SELECT key AS property, text FROM x WHERE key <> 'offers'
  UNION ALL SELECT 'offers', to_json({{'@type': 'Offer', 'availability': value->>'$[0].availability', 'price': value->>'$[0].price', 'priceCurrency': value->>'$[0].priceCurrency',
    'seller': {{'@type': 'Organization', 'address': {{'@type': 'PostalAddress', 'addressCountry': value->>'$[0].seller.address.addressCountry', 'addressLocality': value->>'$[0].seller.address.addressLocality'}}, 'name': value->>'$[0].seller.name'}}}})::VARCHAR
  FROM k WHERE key = 'offers')
SELECT property, count(*) AS n, count(DISTINCT text) AS n_texts, min(text) AS first_text FROM y GROUP BY 1""",
    "structured_facts": f"""{_TREE},
c AS (
  SELECT site_id, page_ord, CASE key WHEN 'name' THEN 'business_name' WHEN 'address' THEN 'address' END AS field, text FROM x WHERE list_contains(types, 'Organization') AND key IN ('name', 'address')
  UNION ALL SELECT site_id, page_ord, CASE key WHEN 'price' THEN 'pricing' ELSE 'availability' END, text FROM x WHERE list_contains(types, 'Offer') AND key IN ('price', 'availability'))
SELECT site_id, field, text AS value, count(*) AS n, min(page_ord) AS first_page FROM c GROUP BY 1, 2, 3""",
    "structured_offers": f"""{_TREE}
SELECT site_id, page_ord, value->>'$.name' AS name, 'https://' || site_id || '/p/' || page_ord AS url, 'product' AS offer_type, 'product' AS candidate_role, (value->>'$.offers[0].price')::DOUBLE AS price_value,
  value->>'$.offers[0].priceCurrency' AS currency, value->>'$.offers[0].availability' AS availability, 1.0::DOUBLE AS confidence
FROM o JOIN s USING (site_id, page_ord, id) WHERE list_contains(types, 'Product')""",
}
