"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, license, mixing, packing, quality, search, simhash, spelling, tokencount, tokenfile, trie, urlfilter
from .common import table

#: End-of-document ids: the vocabulary's own for flat files, the contract's for framed files.
FLAT_END_ID, FRAMED_END_ID = 50256, 2
#: Of the encoder's memo where a worker does little else; the pipeline, whose executors hold more, keeps to the default.
OUTPUT_MEMO_BYTES = 128 << 20

URL_RULES = [
    urlfilter.UrlRule("block", "net/"),
    urlfilter.UrlRule("allow", "example.net/en/"),
    urlfilter.UrlRule("block", "example.com/de/"),
    urlfilter.UrlRule("allow", "org/fr/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), FLAT_END_ID)


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenfile.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), FRAMED_END_ID, memo_bytes=OUTPUT_MEMO_BYTES)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_prediction(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), FRAMED_END_ID)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"), typos=True)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


#: A small host graph (src, dst, n) with a chain, a link farm, a cycle, hosts without outgoing links and one without any, and the seeds.
HOST_LINKS = [
    ("c1", "c2", 1), ("c2", "c3", 1), ("c3", "c4", 1), ("f1", "bad", 3), ("f2", "bad", 1), ("f3", "bad", 2), ("f1", "f2", 1), ("f2", "f3", 1), ("f3", "f1", 1), ("x", "y", 1), ("y", "z", 2), ("z", "x", 1), ("z", "c1", 1),
    ("good", "c1", 4), ("good", "x", 1), ("hub", "good", 1), ("hub", "bad", 1), ("hub", "c4", 8),
]
HOST_SEEDS = [("good", 1.0), ("c1", 0.25), ("x", 0.5), ("alone", 1.0), ("bad", 0.0)]
HOST_ROUNDS = 20


def host_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks after HOST_ROUNDS rounds on the small host graph; ``pages`` of the given tables hardly link."""
    edges = spark.createDataFrame(HOST_LINKS, "src string, dst string, n bigint")
    seeds = spark.createDataFrame(HOST_SEEDS, "host string, seed double")
    return urlfilter.propagate(edges, seeds, rounds=HOST_ROUNDS).select("host", F.round("mass", 9).alias("mass"))


def _propagation_sql() -> str:
    rows = lambda x: ", ".join(map(str, x))
    start = f"""WITH e(src, dst, n) AS (VALUES {rows(HOST_LINKS)}), s(host, seed) AS (VALUES {rows(HOST_SEEDS)}),
p AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM e),
h AS MATERIALIZED (SELECT host, coalesce(seed, 0)::DOUBLE AS seed, host NOT IN (SELECT src FROM e) AS keeps FROM (SELECT src AS host FROM e UNION SELECT dst FROM e UNION SELECT host FROM s) LEFT JOIN s USING (host)),
r0 AS MATERIALIZED (SELECT host, seed AS mass FROM h)"""
    turn = """,
r{k} AS MATERIALIZED (SELECT h.host, {rest} * seed + {damping} * (coalesce(got, 0) + CASE WHEN keeps THEN mass ELSE 0 END) AS mass
  FROM h JOIN r{j} USING (host) LEFT JOIN (SELECT dst AS host, sum(mass * p) AS got FROM p JOIN r{j} ON host = src GROUP BY dst) USING (host))"""
    turns = (turn.format(k=k, j=k - 1, damping=urlfilter.DAMPING, rest=1 - urlfilter.DAMPING) for k in range(1, HOST_ROUNDS + 1))
    return f"{start}{''.join(turns)} SELECT host, round(mass, 9)::DOUBLE AS mass FROM r{HOST_ROUNDS}"


QUERIES = {
    "host_propagation": host_propagation,
    "op1_token_counts": op1_token_counts,
    "op2_token_id_output": op2_token_id_output,
    "op3_source_mixing": op3_source_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_exact_search": op10_exact_search,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES = {"op3_source_mixing": mixing.ORACLE, "op9_benchmark_decontamination": decontaminate.ORACLE, "op10_exact_search": search.ORACLE, "op12_spelling_variants": spelling.ORACLE, "op13_conversation_trie": trie.ORACLE, "host_propagation": _propagation_sql()}
