"""Registered queries over the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from catalog.registry import query
from tidemark.llm import bpe, collocations, decontaminate, fim, licenses, lm, mil, neighbours, quality, secrets, simhash, substring, urls
from tidemark.llm.common import documents
from tidemark.llm.sql import COLLOCATION_SQL, FIM_SQL, LM_ORDER_2_SQL, LM_SQL, QUALITY_SQL, SUBSTRING_SQL

#: The vocabulary of the production queries; every executor has the file.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@query("op1_secret_scan")
def op1(spark, sf):
    return secrets.digests(secrets.scan(documents(spark, sf)))


@query("op3_quality_rules", QUALITY_SQL)
def op3(spark, sf):
    return quality.judge(documents(spark, sf))


@query("op5_byte_bpe")
def op5(spark, sf):
    encoded = bpe.encode(documents(spark, sf), RANKS, PATTERN)
    return bpe.digests(bpe.decode(encoded, RANKS))


@query("op7_simhash_near_dedup")
def op7(spark, sf):
    return simhash.cluster(documents(spark, sf))


@query("op9_benchmark_decontamination")
def op9(spark, sf):
    return decontaminate.leaks(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op2_substring_dedup", SUBSTRING_SQL)
def op2(spark, sf):
    return substring.digests(substring.deduplicate(documents(spark, sf)))


@query("op4_lm_scoring", LM_SQL)
def op4(spark, sf):
    return lm.score(documents(spark, sf))


@query("op4_lm_scoring_order2", LM_ORDER_2_SQL)
def op4_order2(spark, sf):
    return lm.score(documents(spark, sf), 2)


@query("op10_license_scan")
def op10(spark, sf):
    return licenses.scan(documents(spark, sf))


@query("op8_quality_classifier")
def op8(spark, sf):
    return mil.classify(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op6_url_filter")
def op6(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return urls.judge(pages, urls.labelled_by_rules(pages))


@query("op11_nearest_neighbours")
def op11(spark, sf):
    return neighbours.search(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


@query("op12_phrase_collocations", COLLOCATION_SQL)
def op12(spark, sf):
    return collocations.collocations(documents(spark, sf))


@query("op13_fill_in_middle", FIM_SQL)
def op13(spark, sf):
    return fim.digests(fim.transform(documents(spark, sf)))
