"""The registered queries opN_<name>: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.llm import oracles
from leafgrid.llm.clustering import cluster_digest, lloyd
from leafgrid.llm.common import read
from leafgrid.llm.exact_dedup import exact_dedup
from leafgrid.llm.language_id import identify
from leafgrid.llm.licenses import ALL_TEMPLATES, scan_licenses
from leafgrid.llm.mixing import mix
from leafgrid.llm.packing import pack
from leafgrid.llm.quality import score_quality
from leafgrid.llm.ranked import rank_documents
from leafgrid.llm.secrets import scan_secrets, secret_digest
from leafgrid.llm.simhash import near_components
from leafgrid.llm.substring import drop_repeats
from leafgrid.llm.topk import top_k
from leafgrid.llm.url_filter import judge_urls
from leafgrid.plans.registry import Registry

REGISTRY = Registry()


@REGISTRY.query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    return near_components(read(spark, sf_dir, "documents"))


@REGISTRY.query("op2_license_scan")
def op2_license_scan(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"), templates=ALL_TEMPLATES)


@REGISTRY.query("op3_language_id")
def op3_language_id(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))


@REGISTRY.query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@REGISTRY.query("op5_exact_dedup", oracles.OP5)
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


@REGISTRY.query("op6_top_k", oracles.OP6)
def op6_top_k(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@REGISTRY.query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    return secret_digest(scan_secrets(read(spark, sf_dir, "documents")))


@REGISTRY.query("op8_url_filter", oracles.OP8)
def op8_url_filter(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"))


@REGISTRY.query("op9_mixing", oracles.OP9)
def op9_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"))


@REGISTRY.query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))


@REGISTRY.query("op11_substring_dedup", oracles.OP11)
def op11_substring_dedup(spark, sf_dir):
    kept = drop_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@REGISTRY.query("op13_ranked_search", oracles.OP13)
def op13_ranked_search(spark, sf_dir):
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@REGISTRY.query("op12_centroid_clustering", oracles.OP12)
def op12_centroid_clustering(spark, sf_dir):
    return cluster_digest(*lloyd(read(spark, sf_dir, "embeddings")))
