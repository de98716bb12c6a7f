"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from gaugeline.llm import bpe, exact_dedup, jaccard, licenses, lm, merkle, mixing, quality, ranked, secrets, simhash, toxicity, whitening
from gaugeline.llm.common import table


def op1_exact_dedup(spark, folder):
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op2_secret_scan(spark, folder):
    return secrets.scan_secrets(table(spark, folder, "documents"))


def op3_source_mixing(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents"))


def op4_merkle_fingerprints(spark, folder):
    return merkle.compared_documents(table(spark, folder, "documents"))


def op5_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_toxicity(spark, folder):
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_lm_scores(spark, folder):
    return lm.score(table(spark, folder, "documents"))


def op8_license_scan(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op9_quality(spark, folder):
    return quality.select_by_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_bpe(spark, folder):
    return bpe.encoded_digests(table(spark, folder, "documents"))


def op11_jaccard_join(spark, folder):
    return jaccard.jaccard_join(table(spark, folder, "documents"))


def op12_embedding_whitening(spark, folder):
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_ranked_search(spark, folder):
    return ranked.best_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_secret_scan,
        op3_source_mixing,
        op4_merkle_fingerprints,
        op5_simhash_near_dedup,
        op6_toxicity,
        op7_lm_scores,
        op8_license_scan,
        op9_quality,
        op10_bpe,
        op11_jaccard_join,
        op12_embedding_whitening,
        op13_ranked_search,
    )
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_secret_scan": secrets.oracle(),
    "op3_source_mixing": mixing.oracle(),
    "op11_jaccard_join": jaccard.ORACLE,
    "op13_ranked_search": ranked.ORACLE,
}
