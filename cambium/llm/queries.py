"""The corpus queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers

from . import bpe, decontaminate, exact_dedup, exact_topk, filter_audit, langid, license_scan, ngram_join, prefix_trie, secret_scan, sharding, suffix_dedup, toxicity
from .common import table

#: The vocabulary of the production encoding; a parameter of the operator.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {
    "op1_bpe": lambda spark, sf_dir: bpe.bpe_digest(table(spark, sf_dir, "documents"), VOCABULARY),
    "op2_suffix_dedup": lambda spark, sf_dir: suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")),
    "op3_langid": lambda spark, sf_dir: langid.language_id(table(spark, sf_dir, "documents")),
    "op4_decontaminate": lambda spark, sf_dir: decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op5_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(table(spark, sf_dir, "documents")),
    "op6_license_scan": lambda spark, sf_dir: license_scan.license_scan(table(spark, sf_dir, "documents")),
    "op7_secret_scan": lambda spark, sf_dir: secret_scan.secret_scan(table(spark, sf_dir, "documents")),
    "op8_sharding": lambda spark, sf_dir: sharding.shard_by_bytes(table(spark, sf_dir, "documents")),
    "op9_toxicity": lambda spark, sf_dir: toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_ngram_join": lambda spark, sf_dir: ngram_join.ngram_join(table(spark, sf_dir, "documents")),
    "op11_prefix_trie": lambda spark, sf_dir: prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")),
    "op12_exact_topk": lambda spark, sf_dir: exact_topk.exact_top_k(table(spark, sf_dir, "embeddings")),
    "op13_filter_audit": lambda spark, sf_dir: filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}

ORACLE_SQL = {
    "op2_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_license_scan": license_scan.ORACLE_SQL,
    "op7_secret_scan": secret_scan.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
    "op10_ngram_join": ngram_join.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_exact_topk": exact_topk.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
