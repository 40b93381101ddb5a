"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from lumenframe.llm import avi, balls, lines, mixing, packing, pages, prefixes, quality, secret_scan, simhash, spotsigs, suffixes, windows
from lumenframe.llm.common import table


def op1_secret_forest(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_additive_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_avi_clips(spark, sf_dir):
    return avi.media_digest(table(spark, sf_dir, "documents"))


def op4_spotsigs(spark, sf_dir):
    return spotsigs.with_next(table(spark, sf_dir, "documents"))


def spotsigs_classes(spark, sf_dir):
    """The sets that op4 fingerprints, compared within and between length ranges by pruned Jaccard."""
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents"))


def op5_golay_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sparse_suffixes(spark, sf_dir):
    return suffixes.passages(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_temperature_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("mark")


def op9_line_chunks(spark, sf_dir):
    return lines.remove_repeats(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op10_window_dedup(spark, sf_dir):
    return windows.remove_repeats(table(spark, sf_dir, "documents"))


def op11_ball_kmeans(spark, sf_dir):
    return balls.cluster(table(spark, sf_dir, "embeddings"))


def op12_consensus_paths(spark, sf_dir):
    return pages.main_text(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark, sf_dir):
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_forest, op2_additive_quality, op3_avi_clips, op4_spotsigs, spotsigs_classes, op5_golay_simhash, op6_sparse_suffixes, op7_best_fit_packing,
        op8_temperature_mixing, op9_line_chunks, op10_window_dedup, op11_ball_kmeans, op12_consensus_paths, op13_prefix_trie, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op4_spotsigs": spotsigs.ORACLE,
    "spotsigs_classes": spotsigs.CLASSES,
    "op8_temperature_mixing": mixing.ORACLE,
    "op9_line_chunks": lines.ORACLE,
    "op11_ball_kmeans": balls.ORACLE,
    "op13_prefix_trie": prefixes.ORACLE,
}
