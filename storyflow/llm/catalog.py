"""One thin query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers

from storyflow.llm import bpe, decontamination, forest, language, licenses, line_dedup, ngram_jaccard, periodic, recompression, resampling, sharding, toxicity, warc
from storyflow.llm.common import table
from storyflow.llm.queries import query


@query("op1_warc")
def op1_warc(spark, folder):
    return warc.archive_round_trip(table(spark, folder, "pages"))


@query("op6_toxicity")
def op6_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_bpe")
def op5_bpe(spark, folder):
    return bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_sharding")
def op7_sharding(spark, folder):
    return sharding.shards(table(spark, folder, "documents"))


@query("op2_licenses")
def op2_licenses(spark, folder):
    return licenses.licenses(table(spark, folder, "documents"))


@query("op9_recompression")
def op9_recompression(spark, folder):
    return recompression.dedup_substrings(table(spark, folder, "documents"))


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark, folder):
    return ngram_jaccard.near_copies(table(spark, folder, "documents"), ngram_jaccard.Settings(words=3, percent=90))


@query("op10_forest")
def op10_forest(spark, folder):
    return forest.near_vectors(table(spark, folder, "embeddings"))


@query("op8_line_dedup")
def op8_line_dedup(spark, folder):
    return line_dedup.repeated_lines(table(spark, folder, "documents"))


@query("op3_decontamination")
def op3_decontamination(spark, folder):
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_language")
def op11_language(spark, folder):
    return language.languages(table(spark, folder, "documents"))


@query("op12_resampling")
def op12_resampling(spark, folder):
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, folder):
    return periodic.periodic_runs(table(spark, folder, "documents"))
