"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from leafmill.llm import bpe, centroids, conversations, exact_dedup, language, media, mixing, near_dups, substring_dedup, token_counts, token_records, toxicity, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_near_dups": near_dups.op1_near_dups,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language": language.op6_language,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_media": media.op9_media,
    "op10_bpe": bpe.op10_bpe,
    "op11_token_records": token_records.op11_token_records,
    "op12_conversations": conversations.op12_conversations,
    "op13_centroids": centroids.op13_centroids,
    "dedup_lines": substring_dedup.dedup_lines,
}
ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op12_conversations": conversations.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
    "dedup_lines": substring_dedup.LINES_SQL,
}
