"""Queries of this subpackage for the driver, and SQL for those that SQL can express."""

from . import archive, chat, contamination, jaccard, language, mixing, quality, rules, substrings, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_quality_classifier": quality.op2,
    "op3_jaccard_join": jaccard.op3,
    "op4_quality_rules": rules.op4,
    "op5_source_mixing": mixing.op5,
    "op6_warc_archive": archive.op6,
    "op7_substring_dedup": substrings.op7,
    "op8_language_id": language.op8,
    "op9_chat_format": chat.op9,
    "op10_decontamination": contamination.op10,
    "pipeline": _pipeline,
}

SQL = {
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op6_warc_archive": archive.OP6_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
