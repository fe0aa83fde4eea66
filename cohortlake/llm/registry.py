"""The corpus queries and their SQL; ``__spark_entry__`` adds them where this subpackage is present."""

from . import chat, decontaminate, language_model, line_dedup, minhash, mixing, quality_rules, sharding, substring_dedup, warc

QUERIES = {
    "op1_learned_quality_rules": quality_rules.op1_learned_quality_rules,
    "op2_kneser_ney_classifier": language_model.op2_kneser_ney_classifier,
    "op3_compact_window_passages": substring_dedup.op3_compact_window_passages,
    "op4_bloom_line_dedup": line_dedup.op4_bloom_line_dedup,
    "op5_sampled_splitter_shards": sharding.op5_sampled_splitter_shards,
    "op6_circulant_minhash": minhash.op6_circulant_minhash,
    "op7_hypergeometric_mix": mixing.op7_hypergeometric_mix,
    "op8_index_first_warc": warc.op8_index_first_warc,
    "op9_template_decontamination": decontaminate.op9_template_decontamination,
    "op10_snapshot_collapse": chat.op10_snapshot_collapse,
}

SQL = {
    "op4_bloom_line_dedup": line_dedup.OP4_SQL,
    "op6_circulant_minhash": minhash.OP6_SQL,
    "op8_index_first_warc": warc.OP8_SQL,
    "op9_template_decontamination": decontaminate.OP9_SQL,
    "op10_snapshot_collapse": chat.OP10_SQL,
}
