"""The corpus operators' queries and, where SQL can express them on whole tables, their SQL."""

from . import bpe, centroids, decontaminate, langid, line_dedup, ngram_join, pii, quality_model, quality_rules, secrets, sharding, substring_dedup, variants

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_bpe": bpe.op4_bpe,
    "op5_pii": pii.op5_pii,
    "op6_secrets": secrets.op6_secrets,
    "op7_sharding": sharding.op7_sharding,
    "op8_langid": langid.op8_langid,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_quality_classifier": quality_model.op10_quality_classifier,
    "op11_variants": variants.op11_variants,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_centroids": centroids.op13_centroids,
}

SQL = {"op1_line_dedup": line_dedup.SQL, "op2_decontaminate": decontaminate.SQL, "op9_quality_rules": quality_rules.SQL, "op11_variants": variants.SQL, "op12_substring_dedup": substring_dedup.SQL, "op13_centroids": centroids.SQL}
