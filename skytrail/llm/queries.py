"""The queries of this subpackage and, where SQL can express them, their SQL."""

from skytrail.llm import jaccard_join, line_dedup, mixing, pieces, quality_rules, sharding, tiff, token_counts, url_filter, warc

QUERIES = {
    "op1_jaccard_join": jaccard_join.query,
    "op2_tiff_pages": tiff.query,
    "op3_lpt_shards": sharding.query,
    "op4_url_filter": url_filter.query,
    "op5_pfair_mixing": mixing.query,
    "op6_warc_zip": warc.query,
    "op7_quality_rules": quality_rules.query,
    "op8_sentencepiece": pieces.query,
    "op9_token_counts": token_counts.query,
    "op10_line_dedup": line_dedup.query,
}

ORACLE_SQL = {
    "op1_jaccard_join": jaccard_join.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op6_warc_zip": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
