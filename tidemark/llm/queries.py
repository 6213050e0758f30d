"""Queries of this subpackage and their SQL, by name. Queries without SQL are tested against brute force."""

from . import embedding_dedup, html_text, jaccard_join, mixing, packing, quality, suffix_dedup, token_files, url_filter, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_html_text": html_text.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_mixing": mixing.query,
    "op5_quality": quality.query,
    "op6_url_filter": url_filter.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_token_files": token_files.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_warc": warc.query,
}
ORACLE_SQL = {
    "op4_mixing": mixing.SQL,
    "op6_url_filter": url_filter.SQL,
    "op10_warc": warc.SQL,
}
