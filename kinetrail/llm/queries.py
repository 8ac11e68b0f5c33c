"""Queries on texts, and the SQL they are compared with."""

from kinetrail.llm import mixing, postures, quality, tokens

QUERIES = {
    "p2_found": postures.p2_found,
    "p2_clusters": postures.p2_clusters,
    "p6_ids": tokens.p6_ids,
    "p7_mixture": mixing.p7_mixture,
    "p7_shares": mixing.p7_shares,
    "p8_found": quality.p8_found,
    "p8_stats": quality.p8_stats,
}

#: Tokenizers and text rules are no SQL; they are compared with the library and with brute force in the tests.
SQL: dict[str, str] = {}
