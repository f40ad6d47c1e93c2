"""The registered queries of this subpackage and their DuckDB SQL."""
from __future__ import annotations

from weft.llm import centroids, exact_dedup, language, licenses, merkle, mixing, near_dups, neighbours, personal, pieces, quality, shards, urls

QUERIES = {
    "op1_shards": shards.op1_shards,
    "op2_near_duplicates": near_dups.op2_near_duplicates,
    "op3_mix": mixing.op3_mix,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_personal_data": personal.op5_personal_data,
    "op6_url_filter": urls.op6_url_filter,
    "op7_pieces": pieces.op7_pieces,
    "op8_quality": quality.op8_quality,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_language": language.op10_language,
    "op11_merkle": merkle.op11_merkle,
    "op12_centroids": centroids.op12_centroids,
    "op13_licenses": licenses.op13_licenses,
}

ORACLE = {
    "op1_shards": shards.shards_sql(),
    "op3_mix": mixing.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op11_merkle": merkle.SQL,
    "op12_centroids": centroids.SQL,
    "op13_licenses": licenses.SQL,
}
