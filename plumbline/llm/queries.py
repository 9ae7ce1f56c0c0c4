"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm import centroids, filter_audit, licences, lm_scoring, mixing, multi_index, packing, quality_rules, secrets, sharding, simhash, url_rules, vector_dedup
from plumbline.session import table


def queries() -> dict:
    return {
        "op1_quality_rules": lambda s, d: quality_rules.op1_query(table(s, d, "documents")),
        "op2_secrets": lambda s, d: secrets.op2_query(table(s, d, "documents")),
        "op3_packing": lambda s, d: packing.op3_query(table(s, d, "documents")),
        "op4_url_rules": lambda s, d: url_rules.op4_query(table(s, d, "pages")),
        "op5_vectors": lambda s, d: vector_dedup.op5_query(table(s, d, "embeddings")),
        "op6_sharding": lambda s, d: sharding.op6_query(table(s, d, "documents")),
        "op7_simhash": lambda s, d: simhash.op7_query(table(s, d, "documents")),
        "op8_lm_scores": lambda s, d: lm_scoring.op8_query(table(s, d, "documents")),
        "op9_mixing": lambda s, d: mixing.op9_query(table(s, d, "documents")),
        "op10_licences": lambda s, d: licences.op10_query(table(s, d, "documents")),
        "op11_centroids": lambda s, d: centroids.op11_query(table(s, d, "embeddings")),
        "op12_filter_audit": lambda s, d: filter_audit.op12_query(table(s, d, "documents"), table(s, d, "labels")),
        "op13_neighbours": lambda s, d: multi_index.op13_query(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op4_url_rules": url_rules.OP4_SQL,
        "op5_vectors": vector_dedup.OP5_SQL,
        "op6_sharding": sharding.OP6_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op10_licences": licences.op10_sql(),
        "op11_centroids": centroids.op11_sql(),
        "op12_filter_audit": filter_audit.OP12_SQL,
    }
