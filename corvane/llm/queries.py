"""The operators' queries and SQL, added to the driver's by __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, fingerprint, mixing, near_dedup, repeats, shard_pack, token_counts, token_store, toxicity, url_rules

QUERIES = {
    f.__name__: f
    for f in (
        token_store.op1_token_store,
        decontaminate.op2_decontamination,
        shard_pack.op3_shard_packing,
        near_dedup.op4_near_dedup,
        token_counts.op5_token_counts,
        repeats.op6_repeated_passages,
        mixing.op7_source_mixing,
        url_rules.op8_url_filter,
        toxicity.op9_toxicity,
        fingerprint.op10_fingerprint,
    )
}

ORACLE_SQL = {"op2_decontamination": decontaminate.SQL, "op4_near_dedup": near_dedup.SQL, "op8_url_filter": url_rules.SQL}
