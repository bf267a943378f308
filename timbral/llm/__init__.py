"""Operators of a training-data pipeline, each in a module with its query and, where SQL can say it, its SQL."""

from __future__ import annotations


def queries() -> dict:
    """Query name -> callable(spark, sf_dir) of every operator here."""
    from . import decontaminate, jaccard, licenses, packing, sharding, simhash, suffix, tokens, toxicity, warc

    return {
        "op1_warc": warc.query,
        "op2_jaccard": jaccard.query,
        "op3_token_output": tokens.query,
        "op4_simhash": simhash.query,
        "op5_packing": packing.query,
        "op6_suffix_dedup": suffix.query,
        "op7_toxicity": toxicity.query,
        "op8_sharding": sharding.query,
        "op9_decontamination": decontaminate.query,
        "op10_licenses": licenses.query,
    }


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, jaccard, warc

    return {"op1_warc": warc.SQL, "op2_jaccard": jaccard.SQL, "op9_decontamination": decontaminate.SQL}
