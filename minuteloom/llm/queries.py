"""Queries of this subpackage, and SQL for those that SQL can say."""

from minuteloom.llm import decontaminate, language, mtree, neighbours, packing, pii, quality, separators, sharding, simhash, timestamps, toxicity, whitening

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_bradley_terry_quality,
        language.op2_rank_order_language,
        packing.op3_harmonic_packing,
        decontaminate.op4_wu_manber_decontamination,
        pii.op5_pii_deobfuscation,
        toxicity.op6_counterfactual_toxicity,
        sharding.op7_bounded_load_ring,
        simhash.op8_simhash_pigeonhole,
        separators.op9_separator_scan,
        neighbours.op10_multiprobe_neighbours,
        mtree.op11_mtree_products,
        timestamps.op12_mixed_timestamps,
        whitening.op13_tsqr_whitening,
    )
}

ORACLES = {"op4_wu_manber_decontamination": decontaminate.OP4_SQL, "op11_mtree_products": mtree.OP11_SQL, "op12_mixed_timestamps": timestamps.OP12_SQL}
