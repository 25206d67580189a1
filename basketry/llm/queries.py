"""The queries opN_<name>, each over the whole of its table, and the SQL of those that SQL can express."""

from . import decontam, digest, fingerprint_index, jaccard, langid, lloyd, packing, pii, run_length_index, sharding, sorted_passes, spelling, url_filter

QUERIES = {
    "op1_substring_index": run_length_index.op1,
    "op2_decontamination": decontam.op2,
    "op3_packing": packing.op3,
    "op4_language_id": langid.op4,
    "op5_url_filter": url_filter.op5,
    "op6_jaccard_join": jaccard.op6,
    "op7_fingerprints": digest.op7,
    "op8_substring_dedup": fingerprint_index.op8,
    "op9_pii": pii.op9,
    "op10_sharding": sharding.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_embedding_near_dedup": sorted_passes.op12,
    "op13_centroid_clustering": lloyd.op13,
}
ORACLES = {
    "op2_decontamination": decontam.OP2_SQL,
    "op8_substring_dedup": fingerprint_index.OP8_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_embedding_near_dedup": sorted_passes.OP12_SQL,
    "op13_centroid_clustering": lloyd.OP13_SQL,
}
