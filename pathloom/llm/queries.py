"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import divergence, extract, forest, infill, jaccard, langid, licences, mixing, packing, pivots, quality, sharding, urls

QUERIES = {
    "op7_temporal_url_list": urls.url_query,
    "op8_licence_scan": licences.licence_query,
    "op3_prefix_forest": forest.nearest_query,
    "op5_pivot_near_duplicates": pivots.near_query,
    "op6_ngram_jaccard": jaccard.jaccard_query,
    "op10_quality_classifier": quality.quality_query,
    "op1_language_id": langid.language_query,
    "op2_hilbert_shards": sharding.shard_query,
    "op4_pack_windows": packing.pack_query,
    "op9_mix_sources": mixing.mix_query,
    "op11_infill_units": infill.infill_query,
    "op12_source_divergence": divergence.divergence_query,
    "op13_min_cut_extract": extract.extract_query,
}

ORACLES: dict[str, str] = {
    "op7_temporal_url_list": urls.URL_SQL,
    "op11_infill_units": infill.INFILL_SQL,
    "op12_source_divergence": divergence.DIVERGENCE_SQL,
}
