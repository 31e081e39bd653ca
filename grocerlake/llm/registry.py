"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from . import centroids, decontamination, html_text, language_id, licenses, media, merkle, minhash, mixing, ngram_jaccard, quality, sharding, token_binary

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_language_id": language_id.op4_language_id,
    "op5_token_binary": token_binary.op5_token_binary,
    "op6_decontaminate": decontamination.op6_decontaminate,
    "op7_main_text": html_text.op7_main_text,
    "op8_shard": sharding.op8_shard,
    "op9_media_chunks": media.op9_media_chunks,
    "op10_quality": quality.op10_quality,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_minhash_dedup": minhash.op13_minhash_dedup,
}

ORACLES = {
    "op2_ngram_jaccard": ngram_jaccard.OP2_SQL,
    "op3_source_mix": mixing.OP3_SQL,
    "op6_decontaminate": decontamination.OP6_SQL,
    "op8_shard": sharding.OP8_SQL,
    "op11_centroid_clusters": centroids.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_minhash_dedup": minhash.OP13_SQL,
}
