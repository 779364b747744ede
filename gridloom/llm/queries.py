"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from gridloom.llm import gif_media, jaccard_join, language, line_dedup, merkle, mixing, piece_codec, pii, secrets, simhash, topk_search, toxicity, whitening

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_sentencepiece": piece_codec.op2_sentencepiece,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_mixing": mixing.op5_mixing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_gif_media": gif_media.op7_gif_media,
    "op8_language_id": language.op8_language_id,
    "op9_pii": pii.op9_pii,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_simhash": simhash.op11_simhash,
    "op12_merkle": merkle.op12_merkle,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {
    "op1_jaccard_join": jaccard_join.SQL,
    "op3_topk_search": topk_search.SQL,
    "op5_mixing": mixing.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op12_merkle": merkle.SQL,
}
