"""Registered queries of the training-data operators."""

from connlens.llm import jaccard, language, licenses, merkle, neighbours, packing, pieces, quality, resampling, secrets, surrogates, token_files, topk
from connlens.session import shipped

_RUN = {
    "op1_secrets": secrets.op1_secrets,
    "op2_packing": packing.op2_packing,
    "op3_topk": topk.op3_topk,
    "op4_language": language.op4_language,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality": quality.op7_quality,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_surrogates": surrogates.op9_surrogates,
    "op10_pieces": pieces.op10_pieces,
    "op11_frames": token_files.op11_frames,
    "op12_merkle": merkle.op12_merkle,
    "op13_resampling": resampling.op13_resampling,
}
QUERIES = {name: shipped(run) for name, run in _RUN.items()}
ORACLES = {"op1_secrets": secrets.SQL, "op3_topk": topk.SQL, "op6_licenses": licenses.SQL, "op8_jaccard": jaccard.SQL, "op12_merkle": merkle.SQL, "op13_resampling": resampling.SQL}
