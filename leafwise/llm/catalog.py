"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, embeddings, merkle, quality, quotes, resample, secrets, simhash, substrings, tokenfiles, toxicity, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_token_files": tokenfiles.op2_token_files,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_secrets": secrets.op4_secrets,
    "op5_urls": urls.op5_urls,
    "op6_quality": quality.op6_quality,
    "op7_substrings": substrings.op7_substrings,
    "op8_quotes": quotes.op8_quotes,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle": merkle.op12_merkle,
    "op13_resample": resample.op13_resample,
}
ORACLES = {"op3_embeddings": embeddings.ORACLE, "op5_urls": urls.ORACLE, "op12_merkle": merkle.ORACLE, "op13_resample": resample.ORACLE}
