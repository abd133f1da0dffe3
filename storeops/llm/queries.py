"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from storeops.llm import bpe, conversation_trie, decontam, exact_dedup, lang_id, minhash, pii, repeats, secret_scan, toxicity, url_filter, warc, whitening

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_warc": warc.op2_warc,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_language_id": lang_id.op9_language_id,
    "op10_repeats": repeats.op10_repeats,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_pii": pii.op12_pii,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_minhash": minhash.ORACLE,
    "op2_warc": warc.ORACLE,
    "op3_secret_scan": secret_scan.ORACLE,
    "op4_decontamination": decontam.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op11_conversation_trie": conversation_trie.ORACLE,
}
