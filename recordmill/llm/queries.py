"""The registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from recordmill.llm import ann, bpe, decontaminate, langid, lexical, pii, quality, simhash, token_counts, toxicity, trie, vectors, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_language": langid.query,
    "op3_warc": warc.query,
    "op4_decontaminate": decontaminate.query,
    "op5_byte_bpe": bpe.query,
    "op6_token_counts": token_counts.query,
    "op7_simhash": simhash.query,
    "op8_top_k": vectors.query,
    "op9_toxicity": toxicity.query,
    "op10_pii": pii.query,
    "op11_prefix_trie": trie.query,
    "op12_neighbours": ann.query,
    "op13_lexical": lexical.query,
}

ORACLES = {"op3_warc": warc.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op8_top_k": vectors.ORACLE, "op11_prefix_trie": trie.ORACLE, "op13_lexical": lexical.ORACLE}
