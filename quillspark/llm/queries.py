"""The queries of this subpackage."""

from . import bpe, chroma, collocations, dart_minhash, decontaminate, hard_negatives, language_id, ngram_trie, packing, sanitise, token_store, toxicity, wrapper

QUERIES = {
    "op1_chroma": chroma.query,
    "op2_toxicity": toxicity.query,
    "op5_ngram_trie": ngram_trie.query,
    "op3_wrapper": wrapper.query,
    "op7_bpe": bpe.query,
    "op8_token_store": token_store.query,
    "op9_sanitise": sanitise.query,
    "op4_decontaminate": decontaminate.query,
    "op6_dart_minhash": dart_minhash.query,
    "op10_language_id": language_id.query,
    "op11_packing": packing.query,
    "op12_collocations": collocations.query,
    "op13_hard_negatives": hard_negatives.query,
    "op1_classes": chroma.query_classes,
}
#: The others have no SQL form; tests/llm holds them to brute force, exact round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op12_collocations": collocations.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
