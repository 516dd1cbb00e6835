"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from sumtrail.llm.binary import op8_token_files
from sumtrail.llm.bottomk import op11_bottom_k
from sumtrail.llm.bpe import op4_bpe
from sumtrail.llm.decontaminate import op5_decontaminate
from sumtrail.llm.fingerprints import op9_fingerprints
from sumtrail.llm.jaccard import op6_jaccard
from sumtrail.llm.langid import op7_language_id
from sumtrail.llm.merkle import op12_merkle
from sumtrail.llm.negatives import op13_negatives
from sumtrail.llm.oracles import ORACLE_SQL
from sumtrail.llm.secrets import op10_secrets
from sumtrail.llm.substrings import op1_substrings
from sumtrail.llm.toxicity import op3_toxicity
from sumtrail.llm.wrappers import op2_main_text

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_main_text": op2_main_text,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard": op6_jaccard,
    "op7_language_id": op7_language_id,
    "op8_token_files": op8_token_files,
    "op9_fingerprints": op9_fingerprints,
    "op10_secrets": op10_secrets,
    "op11_bottom_k": op11_bottom_k,
    "op12_merkle": op12_merkle,
    "op13_negatives": op13_negatives,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
