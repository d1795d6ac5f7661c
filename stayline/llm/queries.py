"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .exact_dedup import op10_exact_dedup
from .packing import op2_vector_packing
from .phrases import op13_collocations
from .pii import op8_feistel_pseudonyms
from .quality_model import op7_weak_label_quality
from .quality_rules import op4_quality_rules
from .quotes import op9_quote_linking
from .secrets import op6_secret_ledger
from .simhash import op1_simhash_near_dedup
from .sql import ORACLE_SQL
from .suffix_dedup import op12_suffix_dedup
from .toxicity import op3_toxicity_nb_ngrams
from .vector_codes import op11_vector_codes

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_vector_packing,
        op3_toxicity_nb_ngrams,
        op4_quality_rules,
        op5_byte_bpe,
        op6_secret_ledger,
        op7_weak_label_quality,
        op8_feistel_pseudonyms,
        op9_quote_linking,
        op10_exact_dedup,
        op11_vector_codes,
        op12_suffix_dedup,
        op13_collocations,
    )
}
