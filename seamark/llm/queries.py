"""The queries of this package, as __spark_entry__.py registers them."""

from __future__ import annotations

from seamark.llm.decontamination import OP2_SQL, op2_decontamination
from seamark.llm.fingerprints import op3_fingerprints
from seamark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from seamark.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from seamark.llm.language_id import op1_language_id
from seamark.llm.lexical_search import OP13_SQL, op13_lexical_search
from seamark.llm.pieces import op9_pieces
from seamark.llm.pii import op4_pii
from seamark.llm.quality import op5_quality
from seamark.llm.repeats import op10_repeats
from seamark.llm.secrets import op6_secrets
from seamark.llm.sharding import op12_shards
from seamark.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_fingerprints": op3_fingerprints,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_pieces": op9_pieces,
    "op10_repeats": op10_repeats,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_shards": op12_shards,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_lexical_search": OP13_SQL,
}
