"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tarnbeck.llm.chat import op3_chat_formatting
from tarnbeck.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from tarnbeck.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from tarnbeck.llm.licenses import op5_license_scan
from tarnbeck.llm.packing import op6_packing
from tarnbeck.llm.quality import op8_quality_rules
from tarnbeck.llm.sentencepieces import op7_sentencepiece
from tarnbeck.llm.sharding import op9_sharding
from tarnbeck.llm.simhash import op1_simhash_near_dedup
from tarnbeck.llm.spelling import OP12_SQL, op12_spelling_variants
from tarnbeck.llm.token_files import op10_token_files
from tarnbeck.llm.toxicity import op4_toxicity
from tarnbeck.llm.warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_packing": op6_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_token_files": op10_token_files,
    "op11_warc": op11_warc,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op11_warc": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_hard_negatives": OP13_SQL}
