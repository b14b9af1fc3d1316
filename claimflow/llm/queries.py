"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from claimflow.llm.collocations import OP12_SQL, op12_phrase_collocations
from claimflow.llm.decontamination import op1_decontamination
from claimflow.llm.jaccard_join import OP9_SQL, op9_jaccard_join
from claimflow.llm.language import op8_language_id
from claimflow.llm.licenses import OP7_SQL, op7_license_scan
from claimflow.llm.line_dedup import OP3_SQL, op3_line_dedup
from claimflow.llm.packing import op5_best_fit_packing
from claimflow.llm.prefix_trie import OP13_SQL, op13_conversation_trie
from claimflow.llm.quality_classifier import op4_quality_classifier
from claimflow.llm.quality_rules import op2_quality_rules
from claimflow.llm.sharding import op10_sharding
from claimflow.llm.simhash_dedup import op11_simhash_near_dedup
from claimflow.llm.substring_dedup import OP6_SQL, op6_substring_dedup

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_sharding": op10_sharding,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_trie": op13_conversation_trie,
}

SQL = {"op9_jaccard_join": OP9_SQL, "op6_substring_dedup": OP6_SQL, "op3_line_dedup": OP3_SQL, "op7_license_scan": OP7_SQL, "op12_phrase_collocations": OP12_SQL, "op13_conversation_trie": OP13_SQL}
