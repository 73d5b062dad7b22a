"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, fingerprints, language, licenses, lines, mixing, near_duplicates, phrases, ranking, secrets, sharding, substrings, tries

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_substrings": substrings.op2_substrings,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_licenses": licenses.op5_licenses,
    "op6_phrases": phrases.op6_phrases,
    "op7_language": language.op7_language,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_secrets": secrets.op9_secrets,
    "op10_near_duplicates": near_duplicates.op10_near_duplicates,
    "op11_lines": lines.op11_lines,
    "op12_prefix_trie": tries.op12_prefix_trie,
    "op13_ranking": ranking.op13_ranking,
}

ORACLE_SQL = {
    "op3_decontamination": decontamination.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_phrases": phrases.ORACLE,
    "op10_near_duplicates": near_duplicates.ORACLE,
    "op11_lines": lines.ORACLE,
    "op12_prefix_trie": tries.ORACLE,
    "op13_ranking": ranking.ORACLE,
}
