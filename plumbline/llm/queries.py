"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm import collocations, egojoin, langid, licenses, mixing, packing, quality, rpforest, simhash, simple8b, spelling, vafile, wrappers

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_language": langid.op2_language,
    "op3_mixing": mixing.op3_mixing,
    "op4_licenses": licenses.op4_licenses,
    "op5_quality": quality.op5_quality,
    "op6_packing": packing.op6_packing,
    "op7_vafile": vafile.op7_vafile,
    "op8_rpforest": rpforest.op8_rpforest,
    "op9_token_files": simple8b.op9_token_files,
    "op10_wrappers": wrappers.op10_wrappers,
    "op11_spelling": spelling.op11_spelling,
    "op12_egojoin": egojoin.op12_egojoin,
    "op13_collocations": collocations.op13_collocations,
}

SQL: dict[str, str] = {
    "op4_licenses": licenses.SQL,
    "op11_spelling": spelling.SQL,
    "op12_egojoin": egojoin.SQL,
    "op13_collocations": collocations.SQL,
}
