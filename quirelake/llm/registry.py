"""The queries of this folder's operators, by name, and their DuckDB SQL where it can express them."""

from quirelake.llm import chat, decontaminate, language_id, line_crf, line_dedup, merkle, mixing, multi_index, packing, phrases, quality_rules, simhash, warc

QUERIES = {
    "op5_warc": warc.op5_warc,
    "op6_chat": chat.op6_chat,
    "op7_line_crf": line_crf.op7_line_crf,
    "op9_multi_index": multi_index.op9_multi_index,
    "op10_language_id": language_id.op10_language_id,
    "op8_packing": packing.op8_packing,
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op11_phrases": phrases.op11_phrases,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op5_warc": warc.OP5_SQL,
    "op6_chat": chat.OP6_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_decontaminate": decontaminate.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
