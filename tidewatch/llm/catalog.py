"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewatch.llm import (
    blocks, bpe, classes, decontaminate, language, lexical, media, packing, prefixes, similar, suffixes, tiers, warc,
)

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_repeats": suffixes.op2_repeats,
    "op3_brown": classes.op3_brown,
    "op4_bpe": bpe.op4_bpe,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language": language.op6_language,
    "op7_blocks": blocks.op7_blocks,
    "op8_similar": similar.op8_similar,
    "op9_packing": packing.op9_packing,
    "op10_mpeg_audio": media.op10_mpeg_audio,
    "op11_peel": prefixes.op11_peel,
    "op12_ranked": lexical.op12_ranked,
    "op13_tiers": tiers.op13_tiers,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op11_peel": prefixes.OP11_SQL,
    "op12_ranked": lexical.OP12_SQL,
}
