"""The corpus operators' queries and the SQL that some of them can be compared with."""

from __future__ import annotations

from . import audio, contexts, language, lines, mixing, neardup, outliers, packing, quality, warc

QUERIES = {
    "op1_ctw": contexts.op1_ctw,
    "op2_lines": lines.op2_lines,
    "op3_warc": warc.op3_warc,
    "op4_pack": packing.op4_pack,
    "op5_neardup": neardup.op5_neardup,
    "op6_audio": audio.op6_audio,
    "op7_mix": mixing.op7_mix,
    "op8_language": language.op8_language,
    "op9_quality": quality.op9_quality,
    "op10_outliers": outliers.op10_outliers,
}

ORACLES = {
    "op3_warc": warc.SQL,
    "op2_lines": lines.SQL,
    "op7_mix": mixing.SQL,
}
