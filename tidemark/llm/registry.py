"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import audio, langid, lm, mixing, neardup, pii, quality, substring, subword, tokenfile

QUERIES = {
    "op7_language_model": lm.op7_language_model,
    "op8_minhash": neardup.op8_minhash,
    "op1_substring": substring.op1_substring,
    "op6_language": langid.op6_language,
    "op2_pii": pii.op2_pii,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_tokenfile": tokenfile.op5_tokenfile,
    "op9_sentencepiece": subword.op9_sentencepiece,
    "op10_audio": audio.op10_audio,
}

ORACLE_SQL = {
    "op3_quality": quality.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
}
