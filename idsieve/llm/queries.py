"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .annulus import OP12_SQL, op12_annulus
from .byte_bpe import op13_byte_bpe
from .conversation_repair import op11_conversation_repair
from .decontaminate import op6_decontaminate
from .interpolated_lm import op8_interpolated_lm
from .jpeg_media import op10_jpeg_media
from .license_scan import op5_license_scan
from .ngram_join import op1_ngram_join
from .pieces import op4_pieces
from .surrogates import op3_surrogates
from .token_orc import op7_token_orc
from .toxicity import op9_toxicity
from .warc import OP2_SQL, op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_surrogates": op3_surrogates,
    "op4_pieces": op4_pieces,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_orc": op7_token_orc,
    "op8_interpolated_lm": op8_interpolated_lm,
    "op9_toxicity": op9_toxicity,
    "op10_jpeg_media": op10_jpeg_media,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_annulus": op12_annulus,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op12_annulus": OP12_SQL,
}
