"""The `opN_` queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op7_decontaminate
from .embedding_join import op1_embeddings
from .html_text import op2_html
from .langid import op10_langid
from .paragraphs import op8_paragraphs
from .piece_model import op4_sentencepiece
from .pii import op6_pii
from .ppm import op3_ppm
from .quality import op9_quality
from .simhash import op5_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embeddings": op1_embeddings,
        "op2_html": op2_html,
        "op3_ppm": op3_ppm,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_simhash": op5_simhash,
        "op6_pii": op6_pii,
        "op7_decontaminate": op7_decontaminate,
        "op8_paragraphs": op8_paragraphs,
        "op9_quality": op9_quality,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {}
