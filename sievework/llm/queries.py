"""Queries of the training-data operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op12_tokenizer_alignment
from .chat import ORACLE_SQL as CHAT_SQL
from .chat import op2_chat_formatting
from .embeddings import ORACLE_SQL as EMBEDDINGS_SQL
from .embeddings import op6_embedding_near_dedup
from .hmm import op1_lm_scoring
from .langid import op9_language_id
from .media import op3_media_columns
from .packing import op10_best_fit_packing
from .pieces import op7_sentencepiece
from .quality import op5_quality_classifier
from .simhash import op8_simhash_near_dedup
from .toxicity import op13_toxicity
from .trie import ORACLE_SQL as TRIE_SQL
from .trie import op11_conversation_trie
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_media_columns": op3_media_columns,
        "op4_warc": op4_warc,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_language_id": op9_language_id,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_tokenizer_alignment": op12_tokenizer_alignment,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": CHAT_SQL, "op4_warc": WARC_SQL, "op6_embedding_near_dedup": EMBEDDINGS_SQL, "op11_conversation_trie": TRIE_SQL}
