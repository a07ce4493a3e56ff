"""From questions to prompts in one plan: detect, translate, retrieve, assemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.language import detect_language
from talkmill.operators.retrieval import SYSTEM_PROMPT, context_text, prompts
from talkmill.operators.tfidf import TfidfModel, search_filled, with_chunks
from talkmill.operators.translation import translate_to_english
from talkmill.session import cut_lineage


def answer_prompts(
    questions: DataFrame, memory: DataFrame, model: TfidfModel, kb: DataFrame, k: int = 8,
    system_prompt: str = SYSTEM_PROMPT,
) -> DataFrame:
    """(query_id, language, prompt): the prompt shows the question as asked,
    retrieval sees its English form."""
    detected = detect_language(questions.where(F.col("query") != ""), "query")
    # read several times below: written once instead of detected and translated again
    english = cut_lineage(translate_to_english(detected, memory, text="query", language="language"))
    asked = english.select("query_id", F.col("english").alias("query"))
    results = search_filled(model, asked, kb, k)
    contexts = context_text(with_chunks(results, kb, k * asked.count()))
    return prompts(english.select("query_id", "query", "language"), contexts, system_prompt)
