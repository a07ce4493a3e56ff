"""Ordered rules from a request failure to the message the sender sees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# User-visible texts per category.
VOICE_TEXTS = {
    "backend_down": "⚠️ Sorry, I'm having trouble connecting to my brain (backend service is down). Please try again in a moment.",
    "timeout": "⚠️ Sorry, processing your voice message took too long. Please try sending a shorter message or try again.",
    "bad_format": "⚠️ Sorry, I couldn't process that audio format. Please try recording your voice message again.",
    "not_understood": "⚠️ Sorry, I couldn't understand the audio. Please try speaking more clearly or send a text message instead.",
    "other": "⚠️ Sorry, I encountered an error processing your voice message. Please try again or send a text message instead.",
}
TEXT_TEXTS = {
    "backend_down": "⚠️ Sorry, I'm having trouble connecting to my brain (backend service is down). Please try again in a moment.",
    "timeout": "⚠️ Sorry, that took too long to process. Please try asking a simpler question or try again.",
    "other": "⚠️ Sorry, I encountered an error processing your message. Please try again or rephrase your question.",
}


def error_category(channel: Column, code: Column, message: Column) -> Column:
    """Category of a failure; the voice channel knows two more than the text channel."""
    says = lambda part: F.coalesce(F.contains(message, F.lit(part)), F.lit(False))
    code = F.coalesce(code, F.lit(""))
    voice = channel == "voice"
    return (
        F.when(code == "ECONNREFUSED", "backend_down")
        .when((code == "ETIMEDOUT") | says("timeout"), "timeout")
        .when(voice & says("Unsupported audio format"), "bad_format")
        .when(voice & says("transcription failed"), "not_understood")
        .otherwise("other")
    )


def error_text(channel: Column, category: Column) -> Column:
    """The text shown for a category on a channel."""
    shown = F.when(F.lit(False), F.lit(""))
    for key, text in VOICE_TEXTS.items():
        shown = shown.when((channel == "voice") & (category == key), F.lit(text))
    for key, text in TEXT_TEXTS.items():
        shown = shown.when((channel != "voice") & (category == key), F.lit(text))
    return shown
