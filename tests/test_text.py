"""Language rules, transcripts, lookups, logs and other text functions."""

import pytest
from pyspark.sql import functions as F

from talkmill.functions import codes, errors, jsonlog, text
from talkmill.functions.language import detect_language, detect_language_simple
from talkmill.functions.stopwords import ENGLISH_STOP_WORDS
from talkmill.functions.transcript import parse_transcript


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


@pytest.mark.parametrize(
    ("written", "language", "confidence"),
    [
        (None, "en", 0.5),
        ("   ", "en", 0.5),
        (" ab ", "en", 0.5),
        ("plant early this season", "en", 0.3),
        ("this is a maize farm", "dag", 0.15),
        ("Wo ho te sɛn", "tw", 0.9),  # ɛ 0.3, words wo, sɛn, phrase: 3 x 0.15, and no farm term
        ("x-ni-x", "ga", 0.3),  # listed twice for one language
        ("ŋŋŋ", "tw", 0.3),
        ("ɖevi ʋu", "ee", 0.6),
        ("bankye mako aburo", "tw", 0.6),
        ("LA BI DI", "dag", 0.45),
        ("yɛ wo na ne aka kasa aboa afuom nsuo kuayɛ", "tw", 1.0),
    ],
)
def test_detect_language(spark, written, language, confidence):
    found = detect_language(rows(spark, [(written,)], "t string"), "t").first()
    expected = {"Wo ho te sɛn": 0.3 + 3 * 0.15}.get(written, confidence)
    assert (found.language, round(found.confidence, 6)) == (language, round(expected, 6))


@pytest.mark.parametrize(
    ("written", "language"),
    [(None, "en"), ("", "en"), ("xyz", "en"), ("ɔ", "tw"), ("Ɔ", "en"), ("wo ne", "tw"), ("mli ke le", "ga"), ("ti", "en")],
)
def test_detect_language_simple(spark, written, language):
    assert detect_language_simple(rows(spark, [(written,)], "t string"), "t").first().language == language


@pytest.mark.parametrize(
    ("reply", "parsed"),
    [
        ("LANGUAGE: tw\nTRANSCRIPTION: me ho ye", ("me ho ye", "tw", None)),
        ("LANGUAGE: Twi (Akan)\nTRANSCRIPTION: a b", ("a b", "tw", None)),
        ("LANGUAGE: ga\nLANGUAGE: ??\nTRANSCRIPTION: one\nTRANSCRIPTION: two", ("two", "ga", None)),
        ("hello there world", ("hello there world", "en", None)),
        ("LANGUAGE: en\nTRANSCRIPTION: TRANSCRIPTION_FAILED", ("", "en", "Could not transcribe audio clearly")),
        ("  \n ", ("", "en", "Could not transcribe audio clearly")),
        (None, ("", "en", "Could not transcribe audio clearly")),
        # no transcription: the whole reply, whose letters hold "la", "n" and "ti"
        ("LANGUAGE: ga\nTRANSCRIPTION:", ("LANGUAGE: ga\nTRANSCRIPTION:", "dag", None)),
    ],
)
def test_parse_transcript(spark, reply, parsed):
    row = parse_transcript(rows(spark, [(reply,)], "reply string")).first()
    assert (row.text, row.language, row.error) == parsed


def test_code_lookups(spark):
    df = rows(spark, [("ak",), ("gaa",), ("fr",), (None,)], "c string").select(
        codes.from_external(F.col("c")).alias("own"), codes.language_name(codes.from_external(F.col("c"))).alias("name"),
        codes.is_supported(F.col("c")).alias("ok"), codes.language_name(F.col("c")).alias("raw"),
    )
    assert [tuple(r) for r in df.collect()] == [
        ("tw", "Twi", False, "Unknown"), ("ga", "Ga", False, "Unknown"), ("en", "English", False, "Unknown"),
        ("en", "English", False, "Unknown"),
    ]


def test_log_lines(spark):
    lines = [
        ('{"timestamp": "t", "level": "INFO", "logger": "l", "message": "m"}',),
        ('{"timestamp": "t", "level": "ERROR", "logger": "l", "message": "m", "exception": "e\\nf", "request_id": "r", "duration_ms": 7}',),
        ("not json",),
        (None,),
    ]
    parsed = jsonlog.parse_logs(rows(spark, lines, "line string")).collect()
    assert [row.malformed for row in parsed] == [False, False, True, True]
    assert (parsed[1].exception, parsed[1].request_id, parsed[1].duration_ms) == ("e\nf", "r", 7)
    assert parsed[0].request_id is None
    back = jsonlog.parse_logs(rows(spark, lines[:1], "line string")).select(
        jsonlog.format_log("level", "message", "request_id").alias("j")
    )
    assert back.first().j == '{"level":"INFO","message":"m"}'


def test_error_rules_in_order(spark):
    cases = [
        ("voice", "ECONNREFUSED", "timeout", "backend_down"), ("voice", None, "timeout of 1ms", "timeout"),
        ("voice", None, "Unsupported audio format", "bad_format"), ("text", None, "Unsupported audio format", "other"),
        ("voice", None, "transcription failed", "not_understood"), ("text", "ETIMEDOUT", None, "timeout"),
        ("text", None, None, "other"),
    ]
    df = rows(spark, cases, "channel string, code string, message string, expected string")
    for row in df.withColumn("c", errors.error_category(F.col("channel"), F.col("code"), F.col("message"))).collect():
        assert row.c == row.expected


def test_small_helpers(spark):
    df = rows(spark, [(" \n  x y\t ", "123@c.us@c.us", 128)], "t string, s string, n long").select(
        text.strip(F.col("t")).alias("t"), text.normalise_sender(F.col("s")).alias("s"), text.kilobytes(F.col("n")).alias("n"),
        text.tokens(F.lit("The maize, the Maize & a x2 ɔyɛ")).alias("tokens"),
        text.display_name(F.lit(""), F.lit(None), F.lit("who")).alias("name"),
    )
    row = df.first()
    assert (row.t, row.s, row.n, row.name) == ("x y", "123@c.us", 0.12, "who")
    assert row.tokens == ["maize", "maize", "x2", "ɔyɛ"]


def test_iso_time(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS a, timestamp_ntz'2024-01-02 03:04:05.0607' AS b, CAST(NULL AS timestamp_ntz) AS c")
    row = df.select(*[text.iso_utc(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(row) == ("2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.060700+00:00", None)


def test_stop_words_are_sparks_default(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_a_source_language_can_be_detected_inside(spark):
    from talkmill.operators.translation import translate_to_english

    memory = spark.createDataFrame([("me pɛ aburo", "tw", "en", "I want maize")], "text string, source_lang string, target_lang string, translated string")
    texts = spark.createDataFrame(
        [(1, "me pɛ aburo", "auto"), (2, "the farm", "auto"), (3, "me pɛ aburo", "tw"), (4, "", "auto"), (5, None, "tw")],
        "id int, text string, source_lang string",
    )
    got = {r.id: (r.source_lang, r.english, r.translation_confidence) for r in translate_to_english(texts, memory, auto=True).collect()}
    assert got[1][:2] == ("tw", "I want maize") and 0 < got[1][2] <= 1
    assert got[2][:2] == ("en", "the farm") and got[2][2] < 1
    assert got[3] == ("tw", "I want maize", 0.8) and got[4] == ("en", "", 0.0) and got[5] == ("en", "", 0.0)


def test_with_a_given_language_the_whole_reply_is_the_text(spark):
    from talkmill.functions.transcript import parse_transcript

    replies = spark.createDataFrame(
        [(1, " LANGUAGE: en\nTRANSCRIPTION: x ", "tw"), (2, "LANGUAGE: ga\nTRANSCRIPTION: y", None), (3, "TRANSCRIPTION_FAILED", "ee")],
        "id int, reply string, wanted string",
    )
    got = {r.id: (r.text, r.language, r.error is None) for r in parse_transcript(replies, given="wanted").collect()}
    assert got == {1: ("LANGUAGE: en\nTRANSCRIPTION: x", "tw", True), 2: ("y", "ga", True), 3: ("", "ee", False)}

