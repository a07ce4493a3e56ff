"""One SQL statement per query of the catalog."""

from __future__ import annotations

from oracles.views import with_views
from talkmill.functions import codes, errors, language, transcript
from talkmill.functions.stopwords import ENGLISH_STOP_WORDS
from talkmill.operators import messages as inbound_ops
from talkmill.operators.retrieval import SYSTEM_PROMPT


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(value) for value in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_text(value) for value in values) + ")"


def _map(mapping: dict[str, str], key: str, default: str) -> str:
    cases = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in mapping.items())
    return f"CASE {key} {cases} ELSE {default} END"


NL = "chr(10)"
STRIPPED = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip(expression: str) -> str:
    return STRIPPED.format(expression)


def iso(ts: str) -> str:
    return (
        f"CASE WHEN {ts} IS NOT NULL THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN microsecond({ts}) % 1000000 = 0 THEN '' ELSE strftime({ts}, '.%f') END || '+00:00' END"
    )


# Language identification: (source query with id, lowered text) -> id, language, confidence

def lexicon_cte(source: str) -> str:
    """CTEs ending in ``detected(id, language, confidence)`` for ``source(id, text)``."""
    words = r"list_distinct(regexp_extract_all(lowered, '[\p{L}\p{N}_]+'))"
    scores = []
    for code in language.LETTERS:
        letters = " + ".join(f"contains(lowered, {_text(letter)})::INT" for letter in language.LETTERS[code])

        def hits(entries):
            parts = []
            for entry in entries:
                if " " in entry:
                    parts.append(
                        rf"regexp_matches(lowered, '(^|[^\p{{L}}\p{{N}}_]){entry}($|[^\p{{L}}\p{{N}}_])')::INT"
                    )
                else:
                    parts.append(f"list_contains(words, {_text(entry)})::INT")
            return " + ".join(parts)

        score = f"({letters})::DOUBLE * 0.3::DOUBLE + ({hits(language.COMMON_WORDS[code])})::DOUBLE * 0.15::DOUBLE"
        if code in language.FARM_TERMS:
            score += f" + ({hits(language.FARM_TERMS[code])})::DOUBLE * 0.2::DOUBLE"
        scores.append(f"least({score}, 1.0::DOUBLE) AS s_{code}")
    best = "greatest(s_tw, s_ga, s_ee, s_dag)"
    return f"""
    lowered AS (SELECT id, {strip("lower(coalesce(text, ''))")} AS lowered FROM ({source})),
    worded AS (SELECT id, lowered, {words} AS words FROM lowered),
    scored AS (SELECT id, lowered, {", ".join(scores)} FROM worded),
    detected AS (
        SELECT id,
               CASE WHEN length(lowered) < 3 OR {best} <= 0.1 THEN 'en' WHEN s_tw = {best} THEN 'tw'
                    WHEN s_ga = {best} THEN 'ga' WHEN s_ee = {best} THEN 'ee' ELSE 'dag' END AS language,
               CASE WHEN length(lowered) < 3 THEN 0.5::DOUBLE WHEN {best} <= 0.1 THEN 0.3::DOUBLE
                    ELSE {best} END AS confidence
        FROM scored)
    """


def simple_language(text: str) -> str:
    """CASE expression of the simple rule."""
    counts = {
        code: "(" + " + ".join(f"contains(lower({text}), {_text(word)})::INT" for word in words) + ")"
        for code, words in language.SIMPLE_WORDS.items()
    }
    best = f"greatest({', '.join(counts.values())})"
    letters = " OR ".join(f"contains({text}, {_text(letter)})" for letter in language.SIMPLE_TWI_LETTERS)
    cases = " ".join(f"WHEN {count} = {best} THEN {_text(code)}" for code, count in counts.items())
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN 'en' WHEN {letters} THEN 'tw' WHEN {best} < 2 THEN 'en' {cases} END"


# Keyword retrieval

def _terms(key: str, text: str, source: str) -> str:
    return rf"""
        SELECT {key}, term, count(*) AS tf
        FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {source})
        WHERE term NOT IN {_in(ENGLISH_STOP_WORDS)}
        GROUP BY {key}, term
    """


TFIDF = f"""
    tf AS ({_terms("doc_id", "text", "documents")}),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term),
    raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
    doc_weights AS (
        SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)
"""


def keyword_ctes(source: str = "(SELECT item_id AS query_id, text AS query FROM benchmark)", k: int = 8) -> str:
    """CTEs ending in ``keyword_scores`` and ``keyword`` (query_id, doc_id, score, rank)."""
    return f"""{TFIDF},
    qtf AS ({_terms("query_id", "query", f"(SELECT * FROM {source} WHERE query <> '')")}),
    qraw AS (SELECT query_id, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
    query_weights AS (
        SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qraw),
    keyword_scores AS (
        SELECT query_id, doc_id, round(sum(d.weight * q.weight), 6) AS score
        FROM doc_weights d JOIN query_weights q USING (term) GROUP BY query_id, doc_id),
    keyword AS (
        SELECT * FROM (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC))::INTEGER AS rank FROM keyword_scores)
        WHERE rank <= {k}),
    filled AS (
        SELECT * FROM (
            SELECT query_id, doc_id, coalesce(score, 0.0) AS score,
                   (row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, doc_id DESC))::INTEGER AS rank
            FROM (SELECT query_id, doc_id FROM {source} CROSS JOIN documents WHERE query <> '')
            LEFT JOIN keyword_scores USING (query_id, doc_id))
        WHERE rank <= 8)
    """


# Vector retrieval

def semantic_cte(k: int, same_user: bool = False) -> str:
    """CTE ``semantic`` (query_id, id, distance, rank)."""
    return f"""
    question_vectors AS (
        SELECT item_id AS query_id, embedding::DOUBLE[] AS qv, label AS wanted
        FROM benchmark JOIN embeddings ON item_id = vec_id),
    semantic AS (
        SELECT * FROM (
            SELECT query_id, id, label, wanted, distance,
                   (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INTEGER AS rank
            FROM (SELECT query_id, vec_id AS id, label, wanted,
                         round(list_cosine_distance(embedding::DOUBLE[], qv), 6) AS distance
                  FROM embeddings CROSS JOIN question_vectors {"WHERE label = wanted" if same_user else ""}))
        WHERE rank <= {k})
    """


def fused_ctes(k: int) -> str:
    """CTEs ending in ``fused`` (query_id, doc_id, keyword_rank, semantic_rank, score, rank) of two lists of k."""
    return f"""{keyword_ctes(k=k)}, {semantic_cte(k)},
    shares AS (
        SELECT query_id, doc_id, k.rank AS keyword_rank, s.rank AS semantic_rank,
               round(coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 6) AS score
        FROM keyword k FULL JOIN (SELECT query_id, id AS doc_id, rank FROM semantic) s USING (query_id, doc_id)),
    fused AS (
        SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC))::INTEGER AS rank FROM shares)
    """


SEMANTIC_COLUMNS = "query_id, rank, id, distance, round(1.0::DOUBLE - distance, 6) AS similarity"

MEMORY = """
    memory AS (
        SELECT text, lang AS source_lang, min('[translated] ' || text) AS translated
        FROM benchmark, (SELECT unnest(['tw', 'ga', 'ee', 'dag']) AS lang)
        WHERE item_id IN (SELECT doc_id FROM labels) GROUP BY text, lang),
    translated AS (
        SELECT b.item_id AS query_id, b.text AS query,
               CASE WHEN b.text = '' THEN 'en' ELSE d.language END AS language,
               CASE WHEN d.language <> 'en' AND m.translated IS NOT NULL THEN m.translated ELSE b.text END AS english,
               CASE WHEN b.text = '' THEN 0.0 WHEN d.language = 'en' THEN 1.0
                    WHEN m.translated IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS translation_confidence
        FROM benchmark b JOIN detected d ON d.id = b.item_id
        LEFT JOIN memory m ON m.text = b.text AND m.source_lang = d.language)
"""
QUESTION_LANGUAGES = lexicon_cte("SELECT item_id AS id, text FROM benchmark")

_chunks = "JOIN documents USING (doc_id)"
_context = f"string_agg('[source: ' || source || '] ' || text, {NL} || {NL} ORDER BY rank)"

_prompt = " || ".join(
    [
        _text(SYSTEM_PROMPT), NL, NL,
        _map(codes.LANGUAGE_INSTRUCTIONS, "language", _text(codes.LANGUAGE_INSTRUCTIONS["en"])), NL, NL,
        "'Question (may be in '", _map(codes.LANGUAGE_NAMES, "language", "'English'"), "'): '", "query", NL, NL,
        "'Context:'", NL, "coalesce(context, '')", NL, NL,
        "'Provide a practical and accurate answer in '", _map(codes.LANGUAGE_NAMES, "language", "'English'"),
        "', using simple language that farmers can understand. Keep the response under 180 tokens.'",
    ]
)

_active = """
    count(DISTINCT u.id) AS total_users,
    count(DISTINCT CASE WHEN u.last_active_at > now - INTERVAL 24 HOUR THEN u.id END) AS active_last_24h,
    count(DISTINCT CASE WHEN u.last_active_at > now - INTERVAL 7 DAY THEN u.id END) AS active_last_7d,
    count(DISTINCT CASE WHEN u.last_active_at > now - INTERVAL 30 DAY THEN u.id END) AS active_last_30d,
"""

_user_dict = f"""
    id::VARCHAR AS id, phone_number, name, preferred_language, location, farm_size, array_to_string(crops, ',') AS crops,
    {iso("created_at")} AS created_at, {iso("last_active_at")} AS last_active_at, is_active
"""

def normalised(expression: str) -> str:
    return rf"lower(regexp_replace({strip(expression)}, '[\s\p{{Z}}]+', ' ', 'g'))"


_users_from_log = """
    summary AS (
        SELECT phone_number,
               (SELECT name FROM message_log i WHERE i.event_id = first(l.event_id ORDER BY l.ts, l.event_id)) AS first_name,
               min(ts) AS first_seen, max(ts) AS last_seen,
               last(language ORDER BY ts, event_id) FILTER (language IS NOT NULL) AS last_language
        FROM message_log l GROUP BY phone_number),
    upserted AS (
        SELECT phone_number, u.id IS NULL AS is_new,
               CASE WHEN u.id IS NULL THEN first_name ELSE u.name END AS name,
               CASE WHEN u.id IS NULL THEN coalesce(last_language, 'en') ELSE u.preferred_language END AS preferred_language,
               CASE WHEN u.id IS NULL THEN first_seen ELSE u.created_at END AS created_at,
               CASE WHEN first_seen IS NULL THEN u.updated_at ELSE now END AS updated_at,
               CASE WHEN first_seen IS NULL THEN u.last_active_at ELSE last_seen END AS last_active_at
        FROM users u FULL JOIN summary USING (phone_number) CROSS JOIN as_of)
"""

_transcript_code = "CASE WHEN p IN {codes} THEN p {contains} END".format(
    codes=_in(codes.LANGUAGE_NAMES_LONG),
    contains=" ".join(f"WHEN contains(p, {_text(code)}) THEN {_text(code)}" for code in codes.LANGUAGE_NAMES_LONG),
)

_voice_types = _in(inbound_ops.AUDIO_TYPES)


def _statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    # Knowledge base
    sql["kb_scan_csv"] = "SELECT text AS question, text AS answer, source FROM documents"
    sql["kb_missing_file"] = "SELECT source, count(*) AS entries FROM documents GROUP BY source"
    sql["kb_snapshot"] = "SELECT doc_id AS id, text AS question, source FROM documents"
    sql["append_messages"] = """
        SELECT 'text' AS message_type, language, '{}' AS metadata, count(*) AS messages
        FROM events, (SELECT unnest(['en', 'tw']) AS language) GROUP BY language
    """
    sql["kb_normalize"] = (
        "SELECT doc_id AS id, text AS question, text AS answer, 'csv:knowledge_base' AS source FROM documents"
    )
    sql["kb_append"] = """
        SELECT source, count(*) AS entries, sum(length(question))::BIGINT AS question_chars,
               sum(length(answer))::BIGINT AS answer_chars
        FROM (SELECT text AS question, text AS answer, source FROM documents
              UNION ALL
              SELECT q.text, a.text, 'conversation' FROM conversations q JOIN conversations a
              ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant')
        GROUP BY source
    """
    sql["kb_batches"] = """
        SELECT (rn - 1) // 20 + 1 AS batch_no, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id
        FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1
    """
    sql["kb_target"] = "SELECT count(*) AS total, count(*) >= 250 AS reached FROM documents"
    sql["kb_dedup"] = f"""
        SELECT doc_id AS id, text AS question, source FROM (
            SELECT *, row_number() OVER (PARTITION BY {normalised("text")} ORDER BY doc_id) AS rn FROM documents)
        WHERE rn = 1
    """
    sql["kb_damaged"] = r"""
        SELECT doc_id AS id, question, len(regexp_extract_all(question, '\p{L}\?\p{L}'))::BIGINT AS damaged_places
        FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS question FROM documents)
        WHERE regexp_matches(question, '\p{L}\?\p{L}')
    """
    sql["kb_snapshot_diff"] = """
        WITH older AS (SELECT text FROM documents),
             newer AS (SELECT text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
                       UNION ALL SELECT text FROM benchmark)
        SELECT 'added' AS change, text AS question, count(*) AS copies
        FROM (SELECT text FROM newer EXCEPT ALL SELECT text FROM older) GROUP BY text
        UNION ALL
        SELECT 'removed', text, count(*) FROM (SELECT text FROM older EXCEPT ALL SELECT text FROM newer) GROUP BY text
    """

    # Users, conversations, messages
    sql["users_page"] = with_views(f"SELECT {_user_dict} FROM users ORDER BY users.id LIMIT 10 OFFSET 20", "users")
    sql["user_by_phone"] = with_views(
        f"SELECT {_user_dict} FROM users WHERE phone_number = '+000000042' LIMIT 1", "users"
    )
    sql["message_dicts"] = with_views(
        f"""SELECT id::VARCHAR AS id, conversation_id::VARCHAR AS conversation_id, user_id::VARCHAR AS user_id,
                   message_type, direction, content, transcribed_text, language, {iso("created_at")} AS created_at
            FROM messages""",
        "messages",
    )
    sql["conversation_dicts"] = with_views(
        f"""SELECT id::VARCHAR AS id, user_id::VARCHAR AS user_id, {iso("started_at")} AS started_at,
                   NULL::VARCHAR AS ended_at, message_count, is_active FROM convs""",
        "convs",
    )
    history_columns = (
        "id, conversation_id, user_id, message_type, direction, content, transcribed_text, language, created_at"
    )
    sql["history_one"] = with_views(
        f"""SELECT {history_columns} FROM messages
            WHERE user_id = (SELECT id FROM users WHERE phone_number = '+000000042' LIMIT 1)
            ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 20""",
        "messages", "users",
    )
    sql["history_all"] = with_views(
        f"""SELECT {history_columns}, rank FROM (
                SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id DESC))::INTEGER AS rank
                FROM messages) WHERE rank <= 10""",
        "messages",
    )
    last = """
        SELECT c.id AS conversation_id, c.user_id, c.started_at, c.message_count, m.content AS last_message,
               m.created_at AS last_message_at {extra}
        FROM {source} c LEFT JOIN (
            SELECT * FROM (SELECT *, row_number() OVER (
                PARTITION BY conversation_id ORDER BY created_at DESC NULLS FIRST, id DESC) AS rn FROM messages) WHERE rn = 1
        ) m ON m.conversation_id = c.id
    """
    sql["last_message"] = with_views(last.format(source="convs", extra=""), "convs")
    sql["recent_conversations"] = with_views(
        last.format(
            source="""(SELECT * FROM (SELECT *, (row_number() OVER (
                PARTITION BY user_id ORDER BY started_at DESC NULLS FIRST, id DESC))::INTEGER AS rank FROM convs) WHERE rank <= 10)""",
            extra=", c.rank",
        ),
        "convs",
    )
    recent = """SELECT c.id AS conversation_id, c.user_id, c.started_at, c.message_count, m.content AS last_message,
                       m.created_at AS last_message_at
                FROM (SELECT *, row_number() OVER (
                          PARTITION BY user_id ORDER BY started_at DESC NULLS FIRST, id DESC) AS place FROM convs) c
                LEFT JOIN LATERAL (SELECT content, created_at FROM messages WHERE conversation_id = c.id
                                   ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 1) m ON TRUE
                WHERE place <= 2"""
    sql["sql_recent_conversations"] = with_views(f"SELECT * EXCLUDE (user_id) FROM ({recent}) WHERE user_id = 42", "convs")
    sql["sql_recent_of_all"] = with_views(
        f"SELECT u.id AS user_id, r.* EXCLUDE (user_id) FROM users u LEFT JOIN ({recent}) r ON r.user_id = u.id", "users", "convs"
    )
    sql["sql_similar_messages"] = with_views(
        """SELECT scope, message_id, content, round(1.0::DOUBLE - distance, 6) AS similarity
           FROM (
               SELECT scope, id AS message_id, content, distance,
                      row_number() OVER (PARTITION BY scope ORDER BY distance, id) AS place
               FROM (SELECT id, content, user_id, round(list_cosine_distance(embedding::DOUBLE[],
                            (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS distance
                     FROM messages JOIN embeddings ON id = vec_id),
                    (VALUES ('all'), ('one user')) s(scope)
               WHERE scope = 'all' OR user_id = 42)
           WHERE place <= 6""",
        "messages",
    )
    sql["user_nested"] = with_views(
        """SELECT u.id AS user_id,
                  (SELECT count(*) FROM convs c WHERE c.user_id = u.id) AS conversations,
                  (SELECT count(*) FROM messages m WHERE m.user_id = u.id) AS messages,
                  (SELECT count(*) FROM sessions s WHERE s.user_id = u.id) AS sessions,
                  EXISTS (SELECT 1 FROM prefs p WHERE p.user_id = u.id) AS has_preferences
           FROM users u""",
        "users", "convs", "sessions", "prefs",
    )
    sql["cascade_delete"] = with_views(
        """, gone AS (SELECT id FROM users WHERE location = 'FRANCE')
           SELECT 'users' AS table_name, count(*) AS rows_left FROM users WHERE id NOT IN (SELECT id FROM gone)
           UNION ALL SELECT 'conversations', count(*) FROM convs WHERE user_id NOT IN (SELECT id FROM gone)
           UNION ALL SELECT 'messages', count(*) FROM messages WHERE user_id NOT IN (SELECT id FROM gone)
           UNION ALL SELECT 'sessions', count(*) FROM session_rows WHERE user_id NOT IN (SELECT id FROM gone)
           UNION ALL SELECT 'analytics', count(*) FROM events WHERE user_id NOT IN (SELECT id FROM gone)
           UNION ALL SELECT 'preferences', count(*) FROM prefs WHERE user_id NOT IN (SELECT id FROM gone)""",
        "users", "convs", "prefs", "session_rows",
    )
    sql["session_dicts"] = with_views(
        f"""SELECT id::VARCHAR AS id, user_id::VARCHAR AS user_id, conversation_id::VARCHAR AS conversation_id,
                   {iso("started_at")} AS started_at, {iso("last_activity_at")} AS last_activity_at, is_active
            FROM session_rows""",
        "session_rows",
    )
    sql["analytics_dicts"] = f"""
        SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user_id, event_type, props AS event_data, {iso("ts")} AS created_at
        FROM events
    """
    sql["insert_if_absent"] = with_views(
        """SELECT phone_number, name, preferred_language FROM users
           UNION ALL
           SELECT phone_number, name, preferred_language FROM (
               SELECT *, row_number() OVER (PARTITION BY phone_number ORDER BY id) AS rn FROM signups)
           WHERE rn = 1 AND phone_number NOT IN (SELECT phone_number FROM users)""",
        "users", "signups",
    )

    # Statistics
    sql["user_stats"] = with_views(
        """SELECT *, total_messages - voice_messages AS text_messages FROM (
               SELECT u.id AS user_id, u.phone_number, u.created_at AS member_since, u.last_active_at AS last_active,
                      (SELECT count(*) FROM convs c WHERE c.user_id = u.id) AS total_conversations,
                      (SELECT count(*) FROM messages m WHERE m.user_id = u.id AND direction = 'incoming') AS total_messages,
                      (SELECT count(*) FROM messages m WHERE m.user_id = u.id AND message_type = 'voice') AS voice_messages,
                      u.preferred_language
               FROM users u)""",
        "users", "convs",
    )
    sql["overall_stats"] = with_views(
        """SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM messages) AS total_messages,
                  (SELECT count(*) FROM convs) AS total_conversations,
                  (SELECT count(*) FROM messages WHERE message_type = 'voice') AS voice_messages,
                  (SELECT count(*) FROM messages WHERE message_type = 'text') AS text_messages""",
        "users", "convs",
    )
    sql["active_user_stats"] = with_views(
        f"""SELECT {_active} count(DISTINCT c.id) AS total_conversations, count(m.id) AS total_messages,
                   count(CASE WHEN m.message_type = 'voice' THEN 1 END) AS voice_messages,
                   count(CASE WHEN m.message_type = 'text' THEN 1 END) AS text_messages
            FROM users u LEFT JOIN convs c ON u.id = c.user_id LEFT JOIN messages m ON u.id = m.user_id CROSS JOIN as_of
            WHERE u.phone_number <> 'system'""",
        "users", "convs", "as_of",
    )
    sql["sql_active_user_stats"] = sql["active_user_stats"]
    sql["active_user_stats_true"] = with_views(
        f"""SELECT {_active} count(DISTINCT c.id) AS total_conversations, count(DISTINCT m.id) AS total_messages,
                   count(DISTINCT CASE WHEN m.message_type = 'voice' THEN m.id END) AS voice_messages,
                   count(DISTINCT CASE WHEN m.message_type = 'text' THEN m.id END) AS text_messages
            FROM users u LEFT JOIN convs c ON u.id = c.user_id LEFT JOIN messages m ON u.id = m.user_id CROSS JOIN as_of
            WHERE u.phone_number <> 'system'""",
        "users", "convs", "as_of",
    )
    sql["language_dist"] = with_views("SELECT language, count(*) AS messages FROM messages GROUP BY language", "messages")
    sql["type_direction"] = with_views(
        "SELECT message_type, direction, count(*) AS messages FROM messages GROUP BY ALL", "messages"
    )
    sql["conv_message_count"] = with_views(
        "SELECT conversation_id, count(*) AS message_count FROM messages GROUP BY conversation_id", "messages"
    )
    sql["conv_count_drift"] = with_views(
        """SELECT c.id AS conversation_id, c.message_count AS stored_count, a.n AS actual_count
           FROM convs c JOIN (SELECT conversation_id, count(*) AS n FROM messages GROUP BY conversation_id) a
             ON a.conversation_id = c.id WHERE c.message_count <> a.n""",
        "convs",
    )
    sql["export_summary"] = """
        SELECT user_id::INTEGER AS user_id, event_type, count(*)::INTEGER AS events FROM events GROUP BY user_id, event_type
    """
    sql["event_counts"] = "SELECT user_id, event_type, count(*) AS events FROM events GROUP BY user_id, event_type"
    sql["messages_per_period"] = """
        SELECT grain, strftime(date_trunc(grain, ts), '%Y-%m-%d') AS period, count(*) AS messages
        FROM events, (SELECT unnest(['day', 'week', 'month']) AS grain) GROUP BY ALL
    """
    sql["top_questions"] = f"""
        SELECT {normalised("text")} AS question, count(*) AS times_asked FROM documents GROUP BY 1
        ORDER BY times_asked DESC, question LIMIT 20
    """
    sql["latency_stats"] = with_views(
        """SELECT stage, count(*) AS requests, round(avg(ms), 6) AS avg_ms, quantile_cont(ms, 0.5)::DOUBLE AS p50_ms,
                  round(quantile_cont(ms, 0.95)::DOUBLE, 6) AS p95_ms, max(ms) AS max_ms
           FROM (SELECT 'asr' AS stage, asr AS ms FROM timings WHERE voice
                 UNION ALL SELECT 'rag', rag FROM timings UNION ALL SELECT 'llm', llm FROM timings
                 UNION ALL SELECT 'total', rag + llm + coalesce(asr, 0) FROM timings)
           GROUP BY stage""",
        "timings",
    )
    sql["popular_terms"] = rf"""
        WITH dictionary AS (SELECT DISTINCT term FROM ({_terms("item_id", "text", "benchmark")}))
        SELECT term, count(*) AS messages FROM ({_terms("conv_id, turn", "text", "conversations")})
        WHERE term IN (SELECT term FROM dictionary) GROUP BY term
    """
    sql["popular_crops"] = with_views(
        "SELECT crop, count(*) AS users FROM (SELECT unnest(crops) AS crop FROM users) GROUP BY crop", "users"
    )
    five = "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01')"
    sql["activity_5min"] = f"""
        SELECT {five} AS window_start, count(*) AS messages, count(DISTINCT user_id) AS active_senders
        FROM events GROUP BY 1
    """
    sliding = """
        SELECT date_trunc('hour', ts) - to_hours(h) AS window_start, count(DISTINCT user_id) AS active_users
        FROM events, (SELECT unnest(range(24)) AS h) GROUP BY 1
    """
    sql["active_sliding"] = sliding
    sql["active_sliding_all"] = """
        SELECT width, date_trunc('hour', ts) - to_hours(h) AS window_start, count(DISTINCT user_id) AS active_users
        FROM events, (SELECT width, unnest(range(n)) AS h
                      FROM (VALUES ('24 hours', 24), ('7 days', 168), ('30 days', 720)) w(width, n))
        GROUP BY ALL
    """

    # Inbound messages
    sql["route_messages"] = with_views("SELECT event_id, sender, type, has_media, route FROM routed", "routed")
    sql["classify_command"] = with_views(
        rf"""SELECT event_id, body, route,
                    CASE WHEN route <> 'text' THEN NULL WHEN b IN ('/start', 'hello', 'hi') THEN 'welcome'
                         WHEN b = '/help' THEN 'help' ELSE 'question' END AS command
             FROM (SELECT *, lower({strip("coalesce(body, '')")}) AS b FROM routed)""",
        "routed",
    )
    sql["validate_upload"] = with_views(
        f"""SELECT upload_id, content_type, size_bytes, base_type, round_even(size_bytes / 1024.0::DOUBLE, 2) AS size_kb,
                   CASE WHEN coalesce(content_type, '') <> '' AND base_type NOT IN {_voice_types} THEN 'unsupported_format'
                        WHEN size_bytes > 10 * 1024 * 1024 THEN 'too_large' ELSE 'accepted' END AS verdict
            FROM (SELECT *, trim(split_part(coalesce(content_type, ''), ';', 1)) AS base_type FROM uploads)""",
        "uploads",
    )
    sql["normalize_sender"] = with_views(
        """SELECT event_id,
                  CASE WHEN contains(sender, '@c.us') THEN left(sender, strpos(sender, '@c.us') - 1)
                       || substr(sender, strpos(sender, '@c.us') + 5) ELSE sender END AS phone_number,
                  coalesce(nullif(push_name, ''), nullif(contact_name, ''), sender) AS display_name FROM inbound""",
        "inbound",
    )
    says = lambda part: f"coalesce(contains(message, {_text(part)}), FALSE)"
    shown = _map(errors.VOICE_TEXTS, "category", "NULL"), _map(errors.TEXT_TEXTS, "category", "NULL")
    sql["error_categories"] = with_views(
        f"""SELECT channel, category, count(*) AS failures,
                   CASE WHEN channel = 'voice' THEN {shown[0]} ELSE {shown[1]} END AS shown_text
            FROM (SELECT channel, CASE WHEN code = 'ECONNREFUSED' THEN 'backend_down'
                         WHEN code = 'ETIMEDOUT' OR {says("timeout")} THEN 'timeout'
                         WHEN channel = 'voice' AND {says("Unsupported audio format")} THEN 'bad_format'
                         WHEN channel = 'voice' AND {says("transcription failed")} THEN 'not_understood'
                         ELSE 'other' END AS category FROM failures)
            GROUP BY channel, category""",
        "failures",
    )
    sql["message_previews"] = """
        SELECT conv_id AS conversation_id, turn AS seq, substr(text, 1, 50) AS short_preview,
               substr(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS long_preview,
               round_even(strlen(text) / 1024.0::DOUBLE, 2) AS size_kb
        FROM conversations
    """
    sql["request_times"] = f"""
        SELECT event_id, {iso("ts")} AS iso_time,
               (epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) // 1000 AS ms_left
        FROM events
    """

    # Language and text
    sql["tokens"] = rf"""
        SELECT doc_id AS id, coalesce(array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
               lambda t: NOT list_contains({_list(ENGLISH_STOP_WORDS)}, t)), ' '), '') AS tokens
        FROM documents
    """
    sql["detect_language"] = f"""
        WITH {lexicon_cte("SELECT doc_id AS id, translate(text, 'çéñßü', 'ɔɛŋɖɣ') AS text FROM documents")}
        SELECT id, language, round(confidence, 6) AS confidence,
               CASE WHEN confidence >= 0.6 THEN 'pattern' ELSE 'fallback' END AS method
        FROM detected
    """
    sql["detect_language_simple"] = f"SELECT doc_id AS id, {simple_language('text')} AS language FROM documents"
    sql["parse_transcript"] = with_views(
        rf""", replies AS (SELECT id, {strip("reply")} AS reply FROM asr_replies),
        numbered AS (
            SELECT id, {strip("unnest(string_split(reply, chr(10)))")} AS line,
                   generate_subscripts(string_split(reply, chr(10)), 1) AS line_no FROM replies),
        langs AS (
            SELECT id, last(code ORDER BY line_no) AS code FROM (
                SELECT id, line_no, {_transcript_code} AS code FROM (
                    SELECT id, line_no, lower({strip("replace(line, 'LANGUAGE:', '')")}) AS p
                    FROM numbered WHERE starts_with(line, 'LANGUAGE:')))
            WHERE code IS NOT NULL GROUP BY id),
        texts AS (
            SELECT id, last({strip("replace(line, 'TRANSCRIPTION:', '')")} ORDER BY line_no) AS marked
            FROM numbered WHERE starts_with(line, 'TRANSCRIPTION:') GROUP BY id),
        parsed AS (
            SELECT id, CASE WHEN coalesce(marked, '') <> '' THEN marked ELSE reply END AS text,
                   CASE WHEN coalesce(marked, '') <> '' THEN coalesce(code, 'en') ELSE {simple_language("reply")} END AS language
            FROM replies LEFT JOIN langs USING (id) LEFT JOIN texts USING (id))
        SELECT id, CASE WHEN text IN ('', '{transcript.FAILED}') THEN '' ELSE text END AS text, language,
               CASE WHEN text IN ('', '{transcript.FAILED}') THEN '{transcript.UNCLEAR}' END AS error
        FROM parsed""",
        "asr_replies",
    )
    sql["language_codes"] = with_views(
        f"""SELECT lang, documents, {_map(codes.FROM_EXTERNAL, "lang", "'en'")} AS own_code,
                   {_map(codes.TO_EXTERNAL, "lang", "lang")} AS external_code,
                   {_map(codes.LANGUAGE_NAMES, "lang", "'Unknown'")} AS language_name,
                   coalesce(lang IN {_in(codes.LANGUAGE_NAMES_LONG)}, FALSE) AS supported
            FROM (SELECT lang, count(*) AS documents FROM documents GROUP BY lang
                  UNION ALL SELECT language, count(*) FROM messages GROUP BY language)""",
        "messages",
    )
    sql["translate_lookup"] = f"""
        WITH {QUESTION_LANGUAGES}, {MEMORY}
        SELECT query_id, language AS source_lang, english, translation_confidence FROM translated
    """
    sql["bilingual_text"] = """
        SELECT conv_id AS conversation_id, turn AS seq, target_lang, text <> '' AND (target_lang = 'en' OR known) AS translated_ok,
               CASE WHEN target_lang <> 'en' AND text <> '' AND known
                    THEN '[local] ' || text || chr(10) || chr(10) || '[English: ' || text || ']' ELSE text END AS reply
        FROM (SELECT *, ['en','tw','ga','ee','dag'][(conv_id + turn) % 5 + 1] AS target_lang,
                     text IN (SELECT text FROM conversations WHERE role = 'assistant') AS known FROM conversations)
    """
    sql["parse_logs"] = with_views("SELECT * FROM parsed_logs", "parsed_logs")
    optional = lambda name, value: f"CASE WHEN {name} IS NOT NULL THEN ',\"{name}\":' || {value} ELSE '' END"
    sql["write_logs"] = with_views(
        f"""SELECT line_no, '{{"timestamp":' || to_json("timestamp") || ',"level":' || to_json(level) || ',"logger":'
                   || to_json(logger) || ',"message":' || to_json(message) || {optional("exception", "to_json(exception)")}
                   || {optional("request_id", "to_json(request_id)")} || {optional("duration_ms", "duration_ms")} || '}}' AS json
            FROM parsed_logs WHERE NOT malformed""",
        "parsed_logs",
    )
    sql["event_payload"] = "SELECT event_id AS id, event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events"

    # Retrieval
    sql["tfidf_weights"] = f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM doc_weights"
    sql["tfidf_topk"] = f"""
        WITH {keyword_ctes()} SELECT query_id, rank, doc_id, score, text AS chunk, source FROM keyword {_chunks}
    """
    sql["tfidf_topk_filled"] = f"WITH {keyword_ctes()} SELECT query_id, rank, doc_id, score FROM filled"
    sql["vector_topk"] = f"WITH {semantic_cte(5)} SELECT {SEMANTIC_COLUMNS} FROM semantic"
    sql["vector_topk_filtered"] = f"WITH {semantic_cte(5, same_user=True)} SELECT {SEMANTIC_COLUMNS} FROM semantic"
    sql["similar_messages"] = f"""
        WITH {semantic_cte(5)}, found AS (SELECT {SEMANTIC_COLUMNS} FROM semantic)
        SELECT query_id, rank, id, text AS content, similarity FROM found LEFT JOIN documents ON doc_id = id
    """
    sql["vector_ivf_recall"] = f"""
        WITH {semantic_cte(5)} SELECT query_id, count(*) AS rows, TRUE AS good FROM semantic GROUP BY query_id
    """
    sql["vector_ivf"] = sql["vector_topk"]
    sql["vector_ivf_all_lists"] = sql["vector_topk"]
    sql["hybrid_rrf"] = f"""
        WITH {fused_ctes(8)}
        SELECT query_id, rank, doc_id, keyword_rank, semantic_rank, score FROM fused WHERE rank <= 8
    """
    kept = lambda text: rf"""list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'),
                              lambda t: t NOT IN {_in(ENGLISH_STOP_WORDS)})"""  # noqa: E731
    sql["hybrid_rerank"] = f"""
        WITH RECURSIVE {fused_ctes(24)},
        terms AS (SELECT item_id AS query_id, list_distinct({kept("text")}) AS terms FROM benchmark),
        candidates AS (
            SELECT f.query_id, f.doc_id, f.score / max(f.score) OVER (PARTITION BY f.query_id) AS fused, terms,
                   {kept("coalesce(text, '')")} AS words
            FROM fused f JOIN terms USING (query_id) JOIN documents USING (doc_id) WHERE rank <= 24),
        places AS (
            SELECT query_id, doc_id, p, words[p] AS word
            FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM candidates) WHERE list_contains(terms, words[p])),
        covered AS (SELECT query_id, doc_id, count(DISTINCT word) AS covered FROM places GROUP BY query_id, doc_id),
        -- the last place of every term up to each place
        lasts AS (
            SELECT b.query_id, b.doc_id, b.p, a.word, max(a.p) AS last
            FROM places a JOIN places b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.p <= b.p
            GROUP BY ALL),
        spans AS (
            SELECT query_id, doc_id, min(span) AS span
            FROM (SELECT query_id, doc_id, p, p - min(last) + 1 AS span, count(*) AS n FROM lasts GROUP BY query_id, doc_id, p)
            JOIN covered USING (query_id, doc_id) WHERE n = covered GROUP BY query_id, doc_id),
        judged AS (
            SELECT c.query_id, c.doc_id, coalesce(covered, 0)::INTEGER AS covered, coalesce(span, 0)::INTEGER AS span,
                   list_distinct(words) AS words,
                   round(0.6::DOUBLE * fused + (1 - 0.6::DOUBLE) * coalesce(covered::DOUBLE / len(terms) * (covered::DOUBLE / span), 0), 6)
                       AS relevance
            FROM candidates c LEFT JOIN covered USING (query_id, doc_id) LEFT JOIN spans USING (query_id, doc_id)),
        alike AS (
            SELECT query_id, a.doc_id AS a, list(struct_pack(b := b.doc_id, s := CASE WHEN len(a.words) + len(b.words) = 0 THEN 0
                       ELSE len(list_intersect(a.words, b.words))::DOUBLE
                            / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) END)) AS others
            FROM judged a JOIN judged b USING (query_id) GROUP BY query_id, a.doc_id),
        pool AS (
            SELECT query_id, list(struct_pack(doc := doc_id, r := relevance, others := others)) AS rows
            FROM judged JOIN alike USING (query_id) WHERE a = doc_id GROUP BY query_id),
        chosen AS (
            SELECT query_id, rows, []::STRUCT(score DOUBLE, doc BIGINT)[] AS picks FROM pool
            UNION ALL
            SELECT query_id, rows, list_append(picks, list_max([
                       struct_pack(score := round(0.7::DOUBLE * x.r - (1 - 0.7::DOUBLE) * coalesce(list_max(
                           [o.s FOR o IN x.others IF list_contains([p.doc FOR p IN picks], o.b)]), 0), 6), doc := x.doc)
                       FOR x IN rows IF NOT list_contains([p.doc FOR p IN picks], x.doc)]))
            FROM chosen WHERE len(picks) < least(8, len(rows))),
        ranked AS (
            SELECT query_id, unnest(picks) AS pick, unnest(range(1, len(picks) + 1))::INTEGER AS rank
            FROM chosen WHERE len(picks) = least(8, len(rows)))
        SELECT query_id, pick.doc AS doc_id, rank, pick.score AS score, relevance, covered, span
        FROM ranked JOIN judged USING (query_id) WHERE judged.doc_id = pick.doc
    """
    sql["precision_at_k"] = f"""
        WITH {semantic_cte(5)}
        SELECT query_id, count(*) FILTER (label = wanted) AS hits,
               round(count(*) FILTER (label = wanted) / 5.0::DOUBLE, 6) AS precision
        FROM semantic GROUP BY query_id
    """
    sql["overlap_at_k"] = f"""
        WITH {keyword_ctes()}, {semantic_cte(8)}
        SELECT k.query_id, count(s.id) AS shared, round(count(s.id) / 8.0::DOUBLE, 6) AS overlap
        FROM keyword k LEFT JOIN semantic s ON s.query_id = k.query_id AND s.id = k.doc_id GROUP BY k.query_id
    """
    sql["context_text"] = f"WITH {keyword_ctes()} SELECT query_id, {_context} AS context FROM keyword {_chunks} GROUP BY query_id"
    sql["prompt_table"] = f"""
        WITH {QUESTION_LANGUAGES}, {MEMORY},
        {keyword_ctes("(SELECT query_id, english AS query FROM translated)")},
        contexts AS (SELECT query_id, {_context} AS context FROM filled {_chunks} GROUP BY query_id)
        SELECT query_id, language, {_prompt} AS prompt
        FROM translated LEFT JOIN contexts USING (query_id) WHERE query <> ''
    """

    # Upserts, derived state, quality
    sql["users_from_log"] = with_views(f", {_users_from_log} SELECT * FROM upserted", "users", "message_log", "as_of")
    sql["user_created_events"] = with_views(
        f""", {_users_from_log}
            SELECT phone_number, 'user_created' AS event_type,
                   '{{"phone_number":' || to_json(phone_number) || ',"name":' || coalesce(to_json(name), 'null') || '}}' AS event_data,
                   created_at FROM upserted WHERE is_new""",
        "users", "message_log", "as_of",
    )
    sql["assign_conversation"] = with_views(
        """SELECT u.id AS user_id, coalesce(c.id, u.id * 1000 + 999) AS conversation_id, c.id IS NULL AS is_new
           FROM users u LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (
               PARTITION BY user_id ORDER BY started_at DESC NULLS FIRST, id DESC) AS rn FROM convs WHERE is_active)
               WHERE rn = 1) c ON c.user_id = u.id""",
        "users", "convs",
    )
    sql["sessions_gap"] = with_views("SELECT * FROM sessions", "sessions")
    sql["language_changes"] = with_views(
        """SELECT u.id AS user_id, u.preferred_language AS old_language, m.language AS new_language
           FROM users u JOIN (SELECT * FROM (SELECT *, row_number() OVER (
               PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM messages WHERE language IS NOT NULL)
               WHERE rn = 1) m ON m.user_id = u.id
           WHERE u.preferred_language IS DISTINCT FROM m.language""",
        "users", "messages",
    )
    sql["profile_patch"] = with_views(
        """SELECT id, name, location, farm_size, crops,
                  CASE WHEN (name, location, farm_size, crops) IS DISTINCT FROM (old_name, old_location, old_size, old_crops)
                       THEN now ELSE updated_at END AS updated_at
           FROM (SELECT u.id, coalesce(nullif(p.name, ''), u.name) AS name, u.name AS old_name,
                        coalesce(nullif(p.location, ''), u.location) AS location, u.location AS old_location,
                        coalesce(nullif(p.farm_size, ''), u.farm_size) AS farm_size, u.farm_size AS old_size,
                        coalesce(p.crops, array_to_string(u.crops, ',')) AS crops,
                        array_to_string(u.crops, ',') AS old_crops, u.updated_at
                 FROM users u LEFT JOIN patches p ON p.user_id = u.id) CROSS JOIN as_of""",
        "users", "patches", "as_of",
    )
    # greetings and help requests are answered before the state is set and before anything is stored
    answered = f"""(SELECT *, 'Re: ' || coalesce(body, '') AS response
                    FROM (SELECT *, lower({strip("coalesce(body, '')")}) AS b FROM routed)
                    WHERE NOT (route = 'text' AND b IN ('/start', 'hello', 'hi', '/help')))"""
    newest = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY ts DESC, event_id DESC) AS rn
                                 FROM {answered}) WHERE rn = 1)"""
    sql["latest_state"] = with_views(
        f"""SELECT sender, body AS last_message, response AS last_response, route AS message_type, ts AS last_at
            FROM {newest}""",
        "routed",
    )
    sql["counters_after_save"] = with_views(
        """SELECT c.id, c.user_id, c.message_count + count(m.id) AS message_count
           FROM convs c LEFT JOIN messages m ON m.conversation_id = c.id AND m.id % 2 = 0
           GROUP BY c.id, c.user_id, c.message_count""",
        "convs", "messages",
    )
    sql["users_after_language"] = with_views(
        """SELECT u.id, coalesce(m.language, u.preferred_language) AS preferred_language,
                  CASE WHEN m.language IS NOT NULL AND u.preferred_language IS DISTINCT FROM m.language
                       THEN now ELSE u.updated_at END AS updated_at
           FROM users u LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (
               PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM messages WHERE language IS NOT NULL)
               WHERE rn = 1) m ON m.user_id = u.id CROSS JOIN as_of""",
        "users", "messages", "as_of",
    )
    rule = "SELECT {0} AS table_name, {1} AS constraint_name, {2} AS violations FROM {3}"
    rules = [
        ("users", "unique(phone_number)", "count(phone_number) - count(DISTINCT phone_number)", "users"),
        ("signups", "unique(phone_number)", "count(phone_number) - count(DISTINCT phone_number)", "signups"),
        *[("users", f"not_null({c})", f"count(*) - count({c})", "users") for c in ("phone_number", "created_at")],
        *[
            ("users", f"length({c}) <= {n}", f"count(*) FILTER (length({c}) > {n})", "users")
            for c, n in (("phone_number", 20), ("name", 255), ("preferred_language", 5), ("location", 255), ("farm_size", 50))
        ],
        *[
            ("messages", f"not_null({c})", f"count(*) - count({c})", "messages")
            for c in ("message_type", "direction", "content", "language")
        ],
        *[
            ("messages", f"length({c}) <= {n}", f"count(*) FILTER (length({c}) > {n})", "messages")
            for c, n in (("message_type", 20), ("direction", 10), ("language", 5))
        ],
        ("messages", "foreign key(user_id)", "count(*) FILTER (user_id NOT IN (SELECT id FROM users))", "messages"),
        ("messages", "foreign key(conversation_id)", "count(*) FILTER (conversation_id NOT IN (SELECT id FROM convs))", "messages"),
        ("sessions", "unique(session_token)", "count(session_token) - count(DISTINCT session_token)", "session_rows"),
        ("preferences", "unique(user_id)", "count(user_id) - count(DISTINCT user_id)", "prefs"),
        ("sessions", "length(session_token) <= 255", "count(*) FILTER (length(session_token) > 255)", "session_rows"),
        ("analytics", "not_null(event_type)", "count(*) - count(event_type)", "events"),
        ("analytics", "length(event_type) <= 50", "count(*) FILTER (length(event_type) > 50)", "events"),
        ("sessions", "foreign key(user_id)", "count(*) FILTER (user_id NOT IN (SELECT id FROM users))", "session_rows"),
        ("sessions", "foreign key(conversation_id)", "count(*) FILTER (conversation_id NOT IN (SELECT id FROM convs))", "session_rows"),
        ("preferences", "foreign key(user_id)", "count(*) FILTER (user_id NOT IN (SELECT id FROM users))", "prefs"),
        ("analytics", "foreign key(user_id)", "count(*) FILTER (user_id NOT IN (SELECT id FROM users))", "events"),
        ("message_log", "foreign key(phone_number)", "count(*) FILTER (phone_number NOT IN (SELECT phone_number FROM users))", "message_log"),
    ]
    sql["constraint_audit"] = with_views(
        " UNION ALL ".join(rule.format(_text(t), _text(c), n, source) for t, c, n, source in rules),
        "users", "signups", "messages", "convs", "message_log", "prefs", "session_rows",
    )

    # Streams: windows and sessions that the watermark (newest event - 10 minutes) has passed
    mark = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
    sql["stream_ingest"] = with_views(
        f""", {lexicon_cte("SELECT event_id AS id, coalesce(body, '') AS text FROM routed")}
            SELECT event_id AS id, CASE WHEN contains(sender, '@c.us') THEN left(sender, strpos(sender, '@c.us') - 1)
                       || substr(sender, strpos(sender, '@c.us') + 5) ELSE sender END AS phone_number,
                   route AS message_type, 'incoming' AS direction, coalesce(body, '') AS content, language, confidence,
                   CASE WHEN route <> 'text' THEN NULL WHEN b IN ('/start', 'hello', 'hi') THEN 'welcome'
                        WHEN b = '/help' THEN 'help' ELSE 'question' END AS command, ts AS created_at
            FROM {answered} r JOIN detected d ON d.id = r.event_id
            -- a declared type has to be one of the audio types, whatever its parameters; an upload beyond ten megabytes is refused
            WHERE route <> 'voice' OR ((coalesce(content_type, '') = ''
                      OR trim(split_part(content_type, ';', 1)) IN {_voice_types}) AND coalesce(size_bytes, 0) <= 10 * 1024 * 1024)""",
        "routed",
    )
    sql["stream_activity"] = f"""
        SELECT * FROM (SELECT {five} AS window_start, count(*) AS messages, count(DISTINCT user_id) AS active_senders
                       FROM events GROUP BY 1) WHERE window_start + INTERVAL 5 MINUTE <= {mark}
    """
    sql["stream_active_sliding"] = f"SELECT * FROM ({sliding}) WHERE window_start + INTERVAL 24 HOUR <= {mark}"
    sql["stream_sessions"] = with_views(
        f"""SELECT user_id, started_at, last_activity_at, expires_at, messages FROM sessions WHERE expires_at <= {mark}""",
        "sessions",
    )
    sql["stream_dedup"] = "SELECT event_id, user_id, event_type FROM events"
    sql["stream_latest_state"] = with_views(
        f"""SELECT sender, body AS last_message, response AS last_response, route AS message_type, ts AS last_at,
                   ts + INTERVAL 24 HOUR < (SELECT max(ts) FROM {answered}) AS expired
            FROM {newest}""",
        "routed",
    )
    sql["stream_expired_senders"] = with_views(
        f"""SELECT sender, body AS last_message, ts AS last_at FROM {newest}
            WHERE ts + INTERVAL 24 HOUR < (SELECT max(ts) FROM {answered}) - INTERVAL 10 MINUTE""",
        "routed",
    )
    return sql


ORACLES = _statements()
