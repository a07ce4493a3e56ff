"""The model views once more, in SQL over the base tables."""

from __future__ import annotations

LANGS = "['en','tw','ga','ee','dag']"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "users": (
        (),
        f"""
        SELECT c_custkey AS id,
               CASE WHEN c_custkey = 0 THEN 'system' ELSE '+' || lpad(c_custkey::VARCHAR, 9, '0') END AS phone_number,
               c_name AS name,
               {LANGS}[c_nationkey % 5 + 1] AS preferred_language,
               n_name AS location,
               c_mktsegment AS farm_size,
               [lower(c_mktsegment), lower(n_name)] AS crops,
               TRUE AS is_active,
               a.created_at, a.last_active_at, a.last_active_at AS updated_at
        FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT user_id, min(ts) AS created_at, max(ts) AS last_active_at FROM events GROUP BY user_id) a
               ON a.user_id = c_custkey
        """,
    ),
    "messages": (
        (),
        f"""
        SELECT event_id AS id,
               user_id * 1000 + (day(ts) - 1) // 10 AS conversation_id,
               user_id,
               CASE event_type WHEN 'view' THEN 'voice' WHEN 'error' THEN 'system' ELSE 'text' END AS message_type,
               CASE WHEN event_id % 2 = 0 THEN 'incoming' ELSE 'outgoing' END AS direction,
               props AS content,
               CASE WHEN event_type = 'view' THEN props::JSON ->> '$.k' END AS transcribed_text,
               {LANGS}[user_id % 6 + 1] AS language,
               ts AS created_at
        FROM events
        """,
    ),
    "convs": (
        ("messages",),
        """
        SELECT conversation_id AS id, user_id, min(created_at) AS started_at,
               count(*) FILTER (message_type <> 'system') AS message_count,
               NULL::TIMESTAMP AS ended_at, TRUE AS is_active
        FROM messages GROUP BY conversation_id, user_id
        """,
    ),
    "message_text": (
        (),
        """
        SELECT conv_id AS conversation_id, turn AS seq,
               CASE role WHEN 'user' THEN 'incoming' WHEN 'assistant' THEN 'outgoing' ELSE 'system' END AS direction,
               text AS content
        FROM conversations
        """,
    ),
    "prefs": ((), "SELECT c_custkey AS id, c_custkey AS user_id FROM customer WHERE c_acctbal > 0"),
    "kb": ((), "SELECT doc_id AS id, text AS question, text AS answer, source FROM documents"),
    "questions": ((), "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "vectors": ((), "SELECT vec_id AS id, embedding, label AS user_id FROM embeddings"),
    "question_vectors": (
        (), "SELECT item_id AS query_id, embedding, label AS user_id FROM benchmark JOIN embeddings ON item_id = vec_id"
    ),
    "transliterated": ((), "SELECT doc_id AS id, translate(text, 'çéñßü', 'ɔɛŋɖɣ') AS text FROM documents"),
    "inbound": (
        (),
        """
        SELECT event_id,
               CASE WHEN event_id % 11 = 3 THEN lpad(user_id::VARCHAR, 9, '0') || '@g.us'
                    WHEN event_id % 13 = 5 THEN 'status@broadcast'
                    ELSE lpad(user_id::VARCHAR, 9, '0') || '@c.us' END AS sender,
               CASE event_id % 7 WHEN 0 THEN '/start' WHEN 1 THEN ' HELLO ' WHEN 2 THEN chr(10) || '/Help'
                    WHEN 3 THEN 'hi' WHEN 4 THEN 'hi there' WHEN 6 THEN props END AS body,
               CASE event_type WHEN 'view' THEN 'ptt' WHEN 'click' THEN 'audio' WHEN 'signup' THEN 'voice'
                    WHEN 'error' THEN 'image' ELSE 'chat' END AS type,
               event_id % 5 <> 0 AS has_media,
               CASE event_id % 3 WHEN 0 THEN 'user ' || user_id WHEN 1 THEN '' END AS push_name,
               CASE WHEN event_id % 4 = 0 THEN 'contact ' || user_id END AS contact_name,
               ['audio/ogg; codecs=opus', 'audio/mpeg', ' audio/wav ;rate=8000', 'video/mp4', 'audio/x-m4a',
                'AUDIO/OGG', ''][event_id % 8 + 1] AS content_type,
               CASE event_id % 17 WHEN 9 THEN 10485760 WHEN 10 THEN 10485761
                    ELSE floor(value * 100000)::BIGINT END AS size_bytes,
               ts
        FROM events
        """,
    ),
    "routed": (
        ("inbound",),
        """
        SELECT *, CASE WHEN has_media AND type IN ('ptt', 'audio', 'voice') THEN 'voice' ELSE 'text' END AS route
        FROM inbound WHERE sender NOT LIKE '%@g.us%' AND sender NOT LIKE '%status@broadcast%'
        """,
    ),
    "uploads": (
        (),
        """
        SELECT event_id AS upload_id,
               ['audio/ogg; codecs=opus', 'audio/mpeg', ' audio/wav ;rate=8000', 'video/mp4', 'audio/x-m4a',
                'AUDIO/OGG', ''][event_id % 8 + 1] AS content_type,
               CASE event_id % 17 WHEN 0 THEN 10485760 WHEN 1 THEN 10485761
                    ELSE floor(value * 100000)::BIGINT END AS size_bytes
        FROM events
        """,
    ),
    "asr_replies": (
        ("transliterated",),
        """
        SELECT id, CASE id % 9
            WHEN 0 THEN 'LANGUAGE: tw' || chr(10) || 'TRANSCRIPTION: ' || text
            WHEN 1 THEN '  LANGUAGE: Twi (Akan)' || chr(10) || '  TRANSCRIPTION:   ' || text || '  '
            WHEN 2 THEN 'LANGUAGE: ga' || chr(10) || 'TRANSCRIPTION: first' || chr(10) || 'LANGUAGE: unknown' || chr(10)
                        || 'TRANSCRIPTION: ' || text
            WHEN 3 THEN text
            WHEN 4 THEN 'LANGUAGE: en' || chr(10) || 'TRANSCRIPTION: TRANSCRIPTION_FAILED'
            WHEN 5 THEN '  ' || chr(10) || ' '
            WHEN 6 THEN 'LANGUAGE: Dagbani' || chr(10) || text
            WHEN 7 THEN 'LANGUAGE: EE' || chr(10) || 'LANGUAGE: DAG LANGUAGE:' || chr(10)
                        || 'TRANSCRIPTION: TRANSCRIPTION: ' || text
            ELSE 'LANGUAGE: ewe' || chr(10) || 'TRANSCRIPTION: ' || text || chr(10) || 'TRANSCRIPTION:' END AS reply
        FROM transliterated
        """,
    ),
    "log_lines": (
        (),
        r"""
        SELECT event_id AS line_no,
               CASE WHEN event_id % 10 = 7 THEN 'plain text ' || event_type ELSE
               '{"timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '", "level": "'
               || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END
               || '", "logger": "service", "message": "' || event_type || ' done"'
               || CASE WHEN event_type = 'error' THEN ', "exception": "Traceback\nValueError"' ELSE '' END
               || CASE WHEN event_id % 3 <> 0 THEN ', "request_id": "r' || event_id || '"' ELSE '' END
               || CASE WHEN event_id % 4 = 1 THEN ', "duration_ms": ' || (event_id % 5000) ELSE '' END
               || '}' END AS line
        FROM events
        """,
    ),
    "parsed_logs": (
        ("log_lines",),
        """
        SELECT line_no, NOT json_valid(line) AS malformed,
               j ->> '$.timestamp' AS "timestamp", j ->> '$.level' AS level, j ->> '$.logger' AS logger,
               j ->> '$.message' AS message, j ->> '$.exception' AS exception, j ->> '$.request_id' AS request_id,
               (j ->> '$.duration_ms')::BIGINT AS duration_ms
        FROM (SELECT *, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM log_lines)
        """,
    ),
    "timings": (
        (),
        """
        SELECT event_id, event_type = 'view' AS voice, event_id % 97 AS rag, floor(value * 10)::BIGINT AS llm,
               CASE WHEN event_type = 'view' THEN event_id % 53 + 100 END AS asr
        FROM events
        """,
    ),
    "failures": (
        (),
        """
        SELECT event_id, CASE WHEN event_type = 'view' THEN 'voice' ELSE 'text' END AS channel,
               [NULL, 'ECONNREFUSED', 'ETIMEDOUT', 'EPIPE', NULL, NULL][event_id % 6 + 1] AS code,
               ['timeout of 60000ms exceeded', 'connect failed', NULL, 'Unsupported audio format: video/mp4',
                'audio transcription failed', 'Request failed with status code 500',
                'socket hang up'][event_id % 7 + 1] AS message
        FROM events
        """,
    ),
    "message_log": (
        (),
        f"""
        SELECT event_id, '+' || lpad((user_id * 20)::VARCHAR, 9, '0') AS phone_number,
               CASE WHEN event_id % 5 <> 0 THEN 'sender ' || user_id END AS name,
               {LANGS}[event_id % 6 + 1] AS language, ts
        FROM events
        """,
    ),
    "patches": (
        (),
        """
        SELECT s_suppkey AS user_id,
               CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE s_name END AS name,
               CASE s_suppkey % 3 WHEN 0 THEN 'North' WHEN 1 THEN '' END AS location,
               CASE WHEN s_suppkey % 5 = 0 THEN '2 acres' END AS farm_size,
               CASE WHEN s_suppkey % 2 = 0 THEN 'maize,rice' END AS crops
        FROM supplier
        """,
    ),
    "signups": (
        (),
        """
        SELECT s_suppkey AS id, '+' || lpad(((s_suppkey // 2) * 40)::VARCHAR, 9, '0') AS phone_number, s_name AS name,
               'en' AS preferred_language
        FROM supplier
        """,
    ),
    "as_of": ((), "SELECT max(ts) AS now FROM events"),
    # sessions: pause of more than 30 minutes
    "sessions": (
        ("messages",),
        """
        SELECT user_id, session_no, min(created_at) AS started_at, max(created_at) AS last_activity_at,
               count(*) AS messages, max(created_at) + INTERVAL 30 MINUTE AS expires_at
        FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY created_at, id)::BIGINT AS session_no
              FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
                    FROM messages WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)))
        GROUP BY user_id, session_no
        """,
    ),
    "session_rows": (
        ("sessions",),
        """
        SELECT user_id * 100000 + session_no AS id, user_id, user_id * 1000 + (day(started_at) - 1) // 10 AS conversation_id,
               user_id || '-' || session_no AS session_token, started_at, last_activity_at, expires_at,
               expires_at >= (SELECT max(ts) FROM events) AS is_active
        FROM sessions
        """,
    ),
}


def with_views(body: str, *names: str) -> str:
    """Put the named views, and those they build on, in front of a query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEWS[name][1].strip()})" for name in ordered]
    return f"WITH {', '.join(parts)}\n{body.strip()}" if parts else body.strip()
