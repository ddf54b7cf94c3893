"""Schemas of the tables and lines that come from outside."""

TURN = "id long, session_id string, session_turn long, speaker string, text string, ts long, source_uuid string"
SPOOL = "session_id string, speaker string, text string, ts long, uuid string"
LINE = "session_id string, speaker string, text string, ts long"
