"""Schemas of the logical tables that the operators work on, as DDL."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "users": "id long, username string",
    "media": "id long, user_id long, media_type string, batch_stem string, storage_path string, uploaded_at timestamp_ntz",
    "details": "media_id long, kind string, batch_index int, lecture_title string, subject_area string, pdf_report_path string",
    "flashcards": "media_id long, card_index int, question string, answer string, topic string, difficulty string",
    "quiz_questions": "media_id long, question_index int, question string, options map<string,string>, correct_answer string, topic string",
    "notes": "media_id long, content string",
    "segments": "media_id long, segment_index int, start_time double, end_time double, text string",
    "progress": "event_id long, user_id long, media_id long, item_type string, card_index int, confidence int, correct boolean, session_id string, reviewed_at timestamp_ntz",
    "quiz_sessions": "user_id long, media_id long, total_questions int, correct_answers int, accuracy_score double, completed_at timestamp_ntz",
    "live_lectures": "id long, user_id long, session_id string, title string, state string, started_at double",
    "frames": "media_id long, frame_id long, concepts array<string>",
    "live_segments": "session_id string, chunk_index int, id int, start double, end double, text string",
}

ACADEMIC_CONTENT = "slide_title string, key_concepts array<string>, definitions array<struct<term:string,definition:string>>, formulas array<string>, bullet_points array<string>, diagram_type string, content_summary string, importance string"
CARD = "question string, answer string, topic string, difficulty string"
QUESTION = "question string, options map<string,string>, correct_answer string, explanation string, topic string"
