"""Queries of the library by name, with the SQL that gives the same rows.

A query binds logical tables and applies operators; QUERIES holds it with its SQL (None where SQL can't say it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import json_recovery, prompts, text
from lectern.operators import dashboard, dedup, engagement, graph, lecture, library, media, recommendations, search, writes
from lectern.plans.bindings import Tables, sql
from lectern.plans.session import new_path
from lectern.sources import artifacts, files, models
from lectern.streaming import live, sessions, slides

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}
NOW = "2024-01-30 00:00:00"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f, oracle
        return f

    return add


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in QUERIES.items() if s}


# --- catalogue ---------------------------------------------------------------------------------------------------

_FIRST = "first_d as (select * from (select *, row_number() over (partition by media_id, kind order by batch_index) as rn from details) where rn = 1)"
_TITLED = (
    f"{_FIRST}, titled as (select m.*, d.lecture_title, d.subject_area, d.pdf_report_path from media m left "
    f"join first_d d on d.media_id = m.id and d.kind = case when m.media_type = 'live' then 'video' else m.media_type end)"
)
_TITLES = f"{_TITLED}, titles as (select id as media_id, user_id, batch_stem, coalesce(nullif(lecture_title, ''), nullif(batch_stem, ''), 'Unknown') as title from titled)"
_STATES = (
    f"{_TITLED}, newest as (select * from (select *, row_number() over (partition by user_id, batch_stem order by uploaded_at desc, id desc) as rn "
    f"from titled) where rn = 1), fc as (select media_id, count(*) as n from flashcards group by 1), qc as (select media_id, count(*) as n "
    f"from quiz_questions group by 1), states as (select id, user_id, batch_stem, "
    f"case when media_type = 'image' then 'images' else media_type end as input_type, lecture_title, subject_area, uploaded_at, "
    f"coalesce(fc.n, 0) as flashcard_count, coalesce(qc.n, 0) as quiz_count, (nt.media_id is not null or pdf_report_path is not null) as summary_ready, "
    f"coalesce(fc.n, 0) > 0 as flashcards_ready, coalesce(qc.n, 0) > 0 as quiz_ready, media_type = 'video' as audio_ready from newest m left "
    f"join fc on fc.media_id = m.id left join qc on qc.media_id = m.id left join (select distinct media_id from notes) nt on nt.media_id = m.id)"
)
_STATE_TABLES = ("media", "details", "flashcards", "quiz_questions", "notes")


def _states(t: Tables) -> DataFrame:
    return media.states(t.media(), t.details(), t.flashcards(), t.quiz_questions(), t.notes())


def _titles(t: Tables) -> DataFrame:
    return media.titles(t.media(), t.details())


query("media_states", sql(f"with {_STATES} select * from states", *_STATE_TABLES))(_states)
query("media_titles", sql(f"with {_TITLES} select * from titles", "media", "details"))(_titles)
query("flashcard_counts", sql("select media_id, count(*) as flashcard_count from flashcards group by 1", "flashcards"))(lambda t: media.counts(t.flashcards(), "flashcard_count"))
query("first_image", sql(f"with {_FIRST} select media_id, kind, batch_index, lecture_title from first_d", "details"))(lambda t: media.first_image(t.details()).select("media_id", "kind", "batch_index", "lecture_title"))
query("newest_per_stem", sql("select id, user_id, batch_stem, uploaded_at from (select *, row_number() over (partition by user_id, batch_stem order by uploaded_at desc, id desc) as rn from media) where rn = 1", "media"))(lambda t: media.newest_per_stem(t.media()).select("id", "user_id", "batch_stem", "uploaded_at"))
query("stem_lookup", sql(
    "select id, user_id, batch_stem from (select *, row_number() over (partition by user_id "
    "order by (batch_stem = 'lec_5') desc, uploaded_at desc, id desc) as rn from media "
    "where batch_stem = 'lec_5' or regexp_replace(regexp_extract(storage_path, '([^/]*)$', 1), '\\.[^.]*$', '') = '101_clip.v1') "
    "where rn = 1 and batch_stem = 'lec_5'",
"media"))(lambda t: media.stem_lookup(t.media(), "lec_5").where("batch_stem = 'lec_5'").select("id", "user_id", "batch_stem"))
query("status_totals", sql(f"with {_STATES} select count(*) as total, " + ", ".join(f"count(*) filter (input_type = '{k}') as total_{k}" for k in ("video", "audio", "images", "document", "live")) + ", coalesce(sum(flashcard_count), 0)::bigint as flashcards from states", *_STATE_TABLES))(lambda t: media.status_totals(_states(t)))
query("status_preferred", sql(
    "with a as (select id, user_id, batch_stem from media where id % 3 = 0), b as (select id, user_id, batch_stem from media where id % 3 <> 0) select * "
    "from a union all select * from b where not exists (select 1 from a where a.user_id = b.user_id and a.batch_stem = b.batch_stem)",
"media"))(
    lambda t: media.prefer(*(t.media().where(c).select("id", "user_id", "batch_stem") for c in ("id % 3 = 0", "id % 3 <> 0")), ["user_id", "batch_stem"])
)
query("library_search", sql(
    f"with {_STATES} select id, user_id, batch_stem, lecture_title, input_type, uploaded_at, summary_ready from states "
    f"where contains(lower(coalesce(lecture_title, batch_stem)), 'lecture 1') and summary_ready",
*_STATE_TABLES))(lambda t: library.search(_states(t), "LECTURE 1", "processed"))

# --- engagement --------------------------------------------------------------------------------------------------

_DERIVED = (
    "derived as (select user_id, media_id, session_id, max(reviewed_at) as completed_at, count(*) as total, sum(correct::int)::bigint as correct_count, sum(correct::int) / count(*) * 100 as accuracy_score "
    "from progress where item_type = 'quiz_question' group by 1, 2, 3)"
)
_HISTORY = (
    f"{_TITLES}, {_DERIVED}, history as (select o.user_id, completed_at, round(score, 1) as score, coalesce(title, 'Unknown') as title from (select *, "
    f"row_number() over (partition by user_id, completed_at order by source, media_id desc, score desc) as rn "
    f"from (select user_id, media_id, completed_at, accuracy_score as score, 0 as source from quiz_sessions union all "
    f"select user_id, media_id, completed_at, accuracy_score, 1 from derived where accuracy_score is not null)) o left "
    f"join titles t on t.media_id = o.media_id where rn = 1)"
)
_REVIEWS = (
    "reviews as (select user_id, media_id, card_index, count(*) as reviews, round(avg(confidence), 2) as avg_confidence, count(*) filter (correct) as correct_count, max(reviewed_at) as last_reviewed, "
    "coalesce(avg(confidence) <= 3, true) as needs_review from progress where item_type = 'flashcard' group by 1, 2, 3)"
)


def _history(t: Tables) -> DataFrame:
    return engagement.quiz_history(t.quiz_sessions(), t.progress(), _titles(t))


query("progress_summary", sql(
    "with p as (select user_id, count(*) as total_reviews, count(*) filter (correct) as correct_count, count(*) filter (item_type = 'flashcard') as flashcard_reviews, count(*) filter (item_type = 'quiz_question') as quiz_reviews, round(avg(confidence), 2) as avg_confidence "
    "from progress group by 1) select *, case when avg_confidence > 0 then round(avg_confidence / 5.0 * 100, 1) else 0.0 end as avg_confidence_pct from p",
"progress"))(lambda t: engagement.progress_summary(t.progress()))
query("derived_sessions", sql(f"with {_DERIVED} select user_id, media_id, session_id, completed_at, total, correct_count, round(accuracy_score, 6) as accuracy_score from derived", "progress"))(lambda t: engagement.derived_sessions(t.progress()).withColumn("accuracy_score", F.round("accuracy_score", 6)))
query("quiz_history", sql(f"with {_HISTORY} select * from history", "media", "details", "progress", "quiz_sessions"))(_history)
query("quiz_accuracy", sql(f"with {_HISTORY} select user_id, count(*) as total_quizzes, round(avg(score), 1) as quiz_accuracy_pct from history group by 1", "media", "details", "progress", "quiz_sessions"))(lambda t: engagement.quiz_accuracy(_history(t)))
query("card_review_summary", sql(f"with {_REVIEWS} select * from reviews", "progress"))(lambda t: engagement.card_reviews(t.progress()))
query("due_cards", sql(
    f"with {_REVIEWS}, due as (select m.user_id, c.media_id, c.card_index, c.question, "
    f"case when r.needs_review is null then 0 else 1 end as priority, r.last_reviewed from flashcards c join media m on m.id = c.media_id left "
    f"join reviews r on r.user_id = m.user_id and r.media_id = c.media_id and r.card_index = c.card_index where coalesce(r.needs_review, true)) "
    f"select user_id, position, media_id, card_index, question, priority, last_reviewed from (select *, row_number() over (partition by user_id "
    f"order by priority, last_reviewed nulls first, media_id, card_index) as position from due) where position <= 20",
"media", "flashcards", "progress"))(lambda t: engagement.due_cards(t.flashcards(), t.media(), engagement.card_reviews(t.progress())))
query("latest_scores", sql(
    "select user_id, media_id, position, accuracy_score, completed_at from (select *, row_number() over (partition by user_id, media_id "
    "order by completed_at desc, accuracy_score desc) as position from quiz_sessions) where position <= 5",
"quiz_sessions"))(lambda t: engagement.latest_scores(t.quiz_sessions()))
query("plan_context", sql(
    "with s as (select user_id, media_id, string_agg(accuracy_score::int::varchar, ',' order by position) as scores from (select *, "
    "row_number() over (partition by user_id, media_id order by completed_at desc, accuracy_score desc) as position from quiz_sessions) "
    "where position <= 5 group by 1, 2), c as (select media_id, count(*) as total_cards from flashcards group by 1), "
    "p as (select user_id, media_id, count(*) as reviewed, round(avg(coalesce(confidence, 0)), 4) as avg_confidence from progress "
    "where item_type = 'flashcard' group by 1, 2) select s.user_id, s.media_id, scores, coalesce(total_cards, 0) as total_cards, "
    "coalesce(reviewed, 0) as reviewed, coalesce(avg_confidence, 0.0) as avg_confidence from s left join c using (media_id) left "
    "join p on p.user_id = s.user_id and p.media_id = s.media_id",
"quiz_sessions", "flashcards", "progress"))(lambda t: engagement.plan_context(t.quiz_sessions(), t.flashcards(), t.progress()))

# --- recommendations ---------------------------------------------------------------------------------------------

_URGENCY = "case when {0} < 40 then 'critical' when {0} < 60 then 'high' else 'medium' end"
_MATERIAL = (
    "material as (select m.user_id, m.id as media_id, coalesce(c.n, 0) as cards, coalesce(q.n, 0) as questions from media m left "
    "join (select media_id, count(*) as n from flashcards group by 1) c on c.media_id = m.id left join (select media_id, count(*) as n from quiz_questions "
    "group by 1) q on q.media_id = m.id where c.n is not null or q.n is not null)"
)
_UNTESTED = "untested as (select * from material m where not exists (select 1 from quiz_sessions s where s.user_id = m.user_id and s.media_id = m.media_id))"
_UNREVIEWED = "unreviewed as (select * from material m where cards > 0 and not exists (select 1 from progress p where p.item_type = 'flashcard' and p.user_id = m.user_id and p.media_id = m.media_id))"
_WORST = "worst as (select user_id, media_id, min(accuracy_score) as worst_score from quiz_sessions group by 1, 2 having min(accuracy_score) < 70)"
_WITH_MATERIAL = ("media", "flashcards", "quiz_questions", "quiz_sessions", "progress")


def _material(t: Tables) -> DataFrame:
    return recommendations.material(t.media(), t.flashcards(), t.quiz_questions())


query("worst_quiz_per_lecture", sql(
    f"with {_TITLES}, {_WORST} select w.user_id, w.media_id, title, worst_score, {_URGENCY.format('worst_score')} as urgency from worst w "
    f"join titles t on t.user_id = w.user_id and t.media_id = w.media_id",
"media", "details", "quiz_sessions"))(lambda t: recommendations.worst_quizzes(t.quiz_sessions(), _titles(t)))
query("untested_media", sql(f"with {_MATERIAL}, {_UNTESTED} select * from untested", *_WITH_MATERIAL))(lambda t: recommendations.untested(_material(t), t.quiz_sessions()))
query("unreviewed_media", sql(f"with {_MATERIAL}, {_UNREVIEWED} select * from unreviewed", *_WITH_MATERIAL))(lambda t: recommendations.unreviewed(_material(t), t.progress()))
query("study_recommendations", sql(
    f"with {_TITLES}, {_WORST}, {_MATERIAL}, {_UNTESTED}, {_UNREVIEWED}, "
    f"cand as (select user_id, media_id, 1 as pass, {_URGENCY.format('worst_score')} as urgency, 'low_score' as type, worst_score as score, 'Scored ' || round(worst_score)::int || '% — needs revision' as reason "
    f"from (select *, row_number() over (partition by user_id order by worst_score, media_id) as rn from worst) where rn <= 5 union all "
    f"select user_id, media_id, 2, 'medium', 'untested', 0.0::double, questions || ' quiz questions — never attempted' from untested union all "
    f"select user_id, media_id, 3, 'low', 'unreviewed', 0.0::double, cards || ' flashcards — never reviewed' from unreviewed), one as (select * "
    f"from (select *, row_number() over (partition by user_id, media_id order by pass) as rn from cand) where rn = 1), top as (select *, "
    f"row_number() over (partition by user_id order by "
    f"case urgency when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, score, pass, media_id) as position from one) "
    f"select p.user_id, position, p.media_id, title, reason, urgency, type, score from top p "
    f"join titles t on t.media_id = p.media_id and t.user_id = p.user_id where position <= 5",
"media", "details", "flashcards", "quiz_questions", "quiz_sessions", "progress"))(
    lambda t: recommendations.recommendations(t.media(), _titles(t), t.quiz_sessions(), t.flashcards(), t.quiz_questions(), t.progress())
)

# --- dashboard ---------------------------------------------------------------------------------------------------

_BAG = (
    "bag as (select user_id, id::varchar as key, case when media_type = 'image' then 'images' else media_type end as input_type, uploaded_at as created_at "
    "from media union all select user_id, session_id, 'live', started_at from live_lectures)"
)
_SUBJECT = "case " + " ".join(f"when contains(s, '{x}') then split_part(s, '{x}', 1)" for x in text.SEPARATORS) + " else s end"
_TITLE_SQL = "array_to_string(list_transform(regexp_extract_all({0}, '(\\pL+|\\PL+)'), lambda r: case when r[1] = 'ß' then 'Ss' else upper(r[1]) end || lower(r[2:])), '')"
_SUBJECTS = f"subjects as (select {_TITLE_SQL.format('trim(x)')} as subject from (select {_SUBJECT} as x from (select trim(subject_area) as s from details)) where trim(x) <> '')"


def _bag(t: Tables, dedupe: bool = False) -> DataFrame:
    return dashboard.with_live(t.media(), t.live_lectures(), dedupe)


_KINDS = ("video", "audio", "images", "document", "live")
query("type_counts_48h", sql(f"with {_BAG}, c as (select user_id, " + ", ".join(f"count(*) filter (input_type = '{k}') as total_{k}" for k in _KINDS) + ", " + ", ".join(f"count(*) filter (input_type = '{k}' and created_at >= timestamp '1998-08-01' - interval 48 hours) as recent_{k}" for k in _KINDS if k != "live") + f" from bag group by 1) select *, ({' + '.join(f'total_{k}' for k in _KINDS)})::bigint as total_all, ({' + '.join(f'recent_{k}' for k in _KINDS if k != 'live')})::bigint as recent_all from c", "media", "live_lectures"))(lambda t: dashboard.type_counts(_bag(t), F.expr("timestamp_ntz '1998-08-01 00:00:00'")))
query("recent_lectures", sql(f"with {_BAG} select user_id, position, key, input_type, created_at from (select *, row_number() over (partition by user_id order by created_at desc, key) as position from bag) where position <= 10", "media", "live_lectures"))(lambda t: dashboard.recent(_bag(t)))
query("live_counted_once", sql(
    "with bag as (select user_id, id::varchar as key, case when media_type = 'image' then 'images' else media_type end as input_type from media "
    "where media_type <> 'live' union all select user_id, session_id, 'live' from live_lectures) select user_id, input_type, count(*) as n from bag "
    "group by 1, 2",
"media", "live_lectures"))(lambda t: _bag(t, True).groupBy("user_id", "input_type").agg(F.count("*").alias("n")))
query("subject_distribution", sql(f"with {_SUBJECTS} select subject, count(*) as n from subjects group by 1", "details"))(lambda t: dashboard.subject_distribution(t.details()))
query("subject_share", sql(f"with {_SUBJECTS} select subject, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 6) as pct from subjects group by 1", "details"))(lambda t: dashboard.shares(dashboard.subject_distribution(t.details())))

# --- transcripts -------------------------------------------------------------------------------------------------

_WORDS = "len(list_filter(regexp_split_to_array({0}, '[ \\t\\r\\n]+'), lambda x: x <> ''))"
query("transcript_full_text", sql("select media_id, string_agg(text, ' ' order by segment_index) as full_text from segments group by 1", "segments"))(lambda t: library.transcripts(t.segments()))
query("transcript_stats", sql(f"select media_id, sum({_WORDS.format('text')})::bigint as word_count, count(*) as segment_count, max_by(end_time, segment_index) as duration_sec from segments group by 1", "segments"))(lambda t: library.transcript_stats(t.segments()))
query("transcript_view", sql(
    f"select m.id as media_id, user_id, batch_stem, word_count, segment_count, duration_sec, full_text from media m "
    f"join (select media_id, sum({_WORDS.format('text')})::bigint as word_count, count(*) as segment_count, max_by(end_time, segment_index) as duration_sec, "
    f"string_agg(text, ' ' order by segment_index) as full_text from segments group by 1) s on s.media_id = m.id where media_type in ('video', 'audio')",
"media", "segments"))(lambda t: library.transcript_view(t.media(), t.segments()))
query("segment_search", sql("select media_id, segment_index, start_time, text from segments where contains(lower(text), 'er')", "segments"))(lambda t: library.segment_search(t.segments(), "ER"))
query("note_line_search", sql("select media_id, array_to_string(list_filter(string_split(content, chr(10)), lambda x: contains(lower(x), 'status')), chr(10)) as content from notes", "notes"))(lambda t: library.note_lines(t.notes(), "STATUS"))
query("last_five_messages", "select conv_id, turn, role, text, from_end from (select *, row_number() over (partition by conv_id order by turn desc, role, text) as from_end from conversations) where from_end <= 5")(lambda t: library.last(t.raw("conversations"), ["conv_id"], "turn", 5, ["role", "text"]))
query("last_frames", sql("select media_id, frame_id, pos, concept, from_end from (select *, row_number() over (partition by media_id order by frame_id desc, pos, concept) as from_end from concepts) where from_end <= 20", "concepts"))(lambda t: library.last(t.concepts(), ["media_id"], "frame_id", 20, ["pos", "concept"]))
query("users_media", sql("select id, user_id, media_type from media where user_id in (1, 2, 3, 5, 8)", "media"))(lambda t: library.of_users(t.media(), [1, 2, 3, 5, 8]).select("id", "user_id", "media_type"))
query("cards_of_media", sql("select f.media_id, card_index, question from flashcards f where media_id in (select id from media where media_type = 'video')", "media", "flashcards"))(lambda t: library.of_media(t.flashcards(), t.media().where("media_type = 'video'")).select("media_id", "card_index", "question"))

# --- lectures ----------------------------------------------------------------------------------------------------

query("notable_slides", sql(
    "select media_id, frame_id, slide_title, position from (select *, row_number() over (partition by media_id order by frame_id) as position from frames "
    "where importance in ('high', 'medium') and (trim(coalesce(slide_title, '')) <> '' or len(key_concepts) > 0)) where position <= 35",
"frames"))(lambda t: lecture.notable(t.frames()).select("media_id", "frame_id", "slide_title", "position"))
query("meaningful_frames", sql("select media_id, frame_id from frames where importance <> 'low' or trim(coalesce(ocr_text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''", "frames"))(lambda t: lecture.meaningful(t.frames(), True).select("media_id", "frame_id"))
query("concept_timeline", sql(
    "with r as (select *, row_number() over (partition by media_id order by frame_id) - 1 as at_, count(*) over (partition by media_id) as of_ "
    "from frames), k as (select *, row_number() over (partition by media_id order by frame_id) as k from r "
    "where at_ % greatest(1, of_ // least(5, of_)) = 0), c as (select media_id, k, unnest(range(1, least(len(key_concepts), 2) + 1)) as pos, key_concepts "
    "from k where k <= 5), f as (select *, row_number() over (partition by media_id, lower(key_concepts[pos]) order by k, pos) as rn from c), "
    "o as (select media_id, row_number() over (partition by media_id order by k, pos) as position, key_concepts[pos] as concept from f where rn = 1) "
    "select * from o where position <= 6",
"frames"))(lambda t: lecture.timeline(t.frames()))
query("shuffled_cards", sql("select media_id, card_index, row_number() over (partition by media_id order by md5('deck|' || media_id || '|' || card_index), card_index) as position from flashcards", "flashcards"))(lambda t: lecture.shuffled(t.flashcards(), "deck").select("media_id", "card_index", "position"))
query("deck_progress", sql("select media_id, card_index, floor((card_index + 1) * 100 / count(*) over (partition by media_id) + 0.5)::int as pct from flashcards", "flashcards"))(lambda t: t.flashcards().join(media.counts(t.flashcards(), "n"), "media_id").select("media_id", "card_index", lecture.deck_progress(F.col("card_index") + 1, F.col("n")).alias("pct")))
query("normalised_segments", sql(
    "select media_id, segment_index, round(start_time, 3) as start_time, round(end_time, 3) as end_time, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text "
    "from segments where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''",
"segments"))(lambda t: lecture.normalised_segments(t.segments()))
_SLIDES = (
    "slides as (select media_id, string_agg(position || ':' || coalesce(slide_title, '') || ':' || array_to_string(key_concepts, ','), '|' "
    "order by position) as slides from (select *, row_number() over (partition by media_id order by frame_id) as position from frames "
    "where importance in ('high', 'medium') and (trim(coalesce(slide_title, '')) <> '' or len(key_concepts) > 0)) where position <= 35 group by 1)"
)
query("report_content", sql(
    f"with {_TITLED}, {_SLIDES}, tr as (select media_id, string_agg(text, ' ' order by segment_index) as full_text from segments group by 1) "
    f"select m.id as media_id, coalesce(lecture_title, batch_stem) as title, subject_area, slides, full_text from titled m left "
    f"join slides s on s.media_id = m.id left join tr on tr.media_id = m.id",
"media", "details", "frames", "segments"))(
    lambda t: lecture.report(media.titled(t.media(), t.details()), t.frames(), library.transcripts(t.segments())).withColumn("slides", F.array_join(F.transform("slides", lambda x: F.concat(x["position"].cast("string"), F.lit(":"), F.coalesce(x["slide_title"], F.lit("")), F.lit(":"), F.array_join(x["key_concepts"], ","))), "|"))
)

# --- text --------------------------------------------------------------------------------------------------------


def on_documents(name: str, made: Callable[[], dict], oracle: str | None) -> None:
    """A query that adds the columns made() to doc_id; oracle: SQL of the same columns over documents."""
    query(name, f"select doc_id, {oracle} from documents" if oracle else None)(lambda t: t.documents().select("doc_id", *(c.alias(n) for n, c in made().items())))


def _text():
    return F.col("text")


on_documents("document_stats", lambda: {"word_count": text.words(_text()), "char_count": F.length(_text()).cast("long")}, f"{_WORDS.format('text')}::bigint as word_count, length(text) as char_count")
on_documents("importance_class", lambda: {"importance": text.importance(_text())}, "case when length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) < 30 then 'low' when length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) < 50 then 'medium' else 'high' end as importance")
on_documents("title_case", lambda: {"title": text.title_of_text(_text())}, f"{_TITLE_SQL.format('text')} as title")
on_documents("token_budget", lambda: {"budget": text.token_budget(_text(), F.lit(2048))}, "greatest(64, least(2048, 4096 - length(text) // 4 - 64))::int as budget")
on_documents("prefix_truncation", lambda: {"text": text.truncated(_text())}, "case when length(text) > 800 then text[1:800] || ' [truncated]' else text end as text")
on_documents("middle_truncation", lambda: {"label": text.middle_cut(F.concat(F.col("source"), F.lit("_"), _text()))}, "case when length(source || '_' || text) > 40 then (source || '_' || text)[1:20] || '…' || right(text, 20) else source || '_' || text end as label")
on_documents("time_labels", lambda: {"clock": text.clock(F.col("n_chars")), "label": text.minutes_label(F.col("n_chars")), "rate": text.sampling_rate(F.col("n_chars"))}, 
    "printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) as clock, "
    "case when n_chars >= 60 then printf('%dm %ds', n_chars // 60, n_chars % 60) else printf('%ds', n_chars) end as label, "
    "case when n_chars > 2400 then 0.1::double when n_chars > 1200 then 0.2::double else 0.5::double end as rate"
)
on_documents("xml_escape", lambda: {"escaped": text.xml_escape(_text())}, "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped")
_LANGUAGE_SQL = "case trim(lower(lang)) " + " ".join(f"when '{c}' then 'Answer in {n}.' || chr(10) || chr(10) || 'Explain'" for c, n, _, _ in text.LANGUAGES if n != "English") + " else 'Explain' end"
on_documents("language_prefix", lambda: {"prompt": text.in_language(F.lit("Explain"), F.col("lang"))}, f"{_LANGUAGE_SQL} as prompt")
on_documents("headings", lambda: {"headings": F.array_join(text.headings(_text()), "|")}, 
    f"array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x[1] = '#' or (length(x) > 4 and upper(x) = x and lower(x) <> x and {_WORDS.format('x').replace('lambda x: x', 'lambda y: y')} <= 8))[1:20], lambda x: "
    f"case when x[1] = '#' then regexp_replace(x, '^#+[ \\t]*', '') else x end), '|') as headings"
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_CUT = "list_transform(range(0, length({0}), 1300), lambda k: substr({0}, (k + 1)::int, 1500))"
_CHUNKS = f"""plain as (select doc_id, trim(text, {_BLANKS}) as t from documents),
packed as (select doc_id, t, list_reduce(list_transform(list_filter(list_transform(string_split_regex(t, '\n[ \t\r\n]*\n'), lambda p: trim(p, {_BLANKS})), lambda p: p <> ''), lambda p: struct_pack(done := []::varchar[], held := p)), lambda acc, x: case
  when length(acc.held) + length(x.held) + 2 <= 1500 then struct_pack(done := acc.done, held := case when acc.held = '' then x.held else acc.held || chr(10) || chr(10) || x.held end)
  when acc.held <> '' then struct_pack(done := acc.done || [acc.held], held := right(acc.held, 200) || chr(10) || chr(10) || x.held)
  else struct_pack(done := acc.done || {_CUT.format('x.held')}, held := '') end, struct_pack(done := []::varchar[], held := '')) as p from plain),
chunked as (select doc_id, case when t = '' then [] when length(t) <= 1500 then [t] when p.held <> '' then p.done || [p.held] else p.done end as c from packed)"""


def _chunked(t: Tables) -> DataFrame:
    rows = t.documents().select("doc_id", text.chunks(_text()).alias("c"))
    strict = F.flatten(F.transform("c", lambda c: F.when(F.length(c) > 1500, F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(1300)), lambda i: F.substring(c, i + 1, F.lit(1500)))).otherwise(F.array(c))))
    return rows.select("doc_id", F.size("c").alias("chunks"), F.array_join("c", "|").alias("joined"), F.size(strict).alias("pieces"))


query("document_chunks", 
    f"with {_CHUNKS} select doc_id, len(c)::int as chunks, array_to_string(c, '|') as joined, len(flatten(list_transform(c, lambda x: "
    f"case when length(x) > 1500 then {_CUT.format('x')} else [x] end)))::int as pieces from chunked"
)(_chunked)
on_documents("paragraphs", lambda: {"paragraphs": F.array_join(text.paragraphs(_text()), "\n\n")}, rf"""array_to_string((select case when p.held <> '' then p.done || [p.held] else p.done end from (select list_reduce(list_transform(list_filter(string_split(regexp_replace(trim(text, {_BLANKS}), '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: struct_pack(done := []::varchar[], held := x)), lambda acc, x: case
  when acc.held = '' then struct_pack(done := acc.done, held := x.held)
  when length(acc.held) + length(x.held) < 700 then struct_pack(done := acc.done, held := acc.held || ' ' || x.held)
  else struct_pack(done := acc.done || [acc.held], held := x.held) end, struct_pack(done := []::varchar[], held := '')) as p))[1:15], chr(10) || chr(10)) as paragraphs""")
query("path_functions", sql("select id, regexp_replace(regexp_extract(storage_path, '([^/]*)$', 1), '\\.[^.]*$', '') as stem, " + _TITLE_SQL.format("translate(regexp_replace(regexp_extract(storage_path, '([^/]*)$', 1), '\\.[^.]*$', ''), '_-', '  ')") + " as title, regexp_replace(batch_stem, '^[^_]*_', '') as display from media", "media"))(lambda t: t.media().select("id", text.path_stem(F.col("storage_path")).alias("stem"), text.filename_title(F.col("storage_path")).alias("title"), text.display_name(F.col("batch_stem")).alias("display")))
query("grades", sql(
    "select user_id, media_id, accuracy_score, "
    "case when accuracy_score >= 90 then 'A' when accuracy_score >= 80 then 'B' when accuracy_score >= 70 then 'C' when accuracy_score >= 60 then 'D' else 'F' end as grade "
    "from quiz_sessions",
"quiz_sessions"))(lambda t: t.quiz_sessions().select("user_id", "media_id", "accuracy_score", text.grade(F.col("accuracy_score")).alias("grade")))
query("sample_points", sql("select media_id, unnest(list_transform([0.10, 0.25, 0.60, 0.85, 0.95], lambda p: round(p::double * max_end, 3))) as at_sec from (select media_id, max(end_time) as max_end from segments group by 1)", "segments"))(lambda t: t.segments().groupBy("media_id").agg(F.max("end_time").alias("e")).select("media_id", F.explode(text.sample_points(F.col("e"))).alias("at_sec")))
query("uniform_sample", sql(
    "select media_id, segment_index from (select *, count(*) over (partition by media_id) as n from segments) "
    "where n <= 10 or segment_index in (select unnest(list_transform(range(10), lambda i: i * n // 10)))",
"segments"))(lambda t: live.uniform_sample(t.segments(), ["media_id"], "segment_index").select("media_id", "segment_index"))


def _replies(t: Tables) -> DataFrame:
    """Replies with every misspelt key, three ways of options, and text around or a cut behind the object."""
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    n = F.col("media_id") + F.col("card_index")
    card = F.concat(F.lit('{"'), at(["questionimoine", "QUESTIN", "questoin", "question"], n), F.lit('": "'), F.col("question"), F.lit('"\n "'), at(["answr", "answeer", "answer"], n), F.lit('": "'), F.col("answer"), F.lit('",}'))
    options = at(['"optons": {"A": "1", "B": "2"}', '"options": ["1", "2", "3", "4"]', '"A": "1", "B": "2", "C": "3"'], n)
    asked = F.concat(F.lit('{"question": "Why?", '), options, F.lit(', "'), at(["correctanswer", "correct_answeer", "correct_answer"], n), F.lit('": "B", "'), at(["explnation", "explantion"], n), F.lit('": "so"}'))
    whole = F.concat(F.lit('{"flashcards": ['), card, F.lit('], "quiz": ['), asked, F.lit("]}"))
    wrapped = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("Here it is: "), whole, F.lit(" Good luck"))).when(n % 4 == 2, F.concat(F.substring(whole, 1, F.length(whole) - 1), F.lit(', {"question": "cut'))).otherwise(whole)
    return t.flashcards().select("media_id", "card_index", wrapped.alias("reply"))


query("json_replies", sql(
    "select media_id, card_index, 1 as cards, question, answer, 'medium' as difficulty, "
    "case (media_id + card_index) % 3 when 0 then 2 when 1 then 4 else 3 end as options, 'B' as correct, 'so' as explanation from flashcards",
"flashcards"))(
    lambda t: json_recovery.replies(_replies(t), keep=False).selectExpr("media_id", "card_index", "size(cards.flashcards) as cards", "cards.flashcards[0].question as question", "cards.flashcards[0].answer as answer", "cards.flashcards[0].difficulty as difficulty", "size(cards.quiz[0].options) as options", "cards.quiz[0].correct_answer as correct", "cards.quiz[0].explanation as explanation")
)

# --- deduplication -----------------------------------------------------------------------------------------------

_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"
_VECTOR_PAIRS = f"pairs as (select a.label as grp, a.vec_id as i, b.vec_id as j, {_COS} as sim from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where {_COS} >= 0.3)"
query("embedding_pairs", f'with {_VECTOR_PAIRS} select grp as "group", i, j, round(sim, 6) as sim from pairs')(lambda t: dedup.vector_pairs(t.embeddings(), 0.3).withColumn("sim", F.round("sim", 6)))
query("embedding_dedup", 
    f"with {_VECTOR_PAIRS}, near as (select label as grp, vec_id as id, coalesce((select list(i) from pairs p "
    f"where p.grp = e.label and p.j = e.vec_id), []) as ns from embeddings e), "
    f"scans as (select grp, list_reduce(list_transform(list(struct_pack(id := id, ns := ns) order by id), lambda x: [x.id] || x.ns), lambda acc, x: "
    f"case when list_has_any(acc, x[2:]) then acc else acc || [x[1]] end, []::bigint[]) as leaders from near group by 1) "
    f"select grp as \"group\", unnest(leaders) as leader from scans"
)(
    lambda t: dedup.vector_clusters(t.embeddings(), 0.3).select("group", "leader").distinct()
)


def _phrases(t: Tables) -> DataFrame:
    return t.raw("part").select((F.col("p_partkey") % 40).cast("long").alias("group"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))


_TFIDF = (
    "items as (select p_partkey % 40 as grp, p_partkey as id, lower(p_name || ' ' || p_type) as t from part), "
    "toks as (select grp, id, regexp_extract_all(t, '\\b\\w\\w+\\b') as w from items), tf as (select grp, id, term, count(*) as tf "
    "from (select grp, id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda k: w[k] || ' ' || w[k + 1])) as term from toks) "
    "group by 1, 2, 3), n as (select grp, count(*) as n from items group by 1), df as (select grp, term, count(*) as df from tf group by 1, 2), "
    "raw as (select tf.grp, id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df on df.grp = tf.grp and df.term = tf.term "
    "join n on n.grp = tf.grp), vec as (select grp, id, term, w / sqrt(sum(w * w) over (partition by grp, id)) as weight from raw)"
)
query("tfidf_weights", f'with {_TFIDF} select grp as "group", id, term, round(weight, 6) as weight from vec')(lambda t: dedup.tfidf(_phrases(t)).withColumn("weight", F.round("weight", 6)))
query("tfidf_pairs", 
    f'with {_TFIDF} select grp as "group", a.id as i, b.id as j, round(sum(a.weight * b.weight), 6) as sim from vec a join vec b using (grp, term) '
    f'where a.id < b.id group by 1, 2, 3 having sum(a.weight * b.weight) >= 0.5 - 1e-12'
)(lambda t: dedup.text_pairs(_phrases(t), 0.5).withColumn("sim", F.round("sim", 6)))


def _leaders_sql(least: float) -> str:
    """Members with their leaders, in SQL: a scan of each group in order."""
    return (
        f"pairs as (select grp, a.id as i, b.id as j from vec a join vec b using (grp, term) where a.id < b.id group by 1, 2, 3 "
        f"having sum(a.weight * b.weight) >= {least} - 1e-12), near as (select grp, id, text, coalesce((select list(i order by i) from pairs p "
        f"where p.grp = e.grp and p.j = e.id), []) as ns from (select p_partkey % 40 as grp, p_partkey as id, p_name || ' ' || p_type as text from part) e), "
        f"scans as (select grp, list_reduce(list_transform(list(struct_pack(id := id, ns := ns) order by id), lambda x: [x.id] || x.ns), lambda acc, x: "
        f"case when list_has_any(acc, x[2:]) then acc else acc || [x[1]] end, []::bigint[]) as leaders from near group by 1), told as (select grp, id, text, "
        f"case when list_contains(leaders, id) then id else list_min(list_intersect(leaders, ns)) end as leader from near join scans using (grp)), "
        f"shown as (select grp, leader as id, text from (select *, row_number() over (partition by grp, leader order by length(text) desc, id) as rn from told) "
        f"where rn = 1)"
    )


query("tfidf_dedup", f'with {_TFIDF}, {_leaders_sql(0.85)} select grp as "group", id, text from shown')(lambda t: dedup.concepts(_phrases(t)))
query("formula_dedup", f'with {_TFIDF}, {_leaders_sql(0.92)} select grp as "group", id, text from shown')(lambda t: dedup.formulas(_phrases(t)))
query("loose_dedup", f'with {_TFIDF}, {_leaders_sql(0.5)} select grp as "group", id, text from shown')(lambda t: dedup.concepts(_phrases(t), 0.5))
query("definition_dedup", 
    f"with {_TFIDF}, {_leaders_sql(0.88)} select grp as \"group\", id, text, (select arg_min('d' || p_partkey, p_partkey) from part "
    f"where p_partkey % 40 = grp and p_name || ' ' || p_type = text) as definition from shown"
)(lambda t: dedup.definitions(_phrases(t).withColumn("definition", F.concat(F.lit("d"), "id"))).select("group", "id", "text", "definition"))
query("first_formulas", 
    "select grp as \"group\", id, t as text from (select p_partkey % 7 as grp, p_partkey as id, "
    "case when p_partkey % 2 = 0 then upper(p_brand) else p_brand end as t, row_number() over (partition by p_partkey % 7, "
    "case when p_partkey % 2 = 0 then upper(p_brand) else p_brand end order by p_partkey) as rn from part) where rn = 1"
)(lambda t: dedup.first_formulas(t.raw("part").select((F.col("p_partkey") % 7).alias("group"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("text"))))
query("exact_dedup", 
    "select grp as \"group\", id, t as text from (select p_partkey % 7 as grp, p_partkey as id, p_brand as t, "
    "row_number() over (partition by p_partkey % 7, lower(p_brand) order by p_partkey) as rn from part) where rn = 1"
)(lambda t: dedup.exact(t.raw("part").select((F.col("p_partkey") % 7).alias("group"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("text"))))

# --- concept graph -----------------------------------------------------------------------------------------------

_EDGES = (
    "one as (select distinct media_id, frame_id, concept from concepts), edges as (select x.media_id, x.concept as a, y.concept as b, count(*) as weight "
    "from one x join one y on x.media_id = y.media_id and x.frame_id = y.frame_id and x.concept < y.concept group by 1, 2, 3)"
)
_DEGREES = (
    f"{_EDGES}, freqs as (select media_id, concept as node, count(*) as freq, min(row(frame_id, pos, concept)) as first from concepts group by 1, 2), "
    f"deg as (select media_id, node, count(*) as degree from (select media_id, unnest([a, b]) as node from edges) group by 1, 2), nd as (select f.*, "
    f"coalesce(degree, 0) as degree from freqs f left join deg d using (media_id, node))"
)
_PRUNED = f"{_DEGREES}, kept as (select * from (select *, row_number() over (partition by media_id order by degree desc, first) as position from nd) where position <= 80)"


def _edges(t: Tables) -> DataFrame:
    return graph.cooccurrence(t.concepts())


query("concept_frequency", sql("select media_id, concept, count(*) as freq from concepts group by 1, 2", "concepts"))(lambda t: graph.frequency(t.concepts()).drop("first"))
query("cooccurrence_edges", sql(f"with {_EDGES} select * from edges", "concepts"))(_edges)
query("heavy_edges", sql(f"with {_EDGES} select * from edges where weight >= 3", "concepts"))(lambda t: graph.cooccurrence(t.concepts(), 3))
query("graph_degree", sql(f"with {_DEGREES} select * from deg", "concepts"))(lambda t: graph.degrees(_edges(t)))
query("graph_pruned", sql(f"with {_PRUNED} select media_id, node, freq, degree, position from kept", "concepts"))(lambda t: graph.pruned(t.concepts(), _edges(t)))
query("graph_links", sql(
    f"with {_PRUNED} select e.media_id, x.position - 1 as source, y.position - 1 as target, 'co_occurs' as relation, weight from edges e "
    f"join kept x on x.media_id = e.media_id and x.node = a join kept y on y.media_id = e.media_id and y.node = b",
"concepts"))(lambda t: graph.exported(graph.pruned(t.concepts(), _edges(t)), _edges(t)))
query("top_central", sql(
    f"with {_DEGREES} select media_id, position, node, freq, centrality from (select *, row_number() over (partition by media_id "
    f"order by centrality desc, freq desc, node) as position "
    f"from (select *, round(degree / greatest(count(*) over (partition by media_id) - 1, 1), 6) as centrality from nd)) where position <= 10",
"concepts"))(lambda t: graph.central(t.concepts(), _edges(t)))
query("graph_nodes", sql((
    "with d as (select media_id, concept as term from concepts where pos = 1 group by 1, 2), f as (select media_id, concept, count(*) as freq "
    "from concepts group by 1, 2) select media_id, concept as node, "
) + _TITLE_SQL.format("concept") + (
    " as label, 'concept' as type, freq from f union all select media_id, 'def:' || term, 'is ' || term, 'definition', 1 from d union all "
    "select distinct media_id, '__lecture__', 'L' || media_id, 'lecture', 1 from concepts"
), "concepts"))(
    lambda t: graph.nodes(t.concepts(), t.concepts().where("pos = 1").select("media_id", F.col("concept").alias("term"), F.concat(F.lit("is "), "concept").alias("definition")).distinct(), t.concepts().select("media_id", F.concat(F.lit("L"), "media_id").alias("title")).distinct())
)
query("graph_covers", sql("select distinct media_id, '__lecture__' as a, concept as b, 1 as weight from concepts where pos = 2", "concepts"))(lambda t: graph.covers(t.concepts().where("pos = 2").select("media_id", F.upper("concept").alias("topic")), graph.nodes(t.concepts())))
query("graph_defines", sql("select distinct media_id, concept as a, 'def:' || concept as b, 1 as weight from concepts where pos = 1", "concepts"))(lambda t: graph.defines(t.concepts().where("pos = 1").select("media_id", F.col("concept").alias("term")), graph.nodes(t.concepts())))

def _report_frames(t: Tables) -> DataFrame:
    """Frames with definitions and formulas made of their words; a formula often comes again."""
    f, k = t.frames(), F.col("key_concepts")
    term = F.struct(F.get(k, 0).alias("term"), F.get(k, 1).alias("definition"))
    return f.withColumns({"definitions": F.when(F.size(k) > 1, F.array(term)).otherwise(F.array().cast("array<struct<term:string,definition:string>>")), "formulas": F.when(F.col("frame_id") % 3 == 0, F.array(F.lit(" "), F.concat(F.get(k, 0), F.lit(" = "), F.col("frame_id") % 5)))})


def _report_lines(t: Tables) -> DataFrame:
    frames = _report_frames(t)
    summaries = frames.groupBy("media_id").agg(F.max("slide_title").alias("summary"), F.array(F.min("importance"), F.max("importance")).alias("main_topics"), F.array(F.count("*").cast("string")).alias("learning_outcomes"), F.array().cast("array<string>").alias("suggested_reading"))
    cards = t.flashcards().withColumns({"topic": F.when(F.col("card_index") > 0, F.col("answer")), "difficulty": F.lit("medium")})
    return lecture.report_lines(summaries, frames, library.transcripts(t.segments()), cards)


_PACKED = (
    "list_reduce(list_transform(list_filter(regexp_split_to_array(regexp_replace(trim(full_text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(0), 'g'), chr(0)), lambda x: x <> ''), lambda x: [x]), lambda acc, x: "
    "case when length(acc[-1]) + length(x[1]) < 700 then acc[:-2] || [acc[-1] || ' ' || x[1]] else acc || x end)[1:15]"
)
query("report_lines", sql(f"""
with f as (
  select media_id, frame_id, slide_title, key_concepts, importance, case when frame_id % 3 = 0 then key_concepts[1] || ' = ' || frame_id % 5 end as formula
  from frames),
sums as (select media_id, max(slide_title) as summary, min(importance) as a, max(importance) as b, count(*) as n from f group by 1),
forms as (
  select media_id, formula, row_number() over (partition by media_id order by min(frame_id)) as position
  from (select media_id, frame_id, trim(formula) as formula from f where trim(formula) <> '') group by media_id, formula),
shift as (select media_id, 3 + (media_id in (select media_id from forms))::int as s from sums),
defs as (
  select media_id, term, definition, row_number() over (partition by media_id order by frame_id) as position
  from (select *, row_number() over (partition by media_id, lower(term) order by frame_id) as rn
        from (select media_id, frame_id, trim(key_concepts[1]) as term, trim(key_concepts[2]) as definition from f where len(key_concepts) > 1) where term <> '')
  where rn = 1),
slides as (
  select * from (select *, row_number() over (partition by media_id order by frame_id) as position from f
                 where importance in ('high', 'medium') and (trim(coalesce(slide_title, '')) <> '' or len(key_concepts) > 0))
  where position <= 35),
tr as (select media_id, string_agg(text, ' ' order by segment_index) as full_text from segments group by 1),
paras as (select media_id, full_text, {_PACKED} as p from tr where trim(full_text) <> ''),
cards as (select *, row_number() over (partition by media_id order by card_index) as k from flashcards),
all_lines as (
  select media_id, 1 as section, 'overview' as part, 1 as position, null as head, summary as body from sums where trim(coalesce(summary, '')) <> ''
  union all select media_id, 1, 'topics', 1, null, a from sums
  union all select media_id, 1, 'topics', 2, null, b from sums
  union all select media_id, 1, 'outcomes', 1, null, n::varchar from sums
  union all select media_id, 2, 'definitions', position, term, definition from defs
  union all select media_id, 3, 'formulas', position, null, formula from forms
  union all select media_id, 0, 'slides', position, case when trim(coalesce(slide_title, '')) <> '' then slide_title else 'Frame ' || frame_id end, array_to_string(key_concepts, ', ') from slides
  union all select media_id, 1, 'transcript', unnest(range(1, len(p) + 1)), null, unnest(p) from paras
  union all select media_id, 1, 'continues', 1, null, null from paras where length(full_text) > 10000
  union all select media_id, 2, 'cards', k, case when card_index > 0 then answer || ' | ' else '' end || 'medium', 'Q' || k || ': ' || question || chr(10) || 'A: ' || answer from cards)
select media_id, (section + case when part in ('slides', 'transcript', 'continues', 'cards') then s else 0 end)::int as section, part, position::bigint as position, head, body
from all_lines join shift using (media_id)""", "frames", "segments", "flashcards"))(_report_lines)


def _image_notes(t: Tables) -> DataFrame:
    """Notes of frames as images of a batch, in order."""
    f = t.frames()
    summaries = f.groupBy("media_id").agg(F.max("slide_title").alias("summary"), F.array(F.min("importance"), F.max("importance")).alias("main_topics"), F.array().cast("array<string>").alias("key_concepts"), F.concat(F.lit("Batch "), F.count("*").cast("string")).alias("lecture_title"))
    images = f.select("media_id", F.col("frame_id").alias("batch_index"), F.col("slide_title").alias("image_title"), F.concat("frame_id", F.lit(".png")).alias("filename"), F.when(F.col("frame_id") % 2 == 0, F.col("ocr_text")).alias("description"), F.when(F.col("frame_id") % 5 > 0, F.col("key_concepts")).alias("bullet_points"), F.when(F.col("frame_id") % 7 > 0, F.col("importance")).otherwise("low").alias("importance"))
    return lecture.image_notes(summaries, images)


query("image_notes", sql("""
with shown as (
  select media_id, string_agg(
    '### ' || coalesce(slide_title, frame_id || '.png') || chr(10)
    || case when frame_id % 2 = 0 and trim(ocr_text, ' ' || chr(9) || chr(10) || chr(13)) <> '' then ocr_text || chr(10) else '' end
    || case when frame_id % 5 > 0 then array_to_string(list_transform(key_concepts, lambda x: '- ' || x || chr(10)), '') else '' end, chr(10) order by frame_id) as body
  from frames where frame_id % 7 > 0 and importance <> 'low' group by 1)
select media_id,
       '# Study Notes: Batch ' || count(*) || chr(10) || chr(10)
       || case when trim(coalesce(max(slide_title), '')) <> '' then '## Overview' || chr(10) || chr(10) || max(slide_title) || chr(10) || chr(10) else '' end
       || '## Topics' || chr(10) || chr(10) || '- ' || min(importance) || chr(10) || '- ' || max(importance) || chr(10) || chr(10)
       || '## Image Analyses' || chr(10) || coalesce(chr(10) || any_value(body), '') as content
from frames left join shown using (media_id) group by media_id""", "frames"))(_image_notes)


def _searched(t: Tables) -> DataFrame:
    """Segments by an index of their trigrams."""
    rows = t.segments().withColumn("id", F.concat_ws("-", "media_id", "segment_index"))
    path = new_path(t.spark, "trigrams")
    search.write_index(rows, path)
    return search.search(rows, path, "ING Th").select("media_id", "segment_index", "text")


query("indexed_search", sql("select media_id, segment_index, text from segments where contains(lower(text), 'ing th')", "segments"))(_searched)

#: Codes as users write them, all of the table and two that aren't in it.
_CODES = [c for c, _, _, _ in text.LANGUAGES] + ["xx", ""]


def _code():
    return F.element_at(F.array(*map(F.lit, _CODES)), (F.col("doc_id") % len(_CODES) + 1).cast("int"))


on_documents(
    "language_table",
    lambda: {"code": _code(), "name": text.language(F.concat(F.lit(" "), F.upper(_code()))), "ocr": F.array_join(text.ocr_langs(_code()), "+"), "rtl": text.right_to_left(_code())},
    f"{_CODES!r}[(doc_id % {len(_CODES)} + 1)::int] as code, "
    + ", ".join(
        f"case {_CODES!r}[(doc_id % {len(_CODES)} + 1)::int] " + " ".join(f"when '{row[0]}' then {value(row)}" for row in text.LANGUAGES) + f" else {value(text.LANGUAGES[0])} end as {name}"
        for name, value in (("name", lambda r: f"'{r[1]}'"), ("ocr", lambda r: f"'{'+'.join(r[2])}'"), ("rtl", lambda r: str(r[3]).lower()))
    ),
)
on_documents(
    "ocr_texts",  # recognised parts of a text, some of them blank or missing
    lambda: {"text": text.ocr_text(F.transform(F.split(_text(), " "), lambda x: F.when(F.length(x) == 3, F.lit(None).cast("string")).when(F.length(x) == 2, "").otherwise(x)))},
    "trim(array_to_string(list_filter(string_split(text, ' '), lambda x: length(x) not in (0, 2, 3)), ' '), ' ' || chr(9) || chr(10) || chr(13)) as text",
)


def _decoded(t: Tables) -> DataFrame:
    """Texts as files in Latin-1 where it has all their characters, with a mark in UTF-8 elsewhere."""
    latin = ~F.col("text").rlike("[^\\x00-\\xFF]") & (F.col("doc_id") % 3 > 0)
    marked = F.concat(F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b"")), F.encode("text", "UTF-8"))
    rows = t.documents().where("text is not null").select(F.concat(F.col("doc_id"), F.lit(".txt")).alias("path"), F.when(latin, F.encode(F.regexp_replace("text", "[^\\x00-\\xFF]", ""), "ISO-8859-1")).otherwise(marked).alias("content"))
    return files.pages(rows).select("path", "page_num", "text")


query("decoded_texts", "select doc_id || '.txt' as path, 1 as page_num, text from documents where text is not null")(_decoded)

# --- live sessions -----------------------------------------------------------------------------------------------

_LIVE = "segs as (select 's' || conv_id as session_id, (turn % 4)::int as chunk_index, turn::int as id, (turn // 2)::double as start, (turn // 2 + 1)::double as \"end\", text from conversations)"


def _live(t: Tables) -> DataFrame:
    return t.raw("conversations").select(F.concat(F.lit("s"), "conv_id").alias("session_id"), (F.col("turn") % 4).cast("int").alias("chunk_index"), F.col("turn").cast("int").alias("id"), F.floor(F.col("turn") / 2).cast("double").alias("start"), (F.floor(F.col("turn") / 2) + 1).cast("double").alias("end"), "text")


query("live_segments_dedup", 
    f"with {_LIVE}, s as (select session_id, start + chunk_index * 15 as start, \"end\" + chunk_index * 15 as \"end\", id, text from segs) "
    f"select session_id, start, \"end\", id, text from (select *, row_number() over (partition by session_id, start order by id, text) as rn from s) "
    f"where rn = 1"
)(lambda t: live.deduped(live.shifted(_live(t))))
query("session_counters", f"with {_LIVE} select session_id, count(*) as segments, sum({_WORDS.format('text')})::bigint as words, sum({_WORDS.format('text')}) < 5 as too_short from segs group by 1")(lambda t: live.counters(_live(t)))
query("chunk_stitch", 
    f"with {_LIVE}, c as (select *, row_number() over (partition by session_id, chunk_index order by id, text) as k from segs), "
    f"n as (select session_id, chunk_index, count(*) as n from c group by 1, 2), o as (select *, coalesce(sum(n) over (partition by session_id "
    f"order by chunk_index rows between unbounded preceding and 1 preceding), 0) as before from n) "
    f"select c.session_id, c.chunk_index, (before + k - 1)::bigint as id, start + c.chunk_index * 300 as start, text from c "
    f"join o on o.session_id = c.session_id and o.chunk_index = c.chunk_index"
)(lambda t: live.stitched(_live(t)))

query("live_sessions", sql("select user_id, session_id, title, state, started_at, row_number() over (partition by user_id order by started_at desc, session_id) as position from live_lectures", "live_lectures"))(lambda t: live.sessions(t.live_lectures()).select("user_id", "session_id", "title", "state", "started_at", "position"))
query("final_pass", 
    f"with {_LIVE}, b as (select session_id, start, \"end\", id, text, 0 as src from segs where chunk_index = 0 union all "
    f"select session_id, start, \"end\", id, 'full', 1 from segs) select session_id, start, \"end\", id, text from (select *, "
    f"row_number() over (partition by session_id, start order by src, id, text) as rn from b) where rn = 1"
)(lambda t: live.final_pass(_live(t).where("chunk_index = 0"), _live(t).withColumn("text", F.lit("full"))))
query("stream_rounds", sql("select media_id as stream, frame_id::double as at, row_number() over (partition by media_id order by frame_id) - 1 as round from (select distinct media_id, frame_id from concepts)", "concepts"))(lambda t: live.round_robin(t.concepts().select(F.col("media_id").alias("stream"), F.col("frame_id").cast("double").alias("at")).distinct()))
_STEP_STATES, _STEP_EVENTS = ["created", "recording", "stopped", "processing", "done", "error", "cancelled"], ["start", "stop", "end", "finish", "fail", "cancel"]


def _steps(t: Tables) -> DataFrame:
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    e = t.raw("events").select("event_id", at(_STEP_STATES, F.col("event_id")).alias("before"), at(_STEP_EVENTS, F.floor(F.col("event_id") / 7)).alias("event"))
    return e.withColumn("s", live.transition(F.col("before"), F.col("event"))).select("event_id", "before", "event", F.col("s.state").alias("after"), F.col("s.allowed").alias("allowed"))


query("session_steps", 
    f"with e as (select event_id, {_STEP_STATES!r}[(event_id % 7 + 1)::int] as before, {_STEP_EVENTS!r}[((event_id // 7) % 6 + 1)::int] as event "
    f"from events), n as (select *, "
    f"case when event = 'start' and before = 'created' then 'recording' when event = 'stop' and before = 'recording' then 'stopped' when event = 'end' and before in ('created', 'recording', 'stopped') then 'processing' when event = 'finish' and before = 'processing' then 'done' when event = 'fail' and before in ('created', 'recording', 'stopped', 'processing') then 'error' when event = 'cancel' and before in ('created', 'recording', 'stopped', 'error') then 'cancelled' end as nxt "
    f"from e) select event_id, before, event, coalesce(nxt, before) as after, nxt is not null as allowed from n"
)(_steps)



def _pictures(t: Tables) -> DataFrame:
    """Frames of real vectors: four in a row are one picture, mixed with ever more of their own vector; 100 make a stream."""
    e = t.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("own"))
    base = e.select((F.col("vec_id")).alias("first"), F.col("own").alias("base"))
    mixed = F.zip_with("base", "own", lambda b, o: b + (F.col("vec_id") % 4) * 0.17 * o)
    rows = e.withColumn("first", F.col("vec_id") - F.col("vec_id") % 4).join(base, "first").withColumn("v", mixed)
    return rows.select(F.floor(F.col("vec_id") / 100).alias("stream"), (F.col("vec_id") % 100 * 0.75).alias("at"), F.slice("v", 1, 32).alias("histogram"), F.transform(F.slice("v", 33, 32), lambda x: x * 100 + 100).alias("pixels"))


#: The fold over each stream, frame by frame.
_FOLD = """
with recursive e as (select vec_id, embedding::double[] as own from embeddings),
mixed as (
  select a.vec_id, list_transform(range(1, len(b.own) + 1), lambda k: b.own[k] + (a.vec_id % 4) * 0.17::double * a.own[k]) as v
  from e a join e b on b.vec_id = a.vec_id - a.vec_id % 4),
frames as (
  select vec_id // 100 as stream, (vec_id % 100) * 0.75::double as pos, v[1:32] as h, list_transform(v[33:64], lambda x: x * 100 + 100) as p,
         row_number() over (partition by vec_id // 100 order by vec_id) as n
  from mixed),
fold as (
  select stream, n, pos as last_at, h as last_h, p as last_p, true as accepted from frames where n = 1
  union all
  select stream, n, case when new then pos else last_at end, case when new then h else last_h end, case when new then p else last_p end, new
  from (
    select *, pos - last_at >= 1 and (corr < 0.92 or ssim < 0.85) as new
    from (
      select f.*, last_at, last_h, last_p,
             (list_dot_product(h, last_h) / 32 - list_avg(h) * list_avg(last_h))
               / sqrt((list_dot_product(h, h) / 32 - list_avg(h) ** 2) * (list_dot_product(last_h, last_h) / 32 - list_avg(last_h) ** 2)) as corr,
             (2 * list_avg(p) * list_avg(last_p) + 6.5025) * (2 * (list_dot_product(p, last_p) / 32 - list_avg(p) * list_avg(last_p)) + 58.5225)
               / ((list_avg(p) ** 2 + list_avg(last_p) ** 2 + 6.5025)
                  * (list_dot_product(p, p) / 32 - list_avg(p) ** 2 + list_dot_product(last_p, last_p) / 32 - list_avg(last_p) ** 2 + 58.5225)) as ssim
      from fold l join frames f on f.stream = l.stream and f.n = l.n + 1)))
"""
_SLIDE_STATS = (
    "select stream, count(*) as seen, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as skipped, 100.0::double * count(*) filter (not accepted) / count(*) as skipped_pct "
    "from fold group by 1"
)


query("slide_stats", _FOLD + _SLIDE_STATS)(lambda t: live.slide_stats(_pictures(t), slides.slide_changes(_pictures(t))))


def _arriving(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    """The rows as files in no order, of which a stream takes a third at a time; arrived is the time of the file."""
    path, files = new_path(t.spark, name), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(path)
    return stream.withColumn("arrived", F.col("_metadata.file_modification_time"))


def _ended(t: Tables, rows: DataFrame, mode: str) -> DataFrame:
    """What a stream with keyed state gives, and the batch that gave it, after all input."""
    out, state = new_path(t.spark, "stream-out"), new_path(t.spark, "stream-state")
    with sessions.keyed_state(t.spark):
        stream = rows.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        stream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


_EVENT_OF = {"click": "start", "view": "stop", "purchase": "end", "signup": "finish", "error": "fail"}


def _session_events(t: Tables) -> DataFrame:
    """A user's events, twelve to a session."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kinds = F.create_map(*(F.lit(x) for pair in _EVENT_OF.items() for x in pair))
    e = t.raw("events").withColumn("at", at)
    event = F.when(F.col("event_id") % 9 == 0, "cancel").otherwise(kinds[F.col("event_type")])
    return e.select(F.concat("user_id", F.lit("-"), F.floor(F.col("at") / 12)).alias("session_id"), (F.col("at") % 12 + 1).cast("long").alias("seq"), event.alias("event"))


def _machine(t: Tables) -> DataFrame:
    """Events that arrive in no order, some of them twice."""
    e = _session_events(t)
    rows = _arriving(t, e.withColumn("copy", F.lit(0)).unionByName(e.where("seq % 5 = 0").withColumn("copy", F.lit(1))), "session-events")
    return _ended(t, sessions.machine(rows), "append").select("session_id", "seq", "state", "allowed")


#: A fold over each session's events, one by one.
query("session_machine", f"""
with recursive ev as (
  select user_id || '-' || (k // 12) as session_id, k % 12 + 1 as seq,
         case when event_id % 9 = 0 then 'cancel' {' '.join(f"when event_type = '{k}' then '{v}'" for k, v in _EVENT_OF.items())} end as event
  from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events)),
fold as (
  select session_id, 0::bigint as seq, 'created' as state, true as allowed from ev where seq = 1
  union all
  select session_id, seq, coalesce(nxt, state), nxt is not null
  from (
    select e.session_id, e.seq, f.state,
           case when event = 'start' and state = 'created' then 'recording'
                when event = 'stop' and state = 'recording' then 'stopped'
                when event = 'end' and state in ('created', 'recording', 'stopped') then 'processing'
                when event = 'finish' and state = 'processing' then 'done'
                when event = 'fail' and state in ('created', 'recording', 'stopped', 'processing') then 'error'
                when event = 'cancel' and state in ('created', 'recording', 'stopped', 'error') then 'cancelled' end as nxt
    from fold f join ev e on e.session_id = f.session_id and e.seq = f.seq + 1))
select session_id, seq, state, allowed from fold where seq > 0""")(_machine)


def _transcripts(t: Tables) -> DataFrame:
    """Chunks that arrive in no order, some twice; every second session has a final pass, every tenth is cancelled."""
    segs = live.shifted(_live(t)).withColumns({"full": F.lit(False), "cancelled": F.lit(False)})
    number = F.substring("session_id", 2, 20).cast("long")
    full = segs.where(number % 2 == 0).withColumns({"full": F.lit(True), "chunk_index": F.lit(0), "start": F.col("id") * 2.0, "end": F.col("id") * 2.0 + 1, "text": F.concat(F.lit(" full "), "id", F.lit("\n"))})
    gone = segs.where((number % 10 == 9) & (F.col("id") == 0)).withColumns({"cancelled": F.lit(True), "text": F.lit(None).cast("string")})
    rows = segs.unionByName(segs.where("id % 3 = 0")).unionByName(full).unionByName(gone)
    out = _ended(t, sessions.transcripts(_arriving(t, rows, "segments")), "update")
    return out.groupBy("session_id").agg(F.max_by(F.struct("segments", "words", "newest_chunk", "final", "cancelled", "text"), "batch").alias("s")).select("session_id", "s.*")


query("live_transcripts", f"""
with {_LIVE}, gone as (select session_id from segs where session_id[2:]::bigint % 10 = 9 and id = 0),
every as (
  select session_id, chunk_index, start + chunk_index * 15 as start, id, text, false as is_full from segs
  union all
  select session_id, 0, id * 2.0::double, id, ' full ' || id || chr(10), true from segs where session_id[2:]::bigint % 2 = 0),
kept as (select * from every where session_id not in (from gone)),
firsts as (select *, row_number() over (partition by session_id, start order by is_full, id, text) as rn from kept),
told as (
  select session_id, count(*) as segments, string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), ' ' order by start) as text
  from firsts where rn = 1 group by 1),
seen as (select session_id, max(case when is_full then -1 else chunk_index end) as newest_chunk, bool_or(is_full) as final from kept group by 1)
select session_id, segments, len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))::bigint as words, newest_chunk, final, false as cancelled, text
from told join seen using (session_id)
union all
select session_id, 0, 0, -1, false, true, '' from gone""")(_transcripts)


def _streamed(t: Tables) -> DataFrame:
    """The segments as files that a stream takes until they are used up."""
    there, out, state = (new_path(t.spark, n) for n in ("arrived", "streamed", "stream-state"))
    _live(t).write.json(there)
    live.write_transcripts(live.source(t.spark, there), out, state, once=True).awaitTermination()
    return t.spark.read.parquet(out).select("session_id", "start")


query("stream_segments", f"with {_LIVE} select distinct session_id, start + chunk_index * 15 as start from segs")(_streamed)


def _stream_counts(t: Tables) -> DataFrame:
    there, out, state = (new_path(t.spark, n) for n in ("arrived", "counted", "stream-state"))
    _live(t).write.json(there)
    live.write_counters(live.source(t.spark, there), out, state, once=True).awaitTermination()
    return live.counted(t.spark, out)


query("stream_counters", f"with {_LIVE} select session_id, count(*) as segments, sum({_WORDS.format('text')})::bigint as words, sum({_WORDS.format('text')}) < 5 as too_short from segs group by 1")(_stream_counts)

# --- sources, sinks and models -----------------------------------------------------------------------------------

_ENDINGS = ["mp4", "WMV", "flv", "m4v", "tiff", "tif", "aac", "wma", "doc", "ppt", "md", "exe", "pdf", "webp"]
_FILES = ["_study_notes.md", "_academic_report.pdf", "_flashcards.json", "_quiz.json", "_knowledge_graph.json", "_progress.json", "/frames_index.json", ".mp4", "_notes.md"]
_LISTED = (
    f"files as (select 'out/' || batch_stem || {_FILES!r}[(id % 9 + 1)::int] as path, batch_stem as stem, (['notes', 'report', 'flashcards', 'quiz', 'graph', 'progress', 'frames'])[(id % 9 + 1)::int] as artifact, uploaded_at as t "
    f"from media), listed as (select * from files where artifact is not null)"
)


def _listed(t: Tables) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("id") % 9 + 1).cast("int"))
    return files.listed(t.media().select(F.concat(F.lit("out/"), "batch_stem", names).alias("path"), F.col("uploaded_at").alias("modificationTime")))


def _user_answers(t: Tables) -> DataFrame:
    """A row a user with all answers in order, as the progress artifact holds them."""
    answer = F.struct("event_id", F.col("value").alias("score"), (F.col("value") > 50).alias("correct"))
    return t.raw("events").groupBy(F.concat(F.lit("user "), "user_id").alias("stem")).agg(F.array_sort(F.collect_list(answer)).alias("answers"))


def _progress_files(t: Tables) -> DataFrame:
    """Written as one file a user, and read from the files."""
    path, shards = new_path(t.spark, "artifacts"), 16
    files.write_json(_user_answers(t), path, "progress", shards=shards)
    found = files.read_json(t.spark, path, "progress", "answers array<struct<event_id:long,score:double,correct:boolean>>", shards)
    return found.select("stem", F.explode("answers").alias("a")).select("stem", "a.*")


query("progress_files", "select 'user ' || user_id as stem, event_id, value as score, value > 50 as correct from events")(_progress_files)


def _transcript_listing(t: Tables) -> DataFrame:
    """Transcripts of sessions as text and JSON files; the listing of the text files, which reads none."""
    path, shards = new_path(t.spark, "artifacts"), 16
    parts = F.array_sort(F.collect_list(F.struct("id", "text")))
    texts = _live(t).groupBy(F.col("session_id").alias("stem")).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("full_text"), F.count("*").alias("segments"))
    files.write_transcript_files(texts, path, shards)
    found = artifacts.read_artifacts(t.spark, path, shards, contents=False).where("artifact = 'transcript_txt'")
    return found.select("stem", "artifact", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


query("transcript_files", 
    f"with {_LIVE} select session_id as stem, 'transcript_txt' as artifact, session_id || '_transcript.txt' as name, strlen(string_agg(text, chr(10) "
    f"order by id, text))::bigint as length from segs group by 1"
)(_transcript_listing)


def _uploads(t: Tables) -> DataFrame:
    name = F.concat(F.lit("up/"), F.col("id"), F.lit("."), F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("id") % len(_ENDINGS) + 1).cast("int")))
    return t.media().select("id", *(files.uploadable(name, k).alias(k) for k in ("video", "image", "audio", "document")))


query("upload_kinds", sql(
    f"select id, e in ('mp4', 'avi', 'mov', 'mkv', 'wmv', 'flv', 'webm', 'm4v') as video, e in ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'tif', 'webp') as image, e in ('wav', 'mp3', 'm4a', 'flac', 'ogg', 'aac', 'wma') as audio, e in ('pdf', 'doc', 'docx', 'ppt', 'pptx', 'txt') as document "
    f"from (select id, lower({_ENDINGS!r}[(id % {len(_ENDINGS)} + 1)::int]) as e from media)",
"media"))(_uploads)
query("artifact_list", sql(f"with {_LISTED} select stem, artifact, path, t as \"modificationTime\" from listed", "media"))(_listed)
query("artifact_readiness", sql(f"with {_LISTED} select stem, " + ", ".join(f"bool_or(artifact = '{k}') as {k}_ready" for k in ("notes", "report", "flashcards", "quiz", "graph", "progress", "frames")) + ", max(t) as updated_at from listed group by 1", "media"))(lambda t: files.readiness(_listed(t)))
query("artifact_stems", sql(f"with {_LISTED} select distinct stem from listed where artifact <> 'progress'", "media"))(lambda t: files.stems(_listed(t)))
query("document_texts", 
    f"with p as (select conv_id::varchar || '/my_talk-' || conv_id || '.pdf' as path, turn + 1 as n, text from conversations where turn + 1 <= 40), "
    f"w as (select path, string_agg(text, chr(10) || chr(10) order by n, text) as whole from p group by 1), "
    f"c as (select path, whole[1:5000] as text, length(whole) > 5000 as cut from w) "
    f"select path, 'My Talk ' || split_part(path, '/', 1) as title, text, {_WORDS.format('text')}::bigint as word_count, length(text) as char_count, "
    f"case when cut then '[Text truncated to 5,000 chars]' end as error from c"
)(
    lambda t: files.documents(files.first_pages(t.raw("conversations").select(F.concat(F.col("conv_id"), F.lit("/my_talk-"), F.col("conv_id"), F.lit(".pdf")).alias("path"), (F.col("turn") + 1).cast("int").alias("page_num"), "text", F.lit(None).cast("string").alias("error"))), 5000)
)
on_documents("page_texts", lambda: {"text": text.page_text(F.substring(_text(), F.lit(1), (F.col("doc_id") % 80).cast("int")), F.substring(_text(), F.lit(101), (F.col("doc_id") % 90).cast("int")))}, 
    f"(select trim(case when length(p) >= 40 then p || "
    f"case when length(o) > 40 then chr(10) || chr(10) || o else '' end when o <> '' then o else p end, {_BLANKS}) "
    f"from (select text[1:doc_id % 80] as p, trim(substr(text, 101, (doc_id % 90)::int), {_BLANKS}) as o)) as text"
)
query("model_replies", "select doc_id, split_part(text, chr(10), 1) as reply from documents")(lambda t: models.reasoned(t.documents().select("doc_id", F.col("text").alias("prompt")), models.echo).select("doc_id", "reply"))
query("page_analyses", 
    "select doc_id::varchar as path, 1 as page_num, case when doc_id % 3 = 0 then 'Page 1' else text[1:9] end as title, "
    "case when doc_id % 3 <> 0 then 'high' when text = '' then 'low' else 'medium' end as importance from documents"
)(
    lambda t: models.analysed_pages(t.documents().select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("page_num"), "text").withColumn("text", F.concat(F.when(F.col("path").cast("long") % 3 == 0, "").otherwise("\t"), "text")), _stand_in).select("path", "page_num", "title", "importance")
)


def _stand_in():
    """A model that knows pages only that begin with a tab."""
    return lambda texts: [{"title": t[1:10], "importance": "high", "description": "", "summary": ""} if t[:1] == "\t" else None for t in texts]


query("recognised_parts", 
    "select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, ' ')[1:8], lambda w: struct_pack(w := w, c := (length(w) % 10) / 10.0)), lambda p: p.c >= 0.4 and trim(p.w, ' ' || chr(9) || chr(10) || chr(13)) <> ''), lambda p: p.w), ' ') as text "
    "from documents"
)(
    lambda t: t.documents().select("doc_id", F.array_join(F.transform(lecture.confident(F.transform(F.slice(F.split("text", " "), 1, 8), lambda w: F.struct(w.alias("text"), ((F.length(w) % 10) / 10.0).alias("confidence")))), lambda p: p["text"]), " ").alias("text"))
)

# --- writes ------------------------------------------------------------------------------------------------------

query("card_rows", sql(
    "select media_id, (row_number() over (partition by media_id "
    "order by card_index) - 1)::int as card_index, question, answer, '' as topic, 'medium' as difficulty "
    "from flashcards qualify question <> 'Q' || (media_id % 7)",
"flashcards"))(
    lambda t: writes.card_rows(t.flashcards().groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("card_index", "question", "answer"))), lambda c: F.struct(F.when(c["question"] == F.concat(F.lit("Q"), F.col("media_id") % 7), " ").otherwise(c["question"]).alias("question"), c["answer"].alias("answer"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("difficulty"))).alias("cards")))
)
query("scored_sessions", 
    "select l_orderkey as media_id, l_linenumber as n, l_linenumber % 4 as total_questions, 1 as correct_answers, "
    "case when l_linenumber % 4 > 0 then 1 / (l_linenumber % 4) * 100 else 0.0 end as accuracy_score from lineitem"
)(lambda t: writes.scored_sessions(t.raw("lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") % 4).alias("total_questions"), F.lit(1).alias("correct_answers"))))
query("refused_reviews", "select event_id, case event_id % 8 when 7 then -1 else event_id % 8 end as confidence from events where event_id % 8 in (0, 6, 7)")(lambda t: writes.checked_reviews(t.raw("events").select("event_id", F.nullif(F.col("event_id") % 8, F.lit(7)).alias("confidence")))[1].withColumn("confidence", F.coalesce("confidence", F.lit(-1))))
query("upserted_media", sql("select id, user_id, case when id % 5 = 0 then 'new' else status end as status from media", "media"))(lambda t: writes.upserted(t.media().select("id", "user_id", "status"), t.media().where("id % 5 = 0").select("id", "user_id", F.lit("new").alias("status")), ["id"]))
query("without_media", sql("select media_id, card_index, question from flashcards where media_id % 3 <> 0", "flashcards"))(lambda t: writes.without(t.flashcards().select("media_id", "card_index", "question"), t.media().where("id % 3 = 0"), "media_id"))
query("without_user", sql("select id, user_id from media where user_id <> 7", "media"))(lambda t: writes.without_user(t.media().select("id", "user_id"), 7))


def _written(t: Tables) -> DataFrame:
    """A table written, changed for some parents, and cleared of others."""
    path, cards = new_path(t.spark, "cards"), t.flashcards().select("media_id", "card_index", "question")
    writes.replace_children(cards, path)
    writes.replace_children(cards.where("media_id % 50 = 0 and card_index = 0").withColumn("question", F.lit("new")), path)
    writes.delete(t.spark, {path: "media_id"}, t.media().where("id % 70 = 1").select("id"))
    return writes.table(t.spark, path, cards)


query("written_cards", sql("select media_id, card_index, case when media_id % 50 = 0 then 'new' else question end as question from flashcards where media_id % 70 <> 1 and not (media_id % 50 = 0 and card_index > 0)", "flashcards"))(_written)
_NOTES_SQL = "chr(10) || '## {0}' || chr(10) || chr(10) || {1} || chr(10)"
query("fallback_notes", "select doc_id as media_id, '# Study Notes: ' || coalesce(nullif(source, 'src1'), 'Lecture') || chr(10) || " + _NOTES_SQL.format("Overview", "text[1:30]") + " || " + _NOTES_SQL.format("Topics", "'- ' || lang || chr(10) || '- ' || source") + " || case when doc_id % 2 = 0 then '' else " + _NOTES_SQL.format("Key Concepts", "'- ' || lang") + " end as content from documents where text <> ''")(
    lambda t: writes.notes(t.documents().where("text <> ''").select(F.col("doc_id").alias("media_id"), F.nullif(F.col("source"), F.lit("src1")).alias("lecture_title"), F.substring("text", 1, 30).alias("summary"), F.array("lang", "source").alias("main_topics"), F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("key_concepts"), F.array().cast("array<string>").alias("learning_outcomes")))
)

# --- further text ------------------------------------------------------------------------------------------------



def _maps(t: Tables) -> DataFrame:
    replies = F.array(F.concat(F.lit("```mermaid\nmindmap\n  "), "source", F.lit("\n```")), F.concat(F.lit("```\n"), "source", F.lit("\n```<|end|>")), F.concat(F.lit("so: mindmap "), "source"), F.col("source"))
    return t.documents().select("doc_id", text.mermaid(F.element_at(replies, (F.col("doc_id") % 4 + 1).cast("int"))).alias("map"))


query("mind_maps", "select doc_id, case doc_id % 4 when 0 then 'mindmap' || chr(10) || '  ' || source when 1 then source when 2 then 'mindmap ' || source else source end as map from documents")(_maps)
query("stem_types", sql("select id, case id % 3 when 0 then 'images' when 1 then 'document' else 'video' end as type, (id % 97)::varchar as display from media", "media"))(lambda t: t.media().withColumn("stem", F.concat("batch_stem", F.element_at(F.array(F.lit("_img"), F.lit("_doc"), F.lit("")), (F.col("id") % 3 + 1).cast("int")))).select("id", text.stem_type(F.col("stem")).alias("type"), text.display_name(F.col("stem")).alias("display")))
query("answer_keys", sql("select media_id, question_index, case question_index % 5 when 0 then 'C' when 1 then 'B' when 2 then 'D' when 3 then 'none of these' else 'A' end as key from quiz_questions", "quiz_questions"))(
    lambda t: t.quiz_questions().select("media_id", "question_index", text.answer(F.create_map(F.lit("A"), "question", F.lit("B"), "answer", F.lit("C"), F.lit("x"), F.lit("D"), F.lit("y")), F.element_at(F.array(F.lit("C"), F.concat(F.lit(" "), "answer"), F.lit("3"), F.lit("none of these"), F.lit("0")), (F.col("question_index") % 5 + 1).cast("int"))).alias("key"))
)
on_documents("seconds_labels", lambda: {"label": text.seconds_label(F.col("n_chars") / 10)}, "printf('%02d:%04.1f', n_chars // 600, (n_chars % 600) / 10.0) as label")
query("transcript_languages", sql(
    f"select media_id, sum({_WORDS.format('text')})::bigint as word_count, count(*) as segment_count, max_by(end_time, segment_index) as duration_sec, (['en', 'de', 'fr'])[(media_id % 3 + 1)::int] as language "
    f"from segments group by media_id",
"segments"))(lambda t: library.transcript_stats(t.segments().withColumn("language", F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("media_id") % 3 + 1).cast("int")))))
query("merged_status", sql(
    "with mem as (select distinct user_id, batch_stem from media where id % 3 = 0), db as (select distinct user_id, batch_stem from media "
    "where id % 3 <> 0), b as (select *, 0 as stored from mem union all select *, 1 from db where not exists (select 1 from mem "
    "where mem.user_id = db.user_id and mem.batch_stem = db.batch_stem)) select *, row_number() over (partition by user_id "
    "order by stored, batch_stem) as position from b",
"media"))(lambda t: library.merged_status(*(t.media().where(c).select("user_id", "batch_stem").distinct() for c in ("id % 3 = 0", "id % 3 <> 0"))))
query("status_with_frames", sql(f"with {_STATES} select count(*) as total, " + ", ".join(f"count(*) filter (input_type = '{k}') as total_{k}" for k in _KINDS) + ", coalesce(sum(flashcard_count), 0)::bigint as flashcards, (select count(*) from quiz_questions q where q.media_id in (select id from states)) as frames_collected from states", *_STATE_TABLES))(lambda t: media.status_totals(_states(t), t.quiz_questions()))
query("concept_frequency_all", sql(
    "with a as (select media_id, concept from concepts union all select distinct media_id, 'topic ' || concept from concepts where pos = 2 union all "
    "select distinct media_id, concept from concepts where pos = 1) select media_id, concept, count(*) as freq from a group by 1, 2",
"concepts"))(
    lambda t: graph.frequency(graph.with_topics(t.concepts(), t.concepts().where("pos = 2").select("media_id", F.concat(F.lit("Topic "), "concept").alias("topic"), "pos").distinct().unionByName(t.concepts().select("media_id", F.lit("one topic of more than five words").alias("topic"), "pos").distinct()), t.concepts().where("pos = 1").select("media_id", F.upper("concept").alias("term"), F.lit("what it is").alias("definition")).distinct())).drop("first")
)
_TOLD = "case when length(t) > {0} then t[1:{0}] || ' [truncated]' else t end"
query("prompt_metadata", 
    f"select doc_id, 'Describe this lecture.' || chr(10) || 'TRANSCRIPT: ' || {_TOLD.format(800)} || chr(10) || 'SLIDES: ' || source || ' | ' || lang || chr(10) || 'CONCEPTS: [\"' || lang || '\"]' || chr(10) || '{prompts.ONLY_JSON + prompts.METADATA}' as prompt "
    f"from (select *, trim(text, {_BLANKS}) as t from documents)"
)(lambda t: t.documents().select("doc_id", prompts.metadata(_text(), F.array("source", "lang"), F.array("lang")).alias("prompt")))
query("prompt_cards", 
    f"select doc_id, 'Make 4 flashcards and 3 quiz questions of these notes, each "
    f"with one right option and no question twice.' || chr(10) || 'NOTES: ' || {_TOLD.format(600)} || chr(10) || 'LECTURE: ' || source || chr(10) || 'SUBJECT: General' || chr(10) || 'TOPICS: see notes' || chr(10) || 'CONCEPTS: [\"' || lang || '\"]' || chr(10) || 'OUTCOMES: []' || "
    f"case when doc_id % 2 = 0 then chr(10) || 'FORMULAS: x | y' else '' end || "
    f"case when t = '' then '' else chr(10) || 'TRANSCRIPT: ' || {_TOLD.format(300)} end || chr(10) || '{prompts.ONLY_JSON + prompts.CARDS}' as prompt "
    f"from (select *, trim(text, {_BLANKS}) as t from documents)"
)(
    lambda t: t.documents().select("doc_id", prompts.cards(_text(), F.col("source"), F.lit(""), F.array().cast("array<string>"), F.array("lang"), F.lit(None).cast("array<string>"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))), _text()).alias("prompt"))
)
query("prompt_study_notes", 
    "select doc_id, 'Write short study notes in Markdown, "
    "with the sections Overview, Key Concepts, Topics Covered, Learning Outcomes and Summary, in at most 400 words.' || chr(10) || 'LECTURE: ' || source || chr(10) || 'SUBJECT: General' || chr(10) || 'LEVEL: unknown' || chr(10) || 'TOPICS: ' || lang || chr(10) || 'SUMMARY: none' || chr(10) || 'CONCEPTS: none' || chr(10) || 'OUTCOMES: a; b; c' || chr(10) || 'FORMULAS: f' || chr(10) || '# Study Notes: ' || source as prompt "
    "from documents"
)(
    lambda t: t.documents().select("doc_id", prompts.study_notes(F.col("source"), F.lit(None).cast("string"), F.lit(""), F.array("lang"), F.lit(None).cast("array<string>"), F.array(*map(F.lit, "abcd")), F.lit(""), F.array(F.lit("f"))).alias("prompt"))
)
query("prompt_images", 
    f"select doc_id, 'Explain image ' || doc_id || ' (' || source || ').' || chr(10) || 'TEXT: ' || "
    f"case when text = '' then 'no text found' else text end || chr(10) || '{prompts.ONLY_JSON + prompts.IMAGE}' as one, 'Describe this set of ' || doc_id || ' images.' || chr(10) || 'SET: ' || source || chr(10) || 'IMAGES: ' || lang || chr(10) || '{prompts.ONLY_JSON + prompts.METADATA}' as batch, 'Write full study notes in Markdown, "
    f"with the sections Overview, Key Concepts, Detailed Notes and Summary.' || chr(10) || 'SET: Images' || chr(10) || 'SUBJECT: General' || chr(10) || 'LEVEL: unknown' || chr(10) || 'SUMMARY: none' || chr(10) || 'TOPICS: ' || lang || chr(10) || 'CONCEPTS: none' || chr(10) || 'OUTCOMES: none' || chr(10) || 'IMAGES: ' || "
    f"case when doc_id % 2 = 0 then source || ': d' else 'none' end as notes from documents"
)(
    lambda t: t.documents().select("doc_id", prompts.image(_text(), F.col("doc_id"), F.col("source")).alias("one"), prompts.image_batch(F.col("source"), F.col("doc_id"), F.array("lang")).alias("batch"), prompts.image_notes(F.lit(""), F.lit(""), F.lit(""), F.array("lang"), F.lit(None).cast("array<string>"), F.array().cast("array<string>"), F.lit(""), F.array(F.struct(F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("low").alias("importance"), F.lit("d").alias("description")))).alias("notes"))
)
