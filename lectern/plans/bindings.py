"""The driver's tables as the logical tables: pure projections, in DataFrames and in SQL that says the same.

Operators know nothing of this module; a query binds the tables and applies an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import importance

#: All columns of lineitem, for a total order among rows of equal keys.
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_SUBJECTS = ["Physics - Kinematics", "math:algebra - linear", "CS > AI", "bio-chem/organic", "newton's laws", ""]


class Tables:
    """The logical tables over the Parquet files of a directory; each is read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def media(self) -> DataFrame:
        kinds = F.create_map(*(F.lit(x) for pair in (("1", "video"), ("2", "image"), ("3", "document"), ("4", "live"), ("5", "audio")) for x in pair))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), kinds[F.substring("o_orderpriority", 1, 1)].alias("media_type"),
            F.concat(F.lit("lec_"), F.col("o_orderkey") % 97).alias("batch_stem"), F.concat(F.lit("up/"), F.col("o_orderkey"), F.lit("_clip.v1.mp4")).alias("storage_path"), F.col("o_orderdate").alias("uploaded_at"), F.col("o_orderstatus").alias("status"),
        )

    def details(self) -> DataFrame:
        """Titles: one row for a video, live or document medium, two for images."""
        m = self.media().where("media_type <> 'audio'")
        m = m.withColumn("batch_index", F.explode(F.when(F.col("media_type") == "image", F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))))
        title = F.when(F.col("status") != "P", F.concat(F.lit("Lecture "), F.col("id"), F.lit("."), F.col("batch_index")))
        subject = F.element_at(F.array(*map(F.lit, _SUBJECTS)), (F.col("id") % 6 + 1).cast("int"))
        return m.select(F.col("id").alias("media_id"), F.when(F.col("media_type") == "live", "video").otherwise(F.col("media_type")).alias("kind"), "batch_index", title.alias("lecture_title"), subject.alias("subject_area"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("r/"), F.col("id"), F.lit(".pdf"))).alias("pdf_report_path"))

    def _lines(self, flag: str, index: str) -> DataFrame:
        lines = self.raw("lineitem").where(F.col("l_returnflag") == flag)
        order = Window.partitionBy("l_orderkey").orderBy(*_LINE)
        return lines.select(F.col("l_orderkey").alias("media_id"), (F.row_number().over(order) - 1).alias(index), F.concat(F.lit("Q"), F.col("l_partkey")).alias("question"), F.concat(F.lit("A"), F.col("l_suppkey")).alias("answer"))

    def flashcards(self) -> DataFrame:
        return self._lines("N", "card_index")

    def quiz_questions(self) -> DataFrame:
        return self._lines("R", "question_index")

    def notes(self) -> DataFrame:
        return self.raw("orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("media_id"), F.concat(F.lit("# Notes\nStatus "), "o_orderstatus", F.lit("\nPriority "), "o_orderpriority").alias("content"))

    def quiz_sessions(self) -> DataFrame:
        owner = self.raw("orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_custkey").alias("user_id"))
        right = F.round(F.col("l_discount") * 100).cast("int")
        lines = self.raw("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("media_id"), F.lit(10).alias("total_questions"), right.alias("correct_answers"), (right * 10).cast("double").alias("accuracy_score"), F.col("l_shipdate").alias("completed_at"))
        return lines.join(owner, "media_id")

    def progress(self) -> DataFrame:
        """A user's event goes to one of the user's media, so that the pairs really exist."""
        m = self.raw("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("media_id"))
        m = m.withColumns({"at": F.row_number().over(Window.partitionBy("user_id").orderBy("media_id")) - 1, "of": F.count("*").over(Window.partitionBy("user_id"))})
        sizes = m.where("at = 0").select("user_id", "of")
        kind = F.when(F.col("event_type") == "click", "flashcard").when(F.col("event_type") == "purchase", "quiz_question").otherwise("other")
        e = self.raw("events").join(sizes, "user_id").withColumn("at", (F.col("event_id") % F.col("of")).cast("int")).join(m.drop("of"), ["user_id", "at"])
        return e.select("event_id", "user_id", "media_id", kind.alias("item_type"), (F.col("event_id") % 7).cast("int").alias("card_index"), F.when(F.col("event_id") % 11 != 0, (1 + F.col("event_id") % 5).cast("int")).alias("confidence"), (F.col("value") > 50).alias("correct"), F.get_json_object("props", "$.k").alias("session_id"), F.col("ts").alias("reviewed_at"))

    def segments(self) -> DataFrame:
        words = F.size(F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda x: x != ""))
        c = self.raw("conversations").withColumn("n", words.cast("long"))
        order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
        end = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return c.select(F.col("conv_id").alias("media_id"), (F.row_number().over(order) - 1).alias("segment_index"), (end - F.col("n")).cast("double").alias("start_time"), end.cast("double").alias("end_time"), "text")

    def live_lectures(self) -> DataFrame:
        m = self.media().where("media_type = 'live'")
        return m.select("id", "user_id", F.concat(F.lit("s"), F.col("id")).alias("session_id"), F.concat(F.lit("Live "), F.col("id")).alias("title"), F.when(F.col("status") == "F", "done").otherwise("recording").alias("state"), F.col("uploaded_at").alias("started_at"))

    def concepts(self) -> DataFrame:
        """One row for each mention: media_id, frame_id, pos, concept."""
        lines = self.raw("lineitem").join(self.raw("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select((F.col("l_orderkey") % 50).alias("media_id"), F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("pos"), F.lower("p_brand").alias("concept"))

    def documents(self) -> DataFrame:
        return self.raw("documents")

    def frames(self) -> DataFrame:
        """Whole texts, 50 consecutive documents to a medium, so that media grow in number with the table."""
        d = self.raw("documents")
        return d.select(F.floor(F.col("doc_id") / 50).alias("media_id"), F.col("doc_id").alias("frame_id"), F.when(F.col("doc_id") % 4 != 0, F.substring("text", 1, 30)).alias("slide_title"), F.slice(F.split("text", " ", 4), 1, 3).alias("key_concepts"), importance(F.col("text")).alias("importance"), F.col("text").alias("ocr_text"))

    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_LINE_SQL = ", ".join(_LINE)
#: The same in SQL.
CTE = {
    "media": (
        "select o_orderkey as id, o_custkey as user_id, "
        "case o_orderpriority[1] when '1' then 'video' when '2' then 'image' when '3' then 'document' when '4' then 'live' when '5' then 'audio' end as media_type, 'lec_' || (o_orderkey % 97) as batch_stem, 'up/' || o_orderkey || '_clip.v1.mp4' as storage_path, o_orderdate as uploaded_at, o_orderstatus as status "
        "from orders"
    ),
    "details": (
        "select id as media_id, case when media_type = 'live' then 'video' else media_type end as kind, batch_index, "
        "case when status <> 'P' then 'Lecture ' || id || '.' || batch_index end as lecture_title, (['Physics - Kinematics', 'math:algebra - linear', 'CS > AI', 'bio-chem/organic', 'newton''s laws', ''])[(id % 6 + 1)::int] as subject_area, "
        "case when id % 3 = 0 then 'r/' || id || '.pdf' end as pdf_report_path "
        "from (select *, unnest(case when media_type = 'image' then [1, 0] else [0] end) as batch_index from media where media_type <> 'audio')"
    ),
    "flashcards": f"select l_orderkey as media_id, row_number() over (partition by l_orderkey order by {_LINE_SQL}) - 1 as card_index, 'Q' || l_partkey as question, 'A' || l_suppkey as answer from lineitem where l_returnflag = 'N'",
    "quiz_questions": f"select l_orderkey as media_id, row_number() over (partition by l_orderkey order by {_LINE_SQL}) - 1 as question_index, 'Q' || l_partkey as question, 'A' || l_suppkey as answer from lineitem where l_returnflag = 'R'",
    "notes": "select o_orderkey as media_id, '# Notes' || chr(10) || 'Status ' || o_orderstatus || chr(10) || 'Priority ' || o_orderpriority as content from orders where o_orderkey % 4 = 0",
    "quiz_sessions": "select o_custkey as user_id, l_orderkey as media_id, 10 as total_questions, round(l_discount * 100)::int as correct_answers, (round(l_discount * 100)::int * 10)::double as accuracy_score, l_shipdate as completed_at from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'A'",
    "owned": "select o_custkey as user_id, o_orderkey as media_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as at_, count(*) over (partition by o_custkey) as of_ from orders",
    "progress": (
        "select event_id, e.user_id, m.media_id, "
        "case event_type when 'click' then 'flashcard' when 'purchase' then 'quiz_question' else 'other' end as item_type, (event_id % 7)::int as card_index, "
        "case when event_id % 11 <> 0 then (1 + event_id % 5)::int end as confidence, value > 50 as correct, json_extract_string(props, '$.k') as session_id, ts as reviewed_at "
        "from events e join (select user_id, of_ from owned where at_ = 0) s on s.user_id = e.user_id "
        "join owned m on m.user_id = e.user_id and m.at_ = e.event_id % s.of_"
    ),
    "segments": (
        "select conv_id as media_id, "
        "row_number() over w - 1 as segment_index, (sum(n) over (w rows between unbounded preceding and current row) - n)::double as start_time, (sum(n) over (w rows between unbounded preceding and current row))::double as end_time, text "
        "from (select *, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) as n "
        "from conversations) window w as (partition by conv_id order by turn, role, text)"
    ),
    "live_lectures": "select id, user_id, 's' || id as session_id, 'Live ' || id as title, case when status = 'F' then 'done' else 'recording' end as state, uploaded_at as started_at from media where media_type = 'live'",
    "frames": (
        "select doc_id // 50 as media_id, doc_id as frame_id, "
        "case when doc_id % 4 <> 0 then text[1:30] end as slide_title, string_split(text, ' ')[1:3] as key_concepts, "
        "case when length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) < 30 then 'low' when length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) < 50 then 'medium' else 'high' end as importance, text as ocr_text "
        "from documents"
    ),
    "concepts": "select l_orderkey % 50 as media_id, l_orderkey as frame_id, l_linenumber as pos, lower(p_brand) as concept from lineitem join part on l_partkey = p_partkey",
}
_NEEDS = {"details": ["media"], "progress": ["owned"], "live_lectures": ["media"]}


def sql(body: str, *names: str) -> str:
    """body after the bindings that it names, and those that they need."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*_NEEDS.get(n, []), n) if x not in wanted]
    own = body.strip()
    ctes = ", ".join(f"{n} as ({CTE[n]})" for n in wanted)
    if own.lower().startswith("with "):
        return f"with {ctes}, {own[5:]}"
    return f"with {ctes} {own}"
