"""Conversations rebuilt from message rows.

Messages that carry a session id belong to it. Messages without one are joined into threads: they are nodes of a
graph whose links are explicit replies and quotations, and the threads are its connected components. Ordering and
validation then run on narrow rows sorted by range over ``(session, time, id)``; a session that holds a third of
all rows is thereby spread over many tasks, and what must pass from one task to the next is one summary row per task
and session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.operators.components import connected_components
from tarnlight.session import cut, union_all

# Spellings of the four roles, compared after lower-casing and removal of everything but letters.
ROLES = {
    "user": ["user", "human", "customer", "client", "person", "me", "enduser", "visitor", "prompter"],
    "assistant": ["assistant", "ai", "bot", "model", "agent", "chatbot", "aiassistant", "llm", "assistantbot"],
    "system": ["system", "sys", "developer", "systemprompt", "instruction", "instructions"],
    "tool": ["tool", "function", "toolresult", "tooloutput", "toolcall", "functionresult", "functioncall", "toolresponse", "plugin"],
}

# Fixed patterns: an assistant message that says nothing but that no answer came. Matched against the whole message,
# lower-cased, without surrounding brackets, stars and full stops.
NO_ANSWER = (
    r"(the )?(response|reply|answer|request|generation|completion|output|stream|message|model|assistant|connection)( was| has been| is| got)? ?"
    r"(aborted|interrupted|cancelled|canceled|stopped|timed out|timeout|failed|empty|missing|lost|closed|unavailable|dropped)"
    r"( (by|before|due to|because of|after|while) [a-z ]{1,40})?"
    r"|(no|empty|blank|missing|null) (response|reply|answer|output|completion|message|content)( (received|returned|available|generated|given|came))?"
    r"|(error ?:? ?)(the )?(model|assistant|server|service)? ?(did not|didn't|could not|failed to|does not) (answer|respond|reply|generate)( in time)?"
    r"|(the )?(model|assistant|bot|server) (did not|didn't|failed to|could not|gave no|returned no|sent no) ?(answer|respond|reply|response|output)?( in time)?"
    r"|(timeout|timed out|cancelled|canceled|aborted|interrupted)( by user)?"
)

INVISIBLE = "[\\s\\p{Z}\\p{Cc}\\p{Cf}\\u2800\\u3164\\u115f\\u1160]+"


def clean_role(role: Column) -> Column:
    """``user``, ``assistant``, ``system`` or ``tool`` for any known spelling, else null."""
    key = F.regexp_replace(F.lower(role), "[^\\p{L}]+", "")
    out = F.lit(None).cast("string")
    for name, spellings in ROLES.items():
        out = F.when(key.isin(spellings), F.lit(name)).otherwise(out)
    return out


def is_blank(content: Column) -> Column:
    """True where a text has no visible character; null texts are blank."""
    return F.coalesce(F.length(F.regexp_replace(content, INVISIBLE, "")) == 0, F.lit(True))


def reports_no_answer(content: Column) -> Column:
    """True where a text only reports that no answer came."""
    bare = F.regexp_replace(F.lower(F.trim(content)), "^[^\\p{L}]+|[^\\p{L}]+$", "")
    bare = F.regexp_replace(bare, "\\s+", " ")
    return F.coalesce(bare.rlike(f"^({NO_ANSWER})$"), F.lit(False))


def tidy_session(session: Column) -> Column:
    """A session id in lower case without surrounding white space of any kind; null and blank ids are empty."""
    return F.coalesce(F.lower(F.regexp_replace(session, "^[\\s\\p{Z}\\p{Cf}]+|[\\s\\p{Z}\\p{Cf}]+$", "")), F.lit(""))


def _lines(content: Column) -> Column:
    """The lines of a text that are not blank, without white space around them and between leading quotation marks."""
    bare = F.transform(F.split(content, "\\r\\n|[\\n\\r\\u0085\\u2028\\u2029]"), lambda x: F.regexp_replace(x, "^[\\s\\p{Z}\\p{Cf}]+|[\\s\\p{Z}\\p{Cf}]+$", ""))
    joined = F.transform(bare, lambda x: F.concat(F.regexp_replace(F.regexp_extract(x, "^[>\\s\\p{Z}]*", 0), "[\\s\\p{Z}]", ""), F.regexp_replace(x, "^[>\\s\\p{Z}]*", "")))
    return F.filter(joined, lambda x: x != "")


def _mark(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, "\n"), 256)


def threads_without_id(messages: DataFrame, reply_to: str | None = None) -> DataFrame:
    """``(id, thread)`` of the messages whose session id is null or blank.

    Links are ``reply_to`` (a message id, if the table has that column) and quotations: a message that begins with ``> some text``
    is linked to the message without id that opens with that line. If several open with it, the whole quotation decides, whatever its
    number of lines; if it fits several still, it links when all of these are of one thread already, and else tells nothing. Where no message
    opens with the line, those count whose own text opens with it after a quotation. A quotation may itself be quoted. Messages of
    equal role, content and time (if the table has these columns) are one message sent again, and are linked.
    Threads are the connected components, named by their smallest id; a message without any link is a thread of its own.
    """
    timed = {"role", "created_at"} <= set(messages.columns)
    lone = messages.where(tidy_session(F.col("session_id")) == "").select("id", "content", *(["role", "created_at"] if timed else []), *([reply_to] if reply_to else []))
    links = lone.select(F.col("id").alias("u"), F.col("id").alias("v")).where("false")
    heads = lone.select("id", "content", F.col("id").alias("head"))
    if timed:
        said = lone.select("id", "content", clean_role(F.col("role")).alias("role"), "created_at", F.md5("content").alias("body"))
        copies = said.where(~is_blank(F.col("content"))).groupBy("body", "role", "created_at").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last")
        heads = said.join(copies, ["body", "role", "created_at"], "left").select("id", "content", F.coalesce("first", "id").alias("head"))
        links = links.union(heads.where("id <> head").select("id", "head"))
    if reply_to:
        links = links.union(lone.where(F.col(reply_to).isNotNull()).select("id", F.col(reply_to).cast("long")))

    lined = heads.select("id", "head", _lines(F.col("content")).alias("lines"))
    plain = F.array_position(F.transform("lines", lambda x: x.startswith(">")), F.lit(False))
    parted = lined.where(F.size("lines") > 0).withColumn("k", F.when(plain == 0, F.size("lines")).otherwise(plain.cast("int") - 1))
    parted = parted.withColumn("quote", F.filter(F.transform(F.expr("slice(lines, 1, k)"), lambda x: F.substring(x, 2, 2**31 - 1)), lambda x: x != "")).withColumn("own", F.expr("slice(lines, k + 1, size(lines))"))
    parted = cut(parted.select("id", "head", "lines", "k", "quote", "own"))
    quotes = parted.where(F.size("quote") > 0).select(F.col("id").alias("u"), "head", _mark(F.expr("slice(quote, 1, 1)")).alias("h"), F.size("quote").alias("n"), _mark(F.col("quote")).alias("whole"))
    openers = parted.select(F.col("head").alias("v"), F.col("lines").alias("text"))
    after = parted.where((F.col("k") > 0) & (F.size("own") > 0)).select(F.col("head").alias("v"), F.col("own").alias("text"))
    first = F.expr("slice(text, 1, 1)")
    opened = openers.select(_mark(first).alias("h")).distinct()
    quotes = {0: quotes.join(opened, "h", "left_semi"), 1: quotes.join(opened, "h", "left_anti")}
    unclear = []
    for level, texts in enumerate((openers, after)):
        # only texts that open with a quoted line, each cut to the lengths of the quotations of that line
        asked = quotes[level].select("h", "n").distinct()
        fit = cut(texts.withColumn("h", _mark(first)).join(asked.union(asked.select("h", F.lit(1))).distinct(), "h").where("size(text) >= n").select("v", "n", _mark(F.expr("slice(text, 1, n)")).alias("whole")).distinct())
        known = fit.groupBy("n", "whole").agg(F.min("v").alias("v"), F.max("v").alias("w"), F.count("*").alias("several"))
        other = F.when(F.col("v") == F.col("w"), F.col("v")).when((F.col("several") == 2) & (F.col("head") == F.col("v")), F.col("w")).when((F.col("several") == 2) & (F.col("head") == F.col("w")), F.col("v"))
        by_line = quotes[level].join(known.where("n = 1").select(F.col("whole").alias("h"), "v", "w", "several"), "h").withColumn("other", other)
        links = links.union(by_line.where("other is not null").select("u", "other"))
        by_whole = by_line.where("other is null").select("u", "head", "h", "n", "whole").join(known, ["n", "whole"], "left").withColumn("other", other)
        links = links.union(by_whole.where("other is not null").select("u", "other"))
        # what fits several: by the whole quotation, or by its first line if nothing goes on like it
        held = F.col("v").isNotNull()
        open_ = by_whole.where("other is null").select("u", F.when(held, F.col("n")).otherwise(1).alias("n"), F.when(held, F.col("whole")).otherwise(F.col("h")).alias("whole"))
        unclear.append((open_.withColumn("level", F.lit(level)), fit.select("v", "n", "whole", F.lit(level).alias("level"))))
    links = cut(links)
    waiting, fit = cut(union_all([a for a, _ in unclear])), union_all([b for _, b in unclear])
    while True:
        found = connected_components(links, "u", "v").withColumnsRenamed({"node": "id", "component": "root"})
        if waiting.isEmpty():
            break
        found = cut(found)
        rooted = fit.join(found.withColumnRenamed("id", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
        agreed = rooted.groupBy("level", "n", "whole").agg(F.min("root").alias("root"), F.max("root").alias("most")).where("root = most")
        more = cut(waiting.join(agreed, ["level", "n", "whole"]).select("u", F.col("root").alias("v")))
        if more.isEmpty():
            break
        links, waiting = cut(links.union(more)), cut(waiting.join(more.select("u").distinct(), "u", "left_anti"))
    return lone.select("id").distinct().join(found, "id", "left").select("id", F.concat(F.lit("thread-"), F.coalesce("root", "id").cast("string")).alias("thread"))


def rebuild_conversations(messages: DataFrame, reply_to: str | None = None) -> DataFrame:
    """``(session_id, turn, message_id, role)``, a row per message of each kept conversation.

    Input: ``id, session_id, role, content, created_at``; other columns are ignored. Session ids are compared in
    lower case without surrounding white space; rows without one are put into threads first
    (``threads_without_id``). Messages of a session with equal role, content and time are one (smallest id), so
    repeated rows count once. Blank messages and assistant messages that only report a missing answer are left out
    before counting. A session is dropped if any of its messages has an unknown role or a null time, if its first user
    or assistant message is not the user's, if a user message is not directly followed by an assistant message, or if it has no user
    message. Turns count from 1 by time, then id. An empty table gives no rows; equal times are broken by id.
    """
    tidy = tidy_session(F.col("session_id"))
    nameless = messages.where(tidy == "")
    rows = messages.select("id", tidy.alias("session_id"), "role", "content", "created_at")
    if not nameless.isEmpty():
        threads = threads_without_id(messages, reply_to)
        rows = rows.join(threads, "id", "left").withColumn("session_id", F.coalesce(F.when(F.col("session_id") != "", F.col("session_id")), F.col("thread"))).drop("thread")
    role = clean_role(F.col("role"))
    skipped = is_blank(F.col("content")) | ((role == "assistant") & reports_no_answer(F.col("content")))
    narrow = rows.select(
        "session_id",
        "created_at",
        "id",
        role.alias("role"),
        F.coalesce(skipped, F.lit(False)).alias("skipped"),
        F.coalesce(F.md5("content"), F.lit("")).alias("body"),
    )
    single = narrow.groupBy("session_id", "created_at", "role", "body").agg(F.min("id").alias("id"), F.first("skipped").alias("skipped")).drop("body")
    spread = cut(single.repartitionByRange("session_id", "created_at", "id").withColumn("part", F.spark_partition_id()))

    own = Window.partitionBy("part", "session_id")
    order = own.orderBy("created_at", "id")
    spoken = ~F.col("skipped") & F.col("role").isin("user", "assistant")
    before = F.last(F.when(spoken, F.col("role")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    local = spread.withColumn("spoken", spoken).withColumn("before", before)
    broken = (F.col("spoken") & (F.col("role") == "user") & (F.col("before") == "user")) | F.col("role").isNull() | F.col("created_at").isNull()
    key = F.struct("created_at", "id")
    summary = local.groupBy("session_id", "part").agg(
        F.max(F.coalesce(broken, F.lit(False))).alias("broken"),
        F.count_if(~F.col("skipped")).alias("n"),
        F.min_by(F.when(F.col("spoken"), F.col("role")), F.when(F.col("spoken"), key)).alias("first_role"),
        F.max_by(F.when(F.col("spoken"), F.col("role")), F.when(F.col("spoken"), key)).alias("last_role"),
    )
    parts = Window.partitionBy("session_id")
    earlier = parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last("last_role", True).over(earlier)
    verdict = (
        summary.withColumn("previous", previous)
        .withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn(
            "wrong",
            F.col("broken")
            | F.coalesce((F.col("previous") == "user") & (F.col("first_role") == "user"), F.lit(False))
            | F.coalesce(F.col("previous").isNull() & (F.col("first_role") == "assistant"), F.lit(False)),
        )
        .withColumn("any_wrong", F.max("wrong").over(parts))
        .withColumn("final", F.last("last_role", True).over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .where(~F.col("any_wrong") & (F.col("final") == "assistant"))
        .select("session_id", "part", "offset")
    )
    kept = spread.where(~F.col("skipped")).join(verdict, ["session_id", "part"])
    turn = (F.row_number().over(order) + F.col("offset")).cast("int")
    return kept.select("session_id", turn.alias("turn"), F.col("id").alias("message_id"), "role")
