import datetime as dt

from tarnlight.llm.conversations import rebuild_conversations, threads_without_id

SCHEMA = "id long, session_id string, role string, content string, created_at timestamp_ntz, turn int, part string"


def at(n):
    return None if n is None else dt.datetime(2026, 1, 1) + dt.timedelta(minutes=n)


def table(spark, rows):
    return spark.createDataFrame([(i, s, r, c, at(t), 5, "x") for i, s, r, c, t in rows], SCHEMA)


def kept(spark, rows):
    out = {}
    for r in rebuild_conversations(table(spark, rows)).orderBy("turn").collect():
        out.setdefault(r.session_id, []).append((r.turn, r.message_id))
    return out


def test_order_roles_and_repeats(spark):
    rows = [(2, " A", "Bot", "hi", 2), (1, "a ", "HUMAN", "hello", 1), (1, "a ", "HUMAN", "hello", 1), (9, "a", "user", "hello", 1), (3, "a", "function", "{}", 3), (4, "a", "assistant", " ", 4), (5, "a", "assistant", "[no response]", 5), (6, "a", "ai", "more", 5)]
    assert kept(spark, rows) == {"a": [(1, 1), (2, 2), (3, 3), (4, 6)]}


def test_dropped(spark):
    rows = []
    for n, session in enumerate([
        [("user", "q", 1)], [("assistant", "a", 1), ("user", "q", 2), ("assistant", "a", 3)], [("user", "q", 1), ("user", "r", 2), ("assistant", "a", 3)], [("user", "q", 1), ("assistant", "", 2)],
        [("user", "q", 1), ("assistant", "a", 2), (None, "x", 3)], [("user", "q", 1), ("assistant", "a", 2), ("observer", " ", 3)], [("user", "q", 1), ("assistant", "a", None)], [("system", "s", 1), ("tool", "t", 2)],
        [("user", "q", 1), ("assistant", "a", 2), ("user", "r", 3), ("assistant", "Error: the model did not answer", 4)],
    ]):
        rows += [(n * 10 + i, f"s{n}", r, c, t) for i, (r, c, t) in enumerate(session)]
    rows += [(900, "ok", "user", "q", 1), (901, "ok", "assistant", "a", 1), (902, "ok", "assistant", "b", 2)]
    assert kept(spark, rows) == {"ok": [(1, 900), (2, 901), (3, 902)]}


def test_hot_session_over_many_parts(spark):
    rows = [(i, "hot", "user" if i % 2 == 0 else "assistant", f"m{i}", i) for i in range(4000)] + [(9000 + i, f"s{i % 7}", "user", "x", i) for i in range(50)]
    got = kept(spark, rows)
    assert list(got) == ["hot"] and got["hot"] == [(i + 1, i) for i in range(4000)]


def test_threads_by_reply_and_quote(spark):
    rows = [(1, None, "user", "first question", 1), (2, "", "assistant", "> first question\nan answer", 2), (3, None, "user", "alone", 3), (4, None, "assistant", "late", 4)]
    df = table(spark, rows)
    assert {r.id: r.thread for r in threads_without_id(df).collect()} == {1: "thread-1", 2: "thread-1", 3: "thread-3", 4: "thread-4"}
    linked = df.selectExpr("*", "case id when 4 then 3L end as parent")
    assert {r.id: r.thread for r in threads_without_id(linked, "parent").collect()}[4] == "thread-3"
    assert kept(spark, rows) == {"thread-1": [(1, 1), (2, 2)]}


def test_empty(spark):
    assert kept(spark, []) == {}


def test_a_line_that_several_messages_open_with_links_nothing(spark):
    from tarnlight.llm.conversations import threads_without_id

    rows = [(1, None, "Thanks\nfor one"), (2, " ", "Thanks\nfor two"), (3, None, "> Thanks\nyou are welcome"), (4, None, "The harbour map"), (5, None, "> The harbour map\nis on the table")]
    got = {r.id: r.thread for r in threads_without_id(spark.createDataFrame(rows, "id long, session_id string, content string")).collect()}
    assert got == {1: "thread-1", 2: "thread-2", 3: "thread-3", 4: "thread-4", 5: "thread-4"}


def threads(spark, texts):
    return {r.id: r.thread for r in threads_without_id(spark.createDataFrame([(i, None, c) for i, c in texts], "id long, session_id string, content string")).collect()}


def test_a_quotation_of_several_lines_tells_which_message(spark):
    rows = [(1, "Thanks\nfor one"), (2, "Thanks\r\n\r\nfor two\nand more"), (3, "> Thanks\n> for two\nyou are welcome"), (4, "> Thanks\nwhich?"), (5, "> Thanks\n> for three\nwhich?")]
    assert threads(spark, rows) == {1: "thread-1", 2: "thread-2", 3: "thread-2", 4: "thread-4", 5: "thread-5"}


def test_an_answer_that_begins_with_a_quotation_is_quoted_in_turn(spark):
    rows = [(1, "first question"), (2, "> first question\nan answer"), (3, "> an answer\nanother question"), (4, "> > first question\n> an answer\nI doubt it"), (5, "> another question\nanother question")]
    assert set(threads(spark, rows).values()) == {"thread-1"}


def test_what_fits_several_messages_of_one_thread_belongs_to_it(spark):
    rows = [(1, "Yes\nit is"), (2, "> Yes\n> it is\nagreed"), (3, "Yes\nof course\nquite"), (4, "> agreed\n> > Yes\nno")]
    rows += [(10, "the harbour map"), (11, "> the harbour map\nwell\nfirst"), (12, "> the harbour map\nwell\nsecond"), (13, "> well\nwhat?")]
    got = threads(spark, rows)
    assert {got[n] for n in (10, 11, 12, 13)} == {"thread-10"} and got[2] == "thread-1" and got[3] == "thread-3" and got[4] == "thread-1"


def test_a_message_sent_again_is_one_message(spark):
    rows = [(1, None, "user", "first question", 1), (2, None, "Human", "first question", 1), (3, None, "assistant", "> first question\nan answer", 2), (4, None, "user", "first question again", 1), (5, None, "user", "first question again", 9), (6, None, "assistant", "> first question again\nyes", 10)]
    got = {r.id: r.thread for r in threads_without_id(table(spark, rows)).collect()}
    assert got == {1: "thread-1", 2: "thread-1", 3: "thread-1", 4: "thread-4", 5: "thread-5", 6: "thread-6"}
    assert kept(spark, rows[:3]) == {"thread-1": [(1, 1), (2, 3)]}


def test_session_ids_of_other_white_space_are_none(spark):
    rows = [(1, "\t", "user", "first question", 1), (2, " ", "assistant", "> first question\nan answer", 2), (3, None, "user", "alone", 3)]
    assert kept(spark, rows) == {"thread-1": [(1, 1), (2, 2)]}
    assert kept(spark, rows[:2]) == {"thread-1": [(1, 1), (2, 2)]}
