import hashlib
import random

from riskweave.llm import chat, queries

MARKS = chat.Template().control()


def expected(turns):
    found = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", (t[3] or "").encode())):
        found.setdefault(conv, []).append((role or "", text or ""))
    return {
        conv: (
            len(rows),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(),
            sum(len(t) for r, t in rows if r == "assistant"),
            hashlib.sha256("".join(t for r, t in rows if r == "assistant").encode()).hexdigest(),
        )
        for conv, rows in found.items()
    }


def summaries(frame):
    return {r.conv_id: r for r in chat.summarize(frame).collect()}


SCHEMA = "conv_id long, turn long, role string, text string, place int, valid string"


def frame_of(spark, turns):
    return spark.createDataFrame([(*t, 1, "x") for t in turns], SCHEMA).repartition(3)


def test_odd_turns(spark, odd_texts):
    turns = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(odd_texts)]
    turns += [(2, 0, "user", " ".join(MARKS)), (2, 1, "assistant", "\\".join(MARKS) + "\\"), (2, 2, "tool<<:>>\\", "<<:>>")]
    turns += [(3, 0, None, None), (3, None, "user", "a"), (3, 0, "user", "b"), (3, 0, "user", "b"), (None, 1, "user", "no id")]
    turns += [(4, 0, "assistant", ""), (5, 0, "<<ROLE>>", "x"), (5, 1, "", "[INST]")]
    got = summaries(frame_of(spark, turns))
    assert {c: tuple(r)[1:5] for c, r in got.items()} == expected(turns)
    segments = chat.format_turns(frame_of(spark, turns)).collect()
    for conv, row in got.items():
        own = sorted((s for s in segments if s.conv_id == conv), key=lambda s: s.place)
        whole = "".join(s.content for s in own)
        assert row.formatted_chars == len(whole)
        assert [s.place for s in own] == list(range(len(own)))
        assert [(r, t) for r, t in chat.lexed(whole)] == [
            (r or "", t or "")
            for _, _, r, t in sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", (t[3] or "").encode()))
        ]


def test_escapes_are_reversible():
    r, escape = random.Random(5), chat.escaper(chat.Template())
    pieces = [*MARKS, "\\", "<", ">", "[", "]", "/", "s", "INST", "SYS", "a", "\n"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        safe = escape(text)
        assert chat.unescape(safe) == text
        assert not any(mark in safe for mark in MARKS)


def test_machine(spark):
    def valid(*roles):
        turns = [(7, k, role, "t") for k, role in enumerate(roles)]
        return [s.valid for s in chat.format_turns(frame_of(spark, turns)).orderBy("place").collect() if s.part == "close"]

    assert valid("system", "user", "assistant", "user") == [True] * 4
    assert valid("user", "user", "assistant") == [True, False, False]
    assert valid("assistant") == [False]
    assert valid("user", "system") == [True, False]
    assert valid("user", "robot") == [True, False]


def test_other_template(spark):
    template = chat.Template(marks={"user": ("<|u|>", "<|/u|>"), "bot": ("<|b|>", "<|/b|>")}, loss=frozenset({"bot"}))
    turns = frame_of(spark, [(1, 0, "user", "<|b|> hi"), (1, 1, "bot", "<|/b|>")])
    row = chat.summarize(turns, template).first()
    assert (row.n_turns, row.loss_chars) == (2, len("<|/b|>"))


def test_no_turns(spark):
    assert chat.summarize(frame_of(spark, [])).count() == 0


def test_query(spark, small):
    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op6_chat_format(spark, small).collect()}
    assert got == expected(turns + queries.EXTRA_TURNS)
