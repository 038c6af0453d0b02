import random
from hashlib import sha256

from hypothesis import given
from hypothesis import strategies as st

from shelfmark.llm import chat as C

PARTS = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "|im_start|>", "|im_end|>", "|endoftext|>", "a", "\n", "é", "|"]
texts = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


@given(texts, texts)
def test_turns_come_back_and_hold_no_control_string(role, text):
    piece, at = C.format_turn(role, text)
    assert C.parse_turn(piece) == (role, text)
    assert C.unescape(piece[at : -len(C.CLOSE) - 1]) == text
    inside = piece[len(C.OPEN) : -len(C.CLOSE) - 1]
    assert not any(s in inside for s in ("<s>", "</s>", "[INST]", "[/INST]", C.OPEN, C.CLOSE, "<|endoftext|>"))


def plain(rows):
    """conv_id: (turns, replies, formatted lengths of all examples)"""
    out = {}
    none = (float("-inf"),)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: tuple(none if x is None else (0, x) for x in r))
        turns = [(role or "", text or "") for _, role, text in own]
        pieces = [C.format_turn(*t)[0] for t in turns]
        ends = [n for n, (role, _) in enumerate(turns) if role == "assistant"]
        ends += [len(turns) - 1] if not ends or ends[-1] != len(turns) - 1 else []
        replies = [t for r, t in turns if r == "assistant"]
        out[conv] = turns, replies, ["".join(pieces[: n + 1]) for n in ends]
    return out


def digests(want):
    h = lambda s: sha256(s.encode()).hexdigest()
    return {c: (len(t), h("".join(f"{r}\n{x}\n" for r, x in t)), len("".join(y)), h("".join(y)), sum(map(len, e))) for c, (t, y, e) in want.items()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, position long, start string")


def conversations():
    rng = random.Random(4)
    say = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), say()) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2], say()) for t in range(2_000)]  # one conversation has most turns
    rows += [(100, 0, None, None), (100, None, "assistant", "late"), (100, 0, "assistant", ""), (100, 0, "odd\nrole\\n", "x"), (100, 0, "odd\nrole\\n", "x")]
    rows += [(None, 1, "assistant", "no id"), (None, 0, "user", "u"), (101, 0, "user", "long " * 200_000), (101, 1, "assistant", "long " * 200_000)]
    return rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_digests_are_those_of_the_turns(spark):
    rows = conversations()
    got = {r[0]: tuple(r)[1:] for r in C.read_back(C.segments(table(spark, rows))).collect()}
    assert got == digests(plain(rows))


def test_every_reply_is_the_target_of_one_example(spark):
    rows = [r for r in conversations() if r[0] != 99]
    found = {}
    for r in C.expand(C.segments(table(spark, rows))).collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv, (turns, replies, whole) in plain(rows).items():
        own = sorted(found[conv], key=lambda r: r.example)
        assert [r.example for r in own] == list(range(1, len(whole) + 1))
        assert [r.text for r in own] == whole
        assert [C.unescape(r.text[r.loss_start : r.loss_end]) for r in own if r.loss_start is not None] == replies
        assert own[-1].text.count(C.OPEN) == len(turns)


def test_empty_table(spark):
    none = table(spark, [(1, 1, "user", "x")]).limit(0)
    assert C.read_back(C.segments(none)).count() == 0 == C.expand(C.segments(none)).count()


def test_digests_are_read_from_examples_written_out(spark):
    rows = conversations()
    got = {r[0]: tuple(r)[1:] for r in C.read_examples(C.segments(table(spark, rows))).collect()}
    assert got == digests(plain(rows))
    assert C.read_examples(C.segments(table(spark, rows).limit(0))).count() == 0


def test_query_expands_every_example(monkeypatch):
    from shelfmark.llm import queries

    seen = []
    monkeypatch.setattr(queries, "read", lambda *_: Given())
    monkeypatch.setattr(C, "segments", lambda _: "segments")
    monkeypatch.setattr(C, "read_examples", lambda formatted: seen.append(formatted))
    queries.op12_chat_format(Given(), "")
    assert seen == ["segments"]


class Given:
    """Stands for a table and a session."""

    select = unionByName = createDataFrame = lambda self, *_: self
