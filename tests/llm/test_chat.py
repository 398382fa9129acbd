import hashlib

from hypothesis import given
from hypothesis import strategies as st

from turnloom.llm import chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@given(st.text(alphabet="<|\\n>a\n", max_size=40))
def test_escape_is_reversible(text):
    escaped = chat._escaped(text)
    assert "<|" not in escaped
    assert chat.re.sub(r"<(\\*)\\\|", r"<\1|", escaped) == text


def brute(rows):
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    low = lambda v: (v is not None, v if v is not None else 0)
    found = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (low(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
        loss = "".join(t[2] or "" for t in turns if t[1] == "assistant")
        found.append((conv, len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return sorted(found, key=str)


def test_turns_against_brute_force(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<\\|im_start|>x\\"), (1, 2, "assistant", None), (1, 2, "assistant", None),
        (1, None, "user", "first"), (None, 0, "a\nb<|n|>", "null conversation"), (2, 0, None, "no role"), (2, 1, "assistant", "😀" * 1000 + "<"),
        (3, 0, "system", ""), (4, 0, "assistant", "l" * 300_000), (4, 1, "assistant", "<|n|>\n\n"), (5, 0, "user", "<"), (5, 1, "", "|"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, seq string")
    out = chat.format_chats(chat.events_of_turns(df))
    got = sorted((tuple(r)[:5] for r in chat.read_back(out).collect()), key=str)
    assert got == brute(rows)
    for r in out.collect():
        assert r.formatted.count(chat.START) == r.n_turns == r.formatted.count(chat.END)
    assert chat.read_back(chat.format_chats(chat.events_of_turns(df.limit(0)))).count() == 0


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 10, "start", "user", "helo"), (1, 2, 11, "start", "assistant", None), (1, 3, 11, "delta", None, "Hi"), (1, 4, 11, "delta", None, " you"),
        (1, 5, 10, "edit", None, "hello"), (1, 6, 11, "regenerate", None, None), (1, 7, 11, "delta", None, "Good "), (1, 8, 11, "delta", None, "day"),
        (2, 1, 1, None, "assistant", "alone"), (2, 1, 1, None, "assistant", "alone"),
    ]
    df = spark.createDataFrame(log[::-1], chat.EVENTS)
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].formatted == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nGood day<|im_end|>\n"
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["Good day"]
    assert got[2].formatted == "<|im_start|>assistant\nalonealone<|im_end|>\n"
