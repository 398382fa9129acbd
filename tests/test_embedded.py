"""Messages of JSON in scripts, as rows, against the parser in one piece."""

import json
import random
import time

import pytest

from turnloom.functions import rules
from turnloom.functions.dom import parse
from turnloom.operators import embedded, providers

KEYS = ["role", "author", "sender", "content", "text", "message", "parts", "children", "10", "9", "01", "4294967295", "a", "b", "type", "value", "ü"]
LEAVES = ["user", "bot", "assistant", "hello", "  x﻿", "{1}", "[]", '"', "", "Copy link", 0, 0.0, 1, 1.5, 10**30, True, False, None, [], {}, ["user"], {"role": "user"}, "say   so", "a\0b"]


def made(rng, depth):
    kind = rng.random()
    if depth <= 0 or kind < 0.35:
        return rng.choice(LEAVES)
    if kind < 0.55:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: made(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(6))}


def nested(value, depth, by=lambda v: [v]):
    for _ in range(depth):
        value = by(value)
    return value


USER, BOT = {"role": "user", "content": "q"}, {"author": {"type": "bot"}, "text": {"parts": ["a", ["b", {"value": " c "}]]}}
BASE = [
    json.dumps(nested(USER, 18)), json.dumps(nested(USER, 19)), json.dumps(nested(BOT, 17, lambda v: {"x": v})), json.dumps({"role": "user", "text": nested("deep", 60)}),
    json.dumps([{"role": "user", "text": "x" * rules.MAX_TEXT}, {"role": "bot", "text": "x" * (rules.MAX_TEXT + 1)}]),
    json.dumps({"10": {"role": "user", "text": "ten"}, "b": {"role": "user", "text": "b"}, "9": {"role": "user", "text": "nine"}, "01": {"role": "user", "text": "one"}, "a": {"role": "user", "text": "a"}}),
    '{"a":{"role":"user","text":"first"},"b":{"role":"user","text":"mid"},"a":{"role":"user","text":"last"}}', '{"role":"x","role":"user","text":"v","text":"w"}', '[{"k":{"role":"user","role":"bot","text":"t"}}]',
    '{"role":"user","parts":[],"message":{"parts":[],"children":["no"]}}', '{"role":[],"sender":"user","text":"x"}', '{"role":{},"sender":"user","text":"x"}', '{"role":["assistant"],"text":null,"answer":"x"}',
    '{"author":"user","text":"x"}', '{"author":["user"],"text":"x"}', '{"role":"user","text":0}', '{"role":"user","text":""}', '{"role":true,"text":"t"}', '{"Role":"user","text":"t"}',
    "", "  ", "null", "1", '"role"', "[1,2", '{"role":"user","text":"x"} x', '{"role":"user","text":"x"}}', '[{"role":"user","text":"x"}]]', '{"role":"user","text":NaN}', "{'role':'user','text':'x'}", '[{"role":"user","text":"x"},]', '{"role":"user","text":"a\tb"}',
    'window.x = {"role":"user","text":"x"};', 'f({"role":"user","text":"x"}, {"role":"bot","text":"y"})', "no brace }{",
    '{"role":"user","text":"\\u00e9\\ud83d\\ude00 \\u003c"}', '[{"role":"user","text":"Same"},{"role":"human","text":" same "},{"role":"bot","text":"same"}]',
]


def plain(kind, value):
    """By the parser: every walked object's role and text."""
    value = value.strip(embedded.SPACES)
    if kind != "application/json" and value[:1] not in ("{", "["):
        value = value[value.find("{") : value.rfind("}") + 1] if 0 <= value.find("{") < value.rfind("}") else ""
    loaded = providers._loads(value) if len(value) <= rules.MAX_SCRIPT else None
    return [(r, providers._trim(providers.structured_text(c).replace("\0", ""))) for r, c in providers.walk_json(loaded)]


@pytest.fixture(scope="module")
def scripts():
    rng = random.Random(5)
    values = BASE + [json.dumps(made(rng, 6), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(400)]
    return [(i // 3, i % 3, rng.choice(["application/json", "", None]) if i > len(BASE) else "", v) for i, v in enumerate(values)] + [(10**6, 0, None, None)]


def test_walk(spark, scripts):
    rows = embedded.walk(spark.createDataFrame(scripts, embedded._SCRIPTS)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.script, r.path)):
        got.setdefault((r.page_id, r.script), []).append((r.role, r.text))
    want = {(p, s): found for p, s, kind, value in scripts if value is not None and (found := plain(kind, value))}
    assert got.keys() == want.keys()
    for at in want:
        assert got[at] == want[at], at
    assert len(want) > 60


def test_messages_of_pages(spark, scripts):
    pages = [(i, f"<p>x</p><script type='application/json'>{v}</script><script>{w}</script>") for i, ((_, _, _, v), (_, _, _, w)) in enumerate(zip(scripts, scripts[1:])) if w is not None and "</" not in v + w and "\0" not in v + w]
    rows = embedded.json_messages(embedded.page_scripts(spark.createDataFrame(pages, "page_id long, html string"))).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.script, r.path)):
        got.setdefault(r.page_id, []).append((r.role, " ".join(r.text.split())))
    want = {i: [(m["role"], " ".join(m["text"].split())) for m in providers.script_messages(parse(html), "", "qwen")] for i, html in pages}
    want = {i: m for i, m in want.items() if m}
    # markup in a text is escaped and read again by the parser, which keeps its letters
    assert got == want and len(want) > 50


def test_no_rows(spark):
    empty = spark.createDataFrame([], embedded._SCRIPTS)
    assert embedded.json_messages(empty).count() == 0
    assert embedded.page_scripts(spark.createDataFrame([(1, None), (None, "<script>1</script>")], "page_id long, html string")).count() == 1


def test_walk_reads_a_script_once(spark):
    """Depth costs nothing: a text 17 lists deep is not read anew at each of them. Halves of surrogate pairs
    become signs that UTF-8 has, and what is nested too deep to be read has no rows."""
    size = min(rules.MAX_SCRIPT, rules.MAX_TEXT) - 1_000
    value = json.dumps({"a": nested({"role": "user", "text": "x" * size}, 17), "b": {"role": "user", "text": "y"}})
    odd = [(-1, 0, "", '{"role":"user","text":"a\\ud83d"}'), (-2, 0, "", "[" * 100_000 + "]" * 100_000), (-3, 0, "", json.dumps({"role": "user", "text": "z"}))]
    count = 1 + 30_000_000 // size
    df = spark.createDataFrame(odd, embedded._SCRIPTS).union(spark.range(count).crossJoin(spark.createDataFrame([(value,)], "v string")).selectExpr("id", "0", "''", "v"))
    began = time.monotonic()
    got = sorted(tuple(r) for r in embedded.walk(df).selectExpr("page_id", "path", "length(text)", "right(text, 1)").collect())
    took = time.monotonic() - began
    assert got[:2] == [(-3, [], 1, "z"), (-1, [], 2, "?")]
    assert got[2:] == [row for i in range(count) for row in ((i, [0] + [0] * 17, size, "x"), (i, [1], 1, "y"))]
    assert took < 20
