"""Node tables and relational parsing against the tree and the parser in one piece."""

import random

import pytest
from pyspark.sql import functions as F

from test_pages import PAGES
from turnloom.functions import rules
from turnloom.functions.dom import body, parse
from turnloom.operators import candidates, messages, nodes, providers

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "text only", "<p>a<p>b<div class='hidden x'><b>c</b></div>", "<nav><main><div class='prose'>A</div></main></nav>", "<table><tr><td>1<td>2</table>", '<i data-role="user"><b><u><s><em><q>deep</q></em></s></u></b></i>']


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").unionByName(spark.createDataFrame([(10**6 + i, h) for i, h in enumerate(ODD)], "page_id long, html string")).cache()


def trees(pages):
    for r in pages.collect():
        yield (r.page_id, *nodes.numbered(parse(r.html)))


def test_noise_by_interval(pages):
    got = {(r.page_id, r.nid): r.noise for r in nodes.inside(nodes.node_table(pages), "noise", nodes.matching(rules.NOISE_NODES)).collect()}
    want = {(p, i): n.closest(rules.NOISE_NODES) is not None for p, all_, _, _ in trees(pages) for i, n in enumerate(all_)}
    assert got == want and any(want.values())
    kept = nodes.without_noise(nodes.node_table(pages)).count()
    assert kept == sum(not v for v in want.values())


@pytest.mark.parametrize("selector", ["a, p", "[class*=t]", "li", "[href^='https']", ".hidden", "b, #main"])
def test_first_below(pages, selector):
    got = {(r.page_id, r.nid): r.found for r in nodes.first_below(nodes.node_table(pages), "found", nodes.matching(selector)).collect()}
    for page, all_, place, _ in trees(pages):
        for i, n in enumerate(all_):
            m = n.first(selector)
            assert got[page, i] == (None if m is None else place[id(m)])


def test_selectors_with_combinators_are_refused():
    with pytest.raises(ValueError):
        nodes.matching("div > p")


def test_role_by_ancestor(pages):
    got = {(r.page_id, r.nid): r.role for r in nodes.role_by_ancestor(nodes.node_table(pages), providers._HINTS).collect()}
    want = {(p, i): providers.role_hint(n, "") for p, all_, _, _ in trees(pages) for i, n in enumerate(all_)}
    assert got == want and len(set(want.values())) > 1


def claude_pages():
    rng = random.Random(8)
    long = "an answer that is certainly longer than forty characters, number "
    texts = ["Hi", "hi", "Privacy policy", "", *(long + str(i) for i in range(4)), long + "1 and more", "é " * 30]
    classes = ["font-user-message", "font-claude-message", "prose", "markdown x", "hidden", "", "font-claude-message prose"]
    made = [html for provider, html, _ in PAGES if provider == "claude"]

    def node(depth):
        attrs = rng.choice(["", ' data-test-render="true"', ' data-turn="user"', ' data-message-author-role="assistant"', ' data-turn="Claude"', ' aria-hidden="true"'])
        inside = rng.choice(texts) if depth == 0 or rng.random() < 0.4 else "".join(node(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f'<{rng.choice(["div", "div", "div", "nav", "p"])} class="{rng.choice(classes)}"{attrs}>{inside}</div>'

    for _ in range(150):
        wrap = rng.choice(["{}", "<main>{}</main>", "<header><main>{}</main></header>"])
        made.append(wrap.format("".join(node(rng.randrange(4)) for _ in range(rng.randrange(1, 6)))))
    return [*made, None, ""]


def test_relational_parser(spark):
    df = spark.createDataFrame([(i, f"https://claude.ai/share/{i}" if i % 2 else None, h) for i, h in enumerate(claude_pages())], "page_id long, url string, html string").repartition(3)
    rows = lambda made: {r.page_id: r for r in made.collect()}
    got, want = rows(candidates.parse_pages(df)), rows(providers.parse_pages(df, "claude"))
    assert got == want
    assert {len(r.messages) for r in want.values()} >= {0, 1, 2, 3}
    flat = candidates.candidate_rows(df)
    assert {r.stage for r in flat.select("stage").distinct().collect()} == {1, 2, 3, 4}
    assert flat.filter(F.col("first") > F.col("last")).count() == 0


def test_survivors(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc ") for _ in range(90)) for _ in range(6)]
    rows = []
    for i in range(200):
        t = rng.choice(base)
        a = rng.randrange(0, 40)
        rows.append((i % 3, rng.choice("ua"), i, t[a : a + rng.choice([20, 41, 45, 50, 90])]))
    rows += [(0, "u", 300, None), (0, "u", 301, ""), (0, "u", 302, "short"), (0, "u", 303, "short")]
    want = []
    for scope in sorted({r[:2] for r in rows}):
        kept = []
        for _, _, i, k in sorted((r for r in rows if r[:2] == scope), key=lambda r: r[2]):
            if k is not None and not any(providers.near_duplicate(o, k) for o in kept):
                kept.append(k)
                want.append((*scope, i))
    df = spark.createDataFrame([r for r in rows if r[3] is not None], "conv int, role string, id long, key string")
    pairs = messages.near_duplicate_pairs(df, ["conv", "role"], "id", "key")
    brute = {(r[0], r[1], r[2], o[2]) for r in rows for o in rows if r[:2] == o[:2] and r[2] != o[2] and r[3] and o[3] and len(r[3]) > 40 and len(o[3]) > 40 and r[3] in o[3]}
    assert {tuple(p) for p in pairs.collect()} == brute
    got = candidates.near_duplicate_survivors(pairs, df, ["conv", "role"], "id", "key")
    assert sorted(tuple(r) for r in got.select("conv", "role", "id").collect()) == sorted(want)
