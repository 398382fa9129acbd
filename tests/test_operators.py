"""Every registered query of the library runs; those with SQL agree with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from turnloom.functions import text
from turnloom.operators import admission, capture, guides, providers, render
from turnloom.plans import catalog
from turnloom.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(repr(r[i]) for i in order) for r in values])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name])
        assert found == rows([d[0] for d in want.description], want.fetchall())


def test_links_one_by_one(spark):
    links = spark.createDataFrame([(u,) for u in (*catalog.LINKS, None)], "url string")
    got = {r.url: (r.provider, r.status) for r in admission.admit(links).collect()}
    assert got["https://GROK.com/share/x/"] == ("grok", 200) and got["https://gemini.google.com:8443/share/x"] == ("gemini", 200)
    assert got["https://chat.qwen.ai/share/x"][1] == 400 and got["https://chatgpt.com/share/e/x"][1] == 400 and got["http://claude.ai/share/abc"][1] == 400
    assert got["nope"] == ("unknown", 400) and got[None] == ("unknown", 400)


def test_text_expressions(spark):
    row = spark.createDataFrame([("Ａ\xa0b​", "a﻿ \nb ")], "k string, c string")
    assert row.select(text.dedupe_key("k"), text.collapse("c"), text.escape_html(text.collapse("c"))).first()[:2] == ("a b", "a b")
    df = spark.range(1).select(text.escape_html(text.F.lit("<a & \"b\">")).alias("e"), text.normalize_role(text.F.lit("focus errand")).alias("r"))
    assert tuple(df.first()) == ("&lt;a &amp; &quot;b&quot;&gt;", "user")


def test_pages_to_files(spark, tmp_path):
    html = '<title>Plan | Shared Claude</title><main><div class="font-user-message">Hi</div><div class="font-claude-message"><p>Hello</p></div></main>'
    pages = spark.createDataFrame([(1, "https://claude.ai/share/a", html), (2, None, None), (3, "", "<p>x</p>")], "page_id long, url string, html string")
    made = render.render(providers.assemble(providers.parse_pages(pages), "2024-02-29"), standalone=True)
    got = {r.page_id: r for r in made.collect()}
    assert got[1].title == "Plan" and got[1].date == "Thursday, February 29, 2024" and "<p>Hello</p>" in got[1].document
    assert got[2].error == got[3].error and got[2].document is None
    tables.write_conversations(made.drop("document"), str(tmp_path / "c"))
    tables.write_errors(made, str(tmp_path / "e"))
    tables.write_documents(made, str(tmp_path / "d"))
    assert [spark.read.json(str(tmp_path / "c")).count(), spark.read.parquet(str(tmp_path / "e")).count(), spark.read.parquet(str(tmp_path / "d")).count()] == [1, 2, 1]


def test_site_map_and_guides(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://x.test/</loc><lastmod>2024-01-02</lastmod><changefreq>weekly</changefreq><priority>1.0</priority></url></urlset>")
    assert tables.read_sitemap(spark, str(tmp_path / "s.xml")).first().priority == 1.0
    (tmp_path / "g.json").write_text('[{"slug":"a","title":"A | x","relatedSlugs":["b","c"]},{"slug":"b","title":"B"}]')
    assert [r.slug for r in tables.read_guides(spark, str(tmp_path / "g.json")).orderBy("position").collect()] == ["a", "b"]


def test_large_ids_beside_null_ids_stay(spark):
    html = '<main><div class="font-user-message">Hi</div></main>'
    pages = spark.createDataFrame([(1152921504606846977, "", html), (None, None, html)], "page_id long, url string, html string").coalesce(1)
    got = providers.assemble(providers.parse_pages(pages), "2024-02-29").collect()
    assert {r.page_id for r in got} == {1152921504606846977, None}
    assert [m.text for r in got for m in r.messages] == ["Hi", "Hi"]


def test_guides_of_one_slug_are_taken_in_order(spark):
    rows = [(2, "a", "T2 | x", ["a"]), (1, "a", "T9 | x", ["b", "a"]), (3, "b", "B", None)]
    df = spark.createDataFrame(rows, "position long, slug string, title string, related_slugs array<string>")
    assert guides.guide(df, "a").first().title == "T9 | x" and guides.guide(df, "c").count() == 0
    assert sorted(tuple(r) for r in guides.related(df).collect()) == [("a", 0, "a", "T9"), ("a", 0, "b", "B"), ("a", 1, "a", "T9")]


def test_guide_files_keep_their_order(spark, tmp_path):
    for name, slugs in (("1.json", "ab"), ("2.json", "cde"), ("3.json", "")):
        (tmp_path / name).write_text("[" + ",".join(f'{{"slug":"{s}"}}' for s in slugs) + "]")
    assert [(r.position, r.slug) for r in tables.read_guides(spark, str(tmp_path)).orderBy("position").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_captures(spark):
    assert capture.snapshot_of("<p>nothing shared</p>") == "" and capture.snapshot_of(None) == ""
    page = '<title> T </title><div class="share-layout-messages"><p>a</p><button>b</button></div>'
    assert capture.snapshot_of(page, 'u"').endswith('<body><div class="share-layout-title">T</div><div class="share-layout-date"></div><div class="share-layout-messages"><p>a</p></div></body></html>')
    turns = "<section data-turn='user'>Q</section><section data-turn='user'>Q</section><section data-turn='user'> </section><div data-testid='conversation-turn-2'>A<nav>x</nav></div>"
    pages = spark.createDataFrame([(1, "u", turns), (2, None, "<p>none"), (None, None, None)], "page_id long, url string, html string")
    got = capture.captured(capture.page_turns(pages)).orderBy("pos").collect()
    assert [(r.page_id, r.html) for r in got] == [(1, '<section data-turn="user">Q</section>'), (1, '<div data-testid="conversation-turn-2">A</div>')]
    made = {r.page_id: r.html for r in capture.synthetic_pages(capture.page_turns(pages), capture.page_heads(pages)).collect()}
    assert made[2].endswith('<main data-provider="chatgpt"></main></body></html>') and set(made) == {1, 2, None}
