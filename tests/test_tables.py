"""Table functions in SQL, and the source and sink of single documents."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from test_pages import PAGES
from turnloom.functions.dom import parse
from turnloom.operators import nodes, providers, table_functions
from turnloom.sources import documents


@pytest.fixture
def pages(spark):
    table_functions.register(spark)
    rows = [(i, None, html, provider) for i, (provider, html, _) in enumerate(PAGES)]
    rows += [(100, "https://grok.com/share/x", None, "grok"), (101, None, "", "qwen"), (102, "https://CHATGPT.com/x", PAGES[6][1], "chatgpt")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, provider string")
    df.createOrReplaceTempView("stored_pages")
    return df


def messages_of(parsed):
    return sorted((r.page_id, r.provider, k, m.role, m.html, m.text, m.thought) for r in parsed.collect() for k, m in enumerate(r.messages))


def test_lateral_equals_parser(spark, pages):
    got = spark.sql("SELECT page_id, m.* FROM stored_pages, LATERAL parse_messages(html, url) m")
    assert sorted((r.page_id, r.provider, r.pos, r.role, r.html, r.text, r.thought) for r in got.collect()) == messages_of(providers.parse_pages(pages.drop("provider")))
    for provider in ("qwen", "claude"):
        got = spark.sql(f"SELECT page_id, m.* FROM stored_pages, LATERAL parse_messages(html, url, '{provider}') m")
        assert sorted((r.page_id, r.provider, r.pos, r.role, r.html, r.text, r.thought) for r in got.collect()) == messages_of(providers.parse_pages(pages.drop("provider"), provider))


@pytest.mark.parametrize("call", ["parse_messages(page_id)", "parse_messages(html, page_id)", "parse_messages(html, url, 'bard')", "page_nodes(1)"])
def test_wrong_arguments_fail_in_analysis(spark, pages, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM stored_pages, LATERAL {call}")


def test_lateral_nodes(spark, pages):
    got = spark.sql("SELECT page_id, n.nid, n.parent, n.last, n.tag, n.attrs FROM stored_pages, LATERAL page_nodes(html) n")
    rows = lambda df: sorted((r.page_id, r.nid, r.parent, r.last, r.tag, sorted(r.attrs.items())) for r in df.collect())
    assert rows(got) == rows(nodes.node_table(pages))
    text = spark.sql("SELECT n.text FROM VALUES ('<p>a<b>b</b>c</p>') AS t(html), LATERAL page_nodes(html) n WHERE n.tag = 'p'").first()[0]
    assert text == "ac" and parse("<p>a<b>b</b>c</p>").text() == "abc"


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_documents_there_and_back(spark, tmp_path):
    documents.register(spark)
    path = str(tmp_path / "docs")
    rows = [(f"doc-{i}", f"<p>Ünï {i}</p>" * (i % 5)) for i in range(40)] + [("none", None)]
    df = spark.createDataFrame(rows, "name string, document string").repartition(4)
    df.write.format(documents.NAME).mode("append").save(path)
    assert files(path) == sorted(f"{n}.html" for n, _ in rows)
    for size in (1, 300, 1 << 20):
        found = spark.read.format(documents.NAME).option("partitionBytes", size).load(path)
        assert sorted((os.path.basename(r.path), r.size, r.html) for r in found.collect()) == sorted((f"{n}.html", len((d or "").encode()), d or "") for n, d in rows)
    df.limit(2).write.format(documents.NAME).mode("overwrite").save(path)
    assert len(files(path)) == 2
    (tmp_path / "docs" / "bad.html").write_bytes(b"a\xffb")
    assert spark.read.format(documents.NAME).load(path).filter(F.col("html").contains("�")).count() == 1


@pytest.mark.parametrize("bad", ["../up", "a/b", "", None, "_hidden", "same"])
def test_failed_jobs_show_nothing(spark, tmp_path, bad):
    documents.register(spark)
    path = str(tmp_path / "docs")
    df = spark.createDataFrame([(f"d{i}", "x") for i in range(8)] + [("same", "y"), (bad, "z")], "name string, document string").repartition(3)
    with pytest.raises(Exception):
        df.write.format(documents.NAME).mode("append").save(path)
    assert [f for f in files(path) if not f.startswith("_job-")] == []


def test_only_committed_attempts_count(tmp_path, monkeypatch):
    """A task fails half-way and is tried again; another one runs twice."""

    class Attempt:
        number = 0

        @classmethod
        def get(cls):
            return cls

        @classmethod
        def taskAttemptId(cls):
            return cls.number

    monkeypatch.setattr(documents, "TaskContext", Attempt)
    path = str(tmp_path / "docs")
    writer = documents._Writer(path, ".html", False)

    def attempt(names, fail=False):
        Attempt.number += 1

        def rows():
            for n in names:
                yield Row(name=n, document=f"{n} {Attempt.number}")
            if fail:
                raise RuntimeError

        return writer.write(rows())

    with pytest.raises(RuntimeError):
        attempt(["a", "b"], fail=True)
    first, _, other = attempt(["a", "b"]), attempt(["c"]), attempt(["c"])
    assert [f for f in files(path) if "_job" not in f] == []
    writer.commit([first, other, None])
    assert files(path) == ["a.html", "b.html", "c.html"]
    assert (tmp_path / "docs" / "c.html").read_text() == "c 4"
    late = documents._Writer(path, ".html", False)
    writer = late
    attempt(["d"])
    late.abort([None])
    assert files(path) == ["a.html", "b.html", "c.html"]
