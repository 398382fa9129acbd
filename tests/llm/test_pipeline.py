import hashlib
import random
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from turnloom.llm import bpe

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_near(docs):
    """Ids kept: the smallest of every component of links."""
    sets, root = {d[0]: shingles(d[1]) for d in docs}, {d[0]: d[0] for d in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def plain_mix(docs):
    """Copies of every document, by sorting each source as a whole."""
    size = {d[0]: len(WORD.findall((d[1] or "").encode())) for d in docs}
    names = sorted({d[3] for d in docs if d[3] is not None}, key=lambda s: s.encode()) + ([None] if any(d[3] is None for d in docs) else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    whole = {s: sum(size[d[0]] for d in docs if d[3] == s) for s in names}
    left, open_, target = 1.5 * sum(whole.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * whole[s]]
        for s in over or list(open_):
            target[s] = 2.0 * whole[s] if over else level * weight[s]
            left -= target[s]
            open_.remove(s)
    copies = {}
    for s in names:
        own = [d[0] for d in docs if d[3] == s]
        certain = int(target[s] // whole[s]) if whole[s] else 0
        f = target[s] / whole[s] - certain if whole[s] else 0
        copies |= {i: certain for i in own}
        if f <= 0:
            continue
        u = {i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for i in own}
        gap, rest = target[s] - certain * whole[s], sorted(own, key=lambda i: (u[i] / (1 - u[i]) / (f / (1 - f)), i))
        for _ in range(3):
            start, total, taken = gap, 0, []
            for i in rest:
                if 0 < size[i] <= start:
                    total += size[i]
                    if total > start:
                        break
                    taken.append(i)
            for i in taken:
                copies[i] += 1
                gap -= size[i]
            rest = [i for i in rest if i not in taken]
    return copies


def documents():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["the", "ing", "sch", "é", "ado", "tion"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.choice([3, 20, 80, 200]))) for _ in range(50)]
    rows = []
    for i in range(140):
        t = rng.choice(texts)
        if rng.random() < 0.4 and len(t) > 150:
            parts = t.split(" ")
            parts[rng.randrange(len(parts))] = word()
            t = " ".join(parts)
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "12 34 !"), (203, "Short"), (204, "short"), (205, " \n")]
    langs = ["en", "de", "fr", None]
    return [(i, t, rng.choice(langs), rng.choice(["a", "b", "c", "c", "c", None]), len(t or "")) for i, t in rows]


def test_stages_against_plain_versions(spark, tmp_path):
    docs = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    best = {}
    for d in kept:
        best[d[1]] = max(best.get(d[1], -1), d[0])
    exact = [d for d in kept if best[d[1]] == d[0]]
    near = plain_near(exact)
    unique = [d for d in exact if d[0] in near]
    copies = plain_mix(unique)
    after, frame = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.cut(stage(spark, frame, str(tmp_path)))
        assert frame.columns == [c.split(" ")[0] for c in schema.split(", ")]
        after.append(sorted((tuple(r) for r in frame.collect()), key=str))
    assert after[0] == sorted(kept, key=str)
    assert after[1] == sorted(exact, key=str)
    assert after[2] == sorted(unique, key=str)
    mixed = sorted((d for d in unique for _ in range(copies[d[0]])), key=str)
    assert after[3] == mixed
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for d in mixed:
        ids = theirs.encode_ordinary(d[1])
        want.append((d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d[1].encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_names_that_stages_use(spark, tmp_path):
    names = ["lang_pred", "score", "_row", "_copy", "row", "copies", "Kept"]
    docs = [(*d, *(f"{n} {d[0]}" for n in names)) for d in documents()]
    docs += [(None, "Words of a text without an id", "en", "a", 0, *names), (None, "Words of a text without an id", "en", "a", 0, *names), (300, "long " * 60_000, "en", "b", 0, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame(docs, schema).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    given, frame = {tuple(d) for d in docs}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.cut(stage(spark, frame, str(tmp_path)))
        rows = [tuple(r) for r in frame.collect()]
        assert frame.columns == [c.split(" ")[0] for c in schema.split(", ")]
        assert rows and set(rows) <= given
    assert sum(r[0] is None for r in rows) in (0, 1, 2)


def test_runs_at_once_and_results_read_late(spark, tmp_path):
    """Two runs in one process, and a stage's result read after the next stage has run."""
    from concurrent.futures import ThreadPoolExecutor

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents(), schema).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda _: sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), range(2))
    assert one == two and one
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.exact_dedup(spark, docs, "")
    second = corpus_pipeline.near_dedup(spark, first, "")
    third = corpus_pipeline.mix(spark, second, "")
    assert first.count() > second.count() > 0 and third.count() > 0
