import random
import zlib

from pyspark.sql import functions as F

from turnloom.llm import langid

SYLLABLES = {
    "en": "the ing and tion ed er th st re on".split(), "de": "ung sch der ein lich keit über zu ge ber".split(),
    "fr": "é eau que tion oi ou le ment aux è".split(), "es": "ción ñ ado que os mente ar la ez ó".split(), "fi": "kk aa ssa en minen yy ö ä uo ti".split(),
}
SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        lang = rng.choice(["en", "en", "en", "de", "fr", "es", "fi"])
        rows.append((i, text(rng, lang, rng.choice([8, 40, 300])), lang if rng.random() < 0.9 else None))
    rows += [(1001, None, "en"), (1002, "", "de"), (1003, "12 !? 34", "en"), (None, text(rng, "de", 50), "de"), (1004, text(rng, "fr", 30_000), "fr"), (7, text(rng, "es", 9), "es")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), rows


def test_held_out_accuracy_and_odd_rows(spark):
    df, rows = table(spark)
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(df).collect()}
    all_rows = langid.identify(df).collect()
    assert len(all_rows) == len(rows)
    by = {r.doc_id: r for r in all_rows if r.doc_id != 7}
    right = seen = 0
    for i, t, lang in rows:
        if i in by and lang and t and any(c.isalpha() for c in t):
            assert by[i].held_out == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
            if by[i].held_out:
                seen, right = seen + 1, right + (by[i].lang_pred == lang)
        if i in by:
            assert 0 <= by[i].score <= 1
    assert seen > 80 and right / seen > 0.97
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1001, 1002, 1003))
    assert by[None].lang_pred == "de" and by[1004].lang_pred == "fr"
    assert got


def test_prediction_uses_text_alone_and_reruns_agree(spark):
    df, _ = table(spark)
    model = langid.fit(df, ~langid.held_out())
    pairs = lambda d: sorted((r.doc_id or -1, r.lang_pred, round(r.score, 9)) for r in langid.predict(d, model, ["doc_id"]).collect())
    assert pairs(df) == pairs(df.withColumn("lang", F.lit("fr")).repartition(7))


def test_margins_count_whole_texts(spark):
    df, _ = table(spark)
    model = langid.fit(df)
    import numpy as np

    texts = [text(random.Random(k), lang, 50).encode() for k, lang in enumerate(SYLLABLES)] + [b"a", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for row, t in zip(model.margins(data, offsets), texts):
        want = model.weights @ langid._shares(np.frombuffer(t, np.uint8)) + model.bias
        assert np.allclose(row, want, atol=1e-4)


def test_nothing_to_learn_from(spark):
    df, _ = table(spark)
    assert langid.identify(df.limit(0)).count() == 0
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = langid.identify(df.filter("lang = 'en'"))
    assert {r.lang_pred for r in one.collect()} == {"en", "und"}


def test_votes_and_margins_against_a_plain_version(spark):
    df, rows = table(spark)
    model = langid.fit(df, ~langid.held_out())
    weights, bias = model.weights.astype(float), model.bias.astype(float)

    def feature(run):
        key = 0
        for b in run:
            key = (key * 16777619 & 0xFFFFFFFF) ^ (b + 1)
        return ((key ^ (key >> 15)) * 2246822519 & 0xFFFFFFFF) >> 19

    def plain(text):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        margin = bias.copy()
        for n in range(1, 5):
            runs = [data[i : i + n] for i in range(len(data) - n + 1)]
            for run in runs:
                margin += weights[:, feature(run)] / len(runs)
        m = dict(zip(model.machines, margin))
        family = max(sorted({langid.family_of(v) for v in model.langs}), key=lambda f: m["family", f, None])
        inside = [v for v in model.langs if langid.family_of(v) == family]
        won = {v: [0, 0.0] for v in inside}
        for (kind, a, b), value in m.items():
            if kind == "pair" and a in inside:
                won[a if value > 0 else b][0] += 1
                won[a][1] += value
                won[b][1] -= value
        return max(inside, key=lambda v: won[v])

    few = [r for r in rows if r[0] is not None and r[0] < 120 and r[0] != 7]
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model, ["doc_id"]).collect() if r.doc_id in {f[0] for f in few}}
    assert got == {i: plain(t) for i, t, _ in few}
