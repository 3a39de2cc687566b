from surveyspark.llm import jaccard_join, language_id

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the farm where the children play all day "
FR = "le renard brun saute par dessus le chien paresseux et puis il court loin de la ferme ou les enfants jouent "


def corpus(spark, lang=True):
    rows = [(i, (EN if i % 2 else FR) * (2 + i % 3) + f" {i}", ("en" if i % 2 else "fr") if lang else None) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_numerals_are_no_letters(ready):
    docs = ready.createDataFrame([(1, "² ½ 12 Ⅷ _"), (2, "a"), (3, "é"), (4, "字"), (5, "ª")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.learn(corpus(ready))).collect()}
    assert got[1] == "und" and all(got[i] in ("en", "fr") for i in (2, 3, 4, 5))


def test_without_a_learned_language_all_documents_stay(ready):
    assert language_id.keep_known(corpus(ready, lang=False)).count() == 400


def test_texts_that_no_learned_language_explains_go(ready):
    import random
    random.seed(1)
    odd = [(1000, "".join(random.choice("qxzjkwvö漢字かなЖЩЫ") for _ in range(2000)), None), (1001, "zq", None), (1002, EN * 50, None), (1003, "12 !", None)]
    docs = corpus(ready).unionByName(ready.createDataFrame(odd, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language_id.keep_known(docs).collect()}
    assert kept == set(range(400)) | {1001, 1002}


def test_one_of_each_class_stays_whatever_the_frame_is(ready, tmp_path, monkeypatch):
    """From files or not, with few or many places to drop, and ties of equal rows."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, a, "x"), (3, a, "y"), (3, a, "y"), (5, b, "x"), (9, b + " more", None), (7, None, "n"), (7, None, "n"), (8, "", "e"), (None, a, "z")]
    df = ready.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"file://{tmp_path}/d")
    want = sorted([(3, a, "y"), (5, b, "x"), (7, None, "n"), (8, "", "e"), (None, a, "z")], key=str)
    for small in (500_000, 0):
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        for docs in (df, ready.read.parquet(f"file://{tmp_path}/d")):
            assert sorted((tuple(r) for r in jaccard_join.keep_one(docs).collect()), key=str) == want
