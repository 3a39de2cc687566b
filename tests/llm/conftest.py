import pytest


@pytest.fixture(scope="session")
def ready(spark):
    from surveyspark.session import ensure_checkpoint_dir, ship_package
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


@pytest.fixture()
def odd_docs(ready):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    text = " ".join(words * 3)
    rows = [
        (1, text + " call +1 (212) 555-0153 now", "en", "a", 10),
        (2, text + " call +1 (212) 555-0153 now", "en", "a", 10),
        (2, text + " call +1 (212) 555-0153 now", "en", "a", 10),
        (3, None, "en", None, None),
        (4, "", None, "a", 0),
        (5, " \t\n ", "fr", "a", 3),
        (None, "voici un texte sans identifiant et assez long", "fr", "a", 45),
        (6, "x" * 200_000, "en", "a", 200_000),
        (7, "mot " * 30_000, "fr", "a", 120_000),
        (8, "1234 !!", "de", "a", 7),
        (9, "der die das und ist nicht mit von 日本語 🎉", None, "a", 40),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = ready.createDataFrame(rows, schema)
    for name in ("score", "ids", "base", "key", "rate", "node", "lang_pred", "llm"):
        df = df.selectExpr("*", f"'kept' as {name}")
    return df


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
