import pytest

#: Null, empty, wordless, very long, repeated and clashing cases; ids repeat and one is null.
LONG = "Long words go on and on here. " * 4000
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "x" * 200_000), (6, "1 " * 3000), (7, "A short one."), (7, "A short one."), (7, "Another text of the same id."),
    (None, "No id has this text, but it has some words in it."), (None, "No id has this text, but it has some words in it."), (8, "日本語のテキスト、句読点。😀"), (9, "\x00﻿ odd marks  here"),
]
CLASHING = "doc_id bigint, text string, n_words string, hits int, Items string, score string, ids int, n_tokens string, candidates int, spans string, kept string, measures int, votes string, posterior string, lang_pred int, lang string, source string, attention int, key string, id string, in_0 string"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with many columns whose names the operators use themselves."""
    extra = [None if " int" in c else "own" for c in CLASHING.split(", ")[2:]]
    return spark.createDataFrame([(i, t, *extra) for i, t in TEXTS], CLASHING)


@pytest.fixture(scope="session")
def plain(odd):
    return odd.select("doc_id", "text")
