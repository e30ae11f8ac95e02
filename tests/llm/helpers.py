"""Small documents with every awkward case: nulls, empties, ties, repeated rows, clashing extra columns."""

LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, key string, start long, spans string, items string, cut string, _k string, _h string, _spans string, _kept string, _p string, _range string, _coarse string, _above string, _in string, score string, removed string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None if k % 5 == 4 else ("en" if k % 2 else "de"), "s", len(t or ""), 7, "k", 3, "s", "i", "c", *"abcdefghijk") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


AWKWARD = [None, "", "   \n\t ", "One.", "ÀÉ ß 漢字 😀 éa.", LONG, "Same text here, word for word, in both of these rows and with enough words.", "Same text here, word for word, in both of these rows and with enough words.", "123 456 !!!"]
AWKWARD_IDS = [None, 1, 2, 3, 4, 5, 6, 7, 7]
