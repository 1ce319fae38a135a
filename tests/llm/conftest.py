import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, doc long, at int, w string, start int, fp long, found string, spans string, bucket int"


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", None, 1, 2, "w", 3, 4, "f", "x", 5) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table with further columns whose names clash with inner ones."""
    return lambda texts, ids=None: spark.createDataFrame(rows_of(texts, ids), DOC).repartition(3)


@pytest.fixture(scope="session")
def texts(spark, sf):
    """All texts of the small table, by key, followed by edge cases."""
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = [got[k] for k in sorted(got)]
    out += [None, "", " \t\n ", "...!?", out[3], out[3], out[5] + " " + out[6], "É" * 50 + " ſtoken K ß 日本", "a " * 3000, "word " * 19, "x", "\x00\x01", out[7][:300] + out[8][:300]]
    return out
