"""Null, repeated and string keys, and texts of very many template words."""

import corpus_pipeline as cp
import pytest

from tessitura.llm import benchmark, fingerprints, language, licenses

A = " ".join(f"word{i % 37} other{i}" for i in range(60))
NEAR = A.replace("other30 ", "")
OTHER = " ".join(f"unlike{i} text{i * 7}" for i in range(60))


def docs(spark, rows, kind="long"):
    cast = (lambda k: None if k is None else f"k{k}") if kind == "string" else (lambda k: k)
    return spark.createDataFrame([(cast(k), t, "en", "s", 5) for k, t in rows], f"doc_id {kind}, text string, lang string, source string, n_chars long").repartition(3)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_keep_unrelated_texts_of_one_key(spark, kind):
    rows = [(1, A), (2, NEAR), (2, OTHER), (None, OTHER + " and more of it"), (None, None), (None, ""), (3, A), (3, A), (4, "alone"), (4, "alone")]
    out = cp.drop_near_duplicates(spark, docs(spark, rows, kind), "/root/testdata/sf0.001")
    texts = sorted((r["text"] or "") for r in out.collect())
    assert out.columns == docs(spark, [], kind).columns
    assert sum(t in (A, NEAR) for t in texts) == 1 and sum(t.startswith(OTHER) for t in texts) == 1 and texts.count("alone") == 1 and texts.count("") == 1
    groups = [(r["doc_id"], r["component_id"]) for r in fingerprints.similar_documents(docs(spark, rows, kind)).collect()]
    assert len(groups) == len(rows) and {c for k, c in groups if k in (3, "k3")} == {1 if kind == "long" else "k1"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_contamination_by_row(spark, kind):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"pre {item} post"), (7, f"{item}"), (7, "clean text it is"), (None, "clean too"), (8, item), (8, item)]
    got = sorted((r["n_words"], r["n_hit"], r["contaminated"], r["n_items"]) for r in benchmark.contamination(docs(spark, rows, kind), bench).collect())
    assert got == [(2, 0, False, 0), (4, 0, False, 0), (11, 11, True, 1), (11, 11, True, 1), (11, 11, True, 1), (13, 11, True, 1)]


def test_stage_drops_only_what_leaks(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(None, item), (5, item), (5, "a clean row of the same key"), (None, "another clean row"), (6, None)]
    left = cp.drop_contaminated(spark, docs(spark, rows), sf).collect()
    assert sorted((r["text"] or "") for r in left) == ["", "a clean row of the same key", "another clean row"]


def test_every_label_is_learned_whatever_its_keys(spark):
    """All rows of one key, all of them left out by a draw by key alone, still teach their language."""
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog and runs", "en") for i in range(4000)] + [(k, f"le petit chien {i} mange une pomme dans la cuisine avec eux", "fr") for k in (11, 12) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bound in (20, 3000):
        model = language.fit(table, rows_per_lang=bound)
        assert model["langs"] == ["en", "fr"] and all(len(p[1]) > 20 for p in model["logp"])
        got = {r["lang_pred"] for r in language.predict(table.where("lang = 'fr'"), model).collect()}
        assert got == {"fr"}


def test_very_many_license_words(spark, frame):
    """680 kB of one template's sentence, and a text of only common template words: linear, and exact."""
    said = licenses.TEMPLATES[0][1]
    rows = {r["doc_id"]: r for r in licenses.scan(frame([f"{said} " * 4000, "the of and to " * 30000, f"{said} x"])).collect()}
    words = (said + " ") * 4000
    places, n = words.split(), 0
    for _, own, need, width in licenses.table():
        own, held = set(own), {}
        for i, w in enumerate([*places, *[None] * width]):  # a window that slides over the text
            if w in own:
                held[w] = held.get(w, 0) + 1
            if i >= width:
                out = places[i - width]
                if out in own:
                    held[out] -= 1
                    if not held[out]:
                        del held[out]
            if i >= width - 1 and i - width + 1 < len(places) and places[i - width + 1] in own and len(held) >= need:
                n += 1
    assert rows[0]["n_blocks"] == n > 100_000 and rows[0]["labels"] == "mit" and rows[1]["n_blocks"] == 0 and rows[2]["labels"] == "mit"
