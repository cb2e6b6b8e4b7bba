import zlib

import pytest

from hushlake.llm.language import drop_unidentified, fit, gram_counts, identify, predictor
from hushlake.sources.tables import table
from tests.llm.conftest import documents


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (r.score == 0) for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_odd_documents(odd_documents, odd_rows, no_documents):
    rows = identify(odd_documents).collect()
    assert len(rows) == len(odd_rows)
    said = {(r.doc_id, r.lang_pred) for r in rows}
    assert {(5, "und"), (6, "und"), (7, "und"), (14, "und")} <= said
    learned = {lang for i, t, lang, _ in odd_rows if lang and t and zlib.crc32(str(i).encode()) % 5}
    assert {lang for _, lang in said} <= learned | {"und"}
    assert [r.held_out for r in rows if r.doc_id is None] == [True, True]
    kept = drop_unidentified(odd_documents)
    assert kept.columns == odd_documents.columns and kept.filter("text is null or doc_id in (6, 7, 14)").count() == 0
    assert identify(no_documents).count() == drop_unidentified(no_documents).count() == 0


def test_learns_only_from_labelled_rows_that_are_not_held_out(spark):
    rows = [(n, f"wort und {n} das", "de") for n in range(40)] + [(n, "mot et le", "fr") for n in range(40, 80) if zlib.crc32(str(n).encode()) % 5 == 0]
    model = fit(documents(spark, [*rows, (99, "without a label", None), (98, None, "xx"), (97, "...", "yy")]))
    assert set(model.langs) == {"de"}


def test_far_texts_are_rejected(spark):
    rows = [(n, f"the house and the river with {n} trees over there", "en") for n in range(60)]
    docs = documents(spark, [*rows, (1000, "жук цвет щит бык", None)])
    said = {r.doc_id: r for r in identify(docs).collect()}
    assert said[1000].rejected and said[1000].lang_pred == "en" and not any(said[n].rejected for n in range(60))
    assert drop_unidentified(docs).count() == 60


def test_too_many_labels_fail(spark, monkeypatch):
    monkeypatch.setattr("hushlake.llm.language.MAX_LANGUAGES", 1)
    docs = documents(spark, [(n, f"text {n}", "en" if n % 2 else "de") for n in range(40)])
    with pytest.raises(ValueError, match="distinct values"):
        fit(docs)


def test_no_labels(spark):
    docs = documents(spark, [(1, "some text", None)])
    assert identify(docs).first().lang_pred == "und"


def test_counts_do_not_depend_on_neighbours_or_slabs(monkeypatch):
    import pyarrow as pa

    texts = ["Ab cd", "", None, "x" * 50 + " éé y", "zz  ..  zz"]
    whole = gram_counts(pa.array(texts))
    alone = [gram_counts(pa.array([t], pa.string()))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(whole, alone, strict=True))
    monkeypatch.setattr("hushlake.llm.language.SLAB", 7)
    assert (gram_counts(pa.array(texts)) == whole).all()
    assert callable(predictor)


def test_every_centroid_has_its_share_of_texts():
    import numpy as np

    from hushlake.llm.language import LEAST_TEXTS, _clusters

    draw = np.random.default_rng(1)
    middles = np.eye(3, 40)
    vectors = np.concatenate([m + draw.normal(0, 0.05, (60, 40)) for m in middles] + [np.eye(40)[30:33]])  # three outliers
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    centroids, likeness = _clusters(vectors, 4)
    sizes = np.bincount(likeness.argmax(axis=1), minlength=len(centroids))
    assert 1 < len(centroids) <= 4 and sizes.min() >= LEAST_TEXTS * len(vectors)
    again, _ = _clusters(vectors, 4)
    assert (again == centroids).all()
    assert len(_clusters(np.repeat(vectors[:1], 5, axis=0), 4)[0]) == 1


def plain_model(rows):
    """Idf, and the drawn texts of each language, from the rule: rows are (doc_id, text, lang), with distinct ids."""
    import math

    import numpy as np
    import pyarrow as pa

    learned = [(i, t, lang) for i, t, lang in rows if lang and t and zlib.crc32(str(i).encode()) % 5]
    counts = {i: gram_counts(pa.array([t], pa.string()))[0] for i, t, _ in learned}
    seen = sum((c > 0).astype(int) for c in counts.values())
    idf = [math.log((1 + len(learned)) / (1 + int(n))) + 1 for n in seen]
    vectors = {}
    for i, _, lang in learned:
        weights = [math.log1p(float(n)) * w for n, w in zip(counts[i], idf, strict=True)]
        norm = math.sqrt(sum(w * w for w in weights))
        vectors.setdefault(lang, []).append(np.array(weights) / norm)
    return idf, vectors


def test_model_and_prediction_against_the_plain_formulas(spark, sf_dir):
    import numpy as np
    import pyarrow as pa

    docs = table(spark, sf_dir, "documents").limit(120)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    docs = documents(spark, rows)
    model = fit(docs)
    idf, vectors = plain_model(rows)
    assert np.allclose(model.idf, idf, atol=1e-5) and set(model.langs) == set(vectors)
    for lang in vectors:  # every centroid is the direction of the sum of the texts nearest to it
        own = model.centroids[[name == lang for name in model.langs]]
        nearest = [int(np.argmax(own @ v)) for v in vectors[lang]]
        for c, centroid in enumerate(own):
            total = sum(v for v, n in zip(vectors[lang], nearest, strict=True) if n == c)
            assert np.allclose(centroid, total / np.linalg.norm(total), atol=1e-3)
    said = {r.doc_id: r for r in identify(docs, model).collect()}
    for i, text, _ in rows:
        weights = np.log1p(gram_counts(pa.array([text], pa.string()))[0]) * idf
        likeness = model.centroids @ weights / max(np.linalg.norm(weights), 1e-12)
        best = int(np.argmax(likeness))
        assert abs(said[i].score - np.clip(likeness[best], 0, 1)) < 1e-4
        assert said[i].lang_pred == model.langs[best] and said[i].rejected == (likeness[best] < model.floors[best])
