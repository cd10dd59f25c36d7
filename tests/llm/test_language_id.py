import math

from pyspark.sql import functions as F

from pathloom.llm import language_id as l


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = l.fit(docs.where(~l.held_out(F.col("doc_id"))))
    found = l.identify(docs, model).where(l.held_out(F.col("row.doc_id")))
    right, n, rejected = found.agg(F.avg((F.col("lang_pred") == F.col("row.lang")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 150 and right > 0.98 and rejected <= 2
    assert len(model.languages) == 4 and 4 <= model.centroids.shape[1] <= 4 * l.CENTROIDS
    for text in ("Это совсем другой язык, которого модель не видела.", "これは日本語の文章です。", "qxz jqv zzx vvk wqp xxj"):
        assert model.predict(text)[2]
    for text in ("The", "und", "12 !", ""):
        lang, score, rejected = model.predict(text)
        assert 0 <= score <= 1 and (lang == "und") == (text in ("12 !", ""))


def test_letters():
    assert [l.has_letter(t) for t in ("x", "12 é", "²½Ⅷ", "ⅷ4_", "", "字", "ª", "①a")] == [True, True, False, False, False, True, True, True]


def plain_vector(text, idf):
    """TF-IDF weights by dimension, step by step."""
    code = lambda b: b - 96 if 97 <= b <= 122 else 27 + b % 37 if b >= 128 else 0
    codes = [0]
    for b in text.lower().encode():
        if code(b) or codes[-1]:
            codes.append(code(b))
    if codes[-1]:
        codes.append(0)
    counts = {}
    for x, y in zip(codes, codes[1:]):
        counts[x * 64 + y] = counts.get(x * 64 + y, 0) + 1
    for x, y, z in zip(codes, codes[1:], codes[2:]):
        k = ((x * 64 + y) * 2_531 + z * 40_503) % (1 << 15) + 64 * 64
        counts[k] = counts.get(k, 0) + 1
    w = {k: (1 + math.log(n)) * idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {k: x / norm for k, x in w.items()}


def test_model_against_brute_force(spark, sample):
    """Inverse document frequencies, nearest centroids and cosines of every document."""
    train = sample.where(~l.held_out(F.col("doc_id")))
    model = l.fit(train)
    chosen = [r["text"] for r in l.sample(train.where("text rlike '\\\\p{L}'"), "doc_id", "text", "lang", l.SAMPLE_PER_LANGUAGE).collect()]
    seen = {}
    for text in chosen:
        for k in plain_vector(text, [1.0] * l.DIMENSIONS):
            seen[k] = seen.get(k, 0) + 1
    idf = [math.log((1 + len(chosen)) / (1 + seen.get(k, 0))) + 1 for k in range(l.DIMENSIONS)]
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(idf, model.idf))
    for r in l.identify(sample, model).collect():
        text = r["row"]["text"]
        if not text or not l.has_letter(text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = plain_vector(text, idf)
        near = [sum(x * float(model.centroids[k, c]) for k, x in v.items()) for c in range(model.centroids.shape[1])]
        best = max(range(len(near)), key=near.__getitem__)
        assert math.isclose(r["score"], min(1.0, max(0.0, near[best])), abs_tol=1e-4)
        assert r["lang_pred"] == model.languages[model.owner[best]] or sorted(near)[-1] - sorted(near)[-2] < 1e-4


def test_edges(edge, edge_rows, none):
    model = l.fit(edge)
    found = l.identify(edge, model).collect()
    assert len(found) == len(edge_rows)
    for r in found:
        blank = not any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == blank and (not blank or r["rejected"]) and 0 <= r["score"] <= 1
    assert l.identify(none, model).count() == 0
    nothing = l.fit(none)
    assert {r["lang_pred"] for r in l.identify(edge, nothing).collect()} == {"und"}


def test_sample_is_bounded(sample):
    assert l.sample(sample, "doc_id", "text", "lang", 5).groupBy("lang").count().agg(F.max("count")).first()[0] == 5


def test_outliers_get_no_centroid():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(200, 30))) * (np.arange(30) < 15)
    x[7] = np.arange(30) >= 15
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assert (l.spherical_kmeans(x, 4) @ x[7]).max() < 0.5
