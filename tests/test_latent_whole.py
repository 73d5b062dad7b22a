"""Latent vectors are fitted on all documents, however many there are."""

import numpy as np
from pyspark.sql import functions as F

from lexspark.operators import latent


def test_no_document_is_left_out_of_a_fit(spark):
    many = spark.range(60_000).select(F.concat(F.lit("all "), F.col("id").cast("string")).alias("text"))
    model = latent.fit(many, dim=2, features=64, rounds=0)
    holders = np.bincount([latent.place(str(i), 64) for i in range(60_000)], minlength=64)
    holders[latent.place("all", 64)] = 60_000
    assert model.n_documents == 60_000
    assert np.allclose(model.weights, np.log(60_001 / (1 + holders)) + 1)


def test_counts_of_any_width_and_blocks_of_any_size(spark, monkeypatch):
    texts = ["a " * 70_000 + "b", "c " * 300, "a b c", None, ""]
    sums = {}
    for cells in (latent.CELLS, 1):
        monkeypatch.setattr(latent, "CELLS", cells)
        found = latent.weighted(latent.counts(texts, 256), len(texts), np.ones(256))
        sums[cells] = np.zeros((256, 256))
        latent.gram(found, len(texts), np.eye(256, dtype=np.float32), sums[cells])
    rows = np.zeros((len(texts), 256))
    rows[found[0], found[1]] = found[2]
    assert all(np.allclose(s, rows.T @ rows, atol=1e-6) for s in sums.values())
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    (slice_,) = latent._counted(df, 256).toArrow().to_batches()
    ((again, n),) = latent._unpacked(slice_, 256)
    assert n == len(texts) and all(np.array_equal(x, y) for x, y in zip(again, latent.counts(texts, 256), strict=True))
