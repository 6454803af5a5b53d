"""How often documents of unequal preference are taken: over many sources alike, as their inclusion probabilities say."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import mixing


def pareto(draws, p, need, sizes):
    """A plain sampler: the first ranks that come closest to the need."""
    order = np.argsort((draws / (1 - draws)) / (p / (1 - p)))
    upto = np.concatenate(([0], np.cumsum(sizes[order])))
    taken = np.zeros(len(p), bool)
    taken[order[: int(np.abs(upto - need).argmin())]] = True
    return taken


def test_inclusion_follows_the_preference(spark):
    sources, docs = 400, 20
    rows = [(s * docs + i, " ".join(["w"] * 10), f"s{s:03d}", 0.4 + 0.06 * i) for s in range(sources) for i in range(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, liking double")
    got = mixing.mix(table, weights=(1,), share=0.4, preference=F.col("liking")).toPandas()
    assert (got.groupby("source").taken.sum() == 80).all()
    got["place"] = got.doc_id % docs
    often = got.groupby("place").copies.mean().to_numpy()
    liking = 0.4 + 0.06 * np.arange(docs)
    p = 0.4 * liking / liking.mean()
    assert np.abs(often - p).max() < 4.5 * np.sqrt(0.25 / sources)
    assert np.corrcoef(often, p)[0, 1] > 0.95 and np.ptp(often) > 0.3  # equal probabilities would give no trend


def test_sample_equals_a_plain_sampler(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(["w"] * int(n)) + f" x{i}" for i, n in enumerate(rng.integers(5, 400, 300))]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sized = mixing.sized(table).toPandas().sort_values("doc_id")
    got = mixing.mix(table, share=0.6).toPandas().sort_values("doc_id")
    p = np.clip(0.6 * sized.preference * sized["size"].sum() / (sized["size"] * sized.preference).sum(), 1e-9, 1 - 1e-9).to_numpy()
    want = pareto(sized.draw.to_numpy(), p, 0.6 * sized["size"].sum(), sized["size"].to_numpy())
    assert (got.copies.to_numpy() == want).all() and 0 < want.sum() < 300
