"""Windows are filled with all neighbours of their seed, and every shared id counts."""

import numpy as np

from readloom.llm import packing


def test_seed_stays_seed():
    """The seed's weaker neighbours come before texts that share nothing with it, however many stronger ones there are."""
    texts = [[1, 1, 2]] + [[1, 3]] * 150 + [[7]] * 50 + [[2]] * 50
    ids = [np.array(x, np.uint32) for x in texts]
    df = np.zeros(8)
    for x in texts:
        df[list(set(x))] += 1
    rows = list(packing.fill(np.concatenate(ids), np.array([len(x) for x in ids]), packing.weights(df, len(ids)), 2.0, 3 + 300 + 50))
    assert {d for d, _, _, seq, _ in rows if seq == 0} == {0, *range(1, 151), *range(201, 251)}


def test_ids_of_all_documents_weigh_something():
    assert (packing.weights(np.array([1.0, 1.0, 2.0]), 2) > 0).all()
    ids = [np.array(x, np.uint32) for x in ([1, 2], [1, 3])]
    index = packing.Index(np.concatenate(ids), np.array([2, 2]), packing.weights(np.array([0.0, 2.0, 1.0, 1.0]), 2), 2.0)
    assert index.scores(0)[1] > 0


def test_scores_are_bm25():
    """Matrix of common terms and postings of rare ones against the formula; the next best unused neighbour follows."""
    rng = np.random.default_rng(2)
    ids = [np.concatenate([rng.zipf(1.4, rng.integers(1, 60)).clip(2, 400), [1]]).astype(np.uint32) for _ in range(600)]
    sizes = np.array([len(x) for x in ids])
    df = np.bincount(np.concatenate([np.unique(x) for x in ids])).astype(float)
    idf, mean = packing.weights(df, len(ids)), sizes.mean()
    index = packing.Index(np.concatenate(ids), sizes, idf, mean)
    assert index.matrix.shape[1] and len(index.docs)
    for q in (0, 299, 599):
        want = []
        for x in ids:
            tf = np.bincount(x, minlength=len(idf))
            w = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
            want.append(w[np.unique(ids[q])].sum())
        assert np.allclose(index.scores(q), want, rtol=1e-5)


def test_types_and_columns():
    for kind in ("<u2", "<u4"):
        column = packing.binaries(np.arange(7).astype(kind), np.array([2, 0, 5]))
        values, sizes = packing.flat(column.slice(1), kind)
        assert values.tolist() == [2, 3, 4, 5, 6] and sizes.tolist() == [0, 5]
