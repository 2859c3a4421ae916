import numpy as np

from paperlane.llm import toxicity


def test_every_other_term_of_the_kind_is_a_swap():
    names = list(next(kind for kind in toxicity.IDENTITY if "catholic" in kind))
    rows = [np.array([names.index("muslim")], np.int32)] * 20 + [np.zeros(0, np.int32)] * 20
    weights = toxicity.fit(rows, np.repeat([1.0, 0.0], 20), names).weights
    others = [weights[n] for n, t in enumerate(names) if t != "muslim"]
    assert min(others) > 0 and max(others) - min(others) < 1e-9


def test_no_feature_is_left_out():
    """Words of a single text, far more than any list of features would hold, all have a weight."""
    of = toxicity.Featurizer(list(toxicity.KIND), toxicity.SLOTS)
    rows = [of(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(k, k + 500))) for k in range(0, 10_000, 500)]
    assert all(len(r) >= 900 for r in rows)
    model = toxicity.fit(rows, np.arange(len(rows)) % 2.0, list(toxicity.KIND), slots=toxicity.SLOTS)
    assert all(np.abs(model.weights[r]).min() > 0 for r in rows)
    assert of("women")[0] == list(toxicity.KIND).index("women") and len(model.weights) == len(toxicity.KIND) + toxicity.SLOTS
