import numpy as np

from paperlane.llm import pii


def test_a_label_travels_over_fifty_recurrences():
    """The links make a chain, on which forward and backward sums are exact."""
    text = " x ".join(["7654321"] * 50)
    t = pii.Tokens(text, [[], [], [], [(0, 7)]])
    field = pii.Field([(repr(t.shape[0]), 0, y, 1 + y) for y in range(5)] + [("pair1", a, b, 2000 if a == b else 1) for a in range(5) for b in range(5)])
    assert len(t.at) == 50 and [(i, j) for i, j, _ in t.links] == [(i, i + 1) for i in range(49)]
    own, pair = np.exp(field.shapes[repr(t.shape[0])]), np.exp(field.pairs[1])
    alpha = [np.eye(5)[4]]
    for _ in range(49):
        a = (alpha[-1] @ pair) * own
        alpha.append(a / a.sum())
    p = field.beliefs([t])
    assert np.abs(p[-1] - alpha[-1]).max() < 1e-5


def test_documents_that_do_not_settle_are_told(spark, monkeypatch):
    field = pii.Field([("x", 0, 0, 5)] + [("pair1", a, b, 2000 if a == b else 1) for a in range(5) for b in range(5)])
    texts = [" x ".join(["7654321"] * 50), "nothing here", "one 5", "", "mail a@b.cd and a@b.cd"]
    settled = []
    pii.spans_of(texts, field, settled)
    assert settled == [True] * 5
    monkeypatch.setattr(pii, "SWEEPS", 0)
    monkeypatch.setattr(pii, "LEAST_SWEEPS", 2)
    settled = []
    pii.spans_of(texts, field, settled)
    assert settled[0] is False and settled[1:4] == [True] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.settled for r in pii.digest(pii.find(docs)).orderBy("doc_id").collect()][1:4] == [True] * 3
