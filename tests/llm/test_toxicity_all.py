"""Training on every place, with the parameters of production."""

import numpy as np
import pandas as pd
import pytest

from millrace.llm import learn, toxicity


def _score(model, terms):
    at = {int(p): i for i, p in enumerate(model["place"])}
    x = np.zeros((1, len(at)), np.float32)
    x[0, [at[t] for t in terms if t in at]] = 1
    return learn.sigmoid(toxicity.logits(model, x))[0]


@pytest.mark.parametrize("others", [0, 30])
def test_pairs_of_neutral_terms(others):
    """Two terms that are harmless alone and toxic together, also among other terms; neither has a z-score of its own."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append([t for t, on in ((11, a), (22, b)) if on] + [33, *(100 + rng.choice(5000, others, replace=False))])
        labels.append(int(a == b))
    model = toxicity.fit(pd.DataFrame({"rank": range(1200), "label": labels, "x": rows}))
    assert _score(model, (11, 22, 33)) > 0.8 and _score(model, (11, 33)) < 0.2 and _score(model, (22, 33)) < 0.2


def test_terms_of_few_documents():
    """A term of three toxic documents raises the score."""
    rng = np.random.default_rng(1)
    rows = [list(100 + rng.choice(500, 20, replace=False)) + ([11] if i < 3 else []) for i in range(1000)]
    model = toxicity.fit(pd.DataFrame({"rank": range(1000), "label": [int(i < 3 or i % 10 == 0) for i in range(1000)], "x": rows}))
    assert 11 in model["place"] and _score(model, (11, 100)) > _score(model, (100,)) + 0.01
