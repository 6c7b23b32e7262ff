"""Numbers of tokens from remembered n-grams, against those of all their features."""

import numpy as np

from seqspark.llm import quality


def test_remembered_grams_change_no_number(monkeypatch):
    params = quality.QualityParams()
    numbers = np.random.default_rng(5).normal(size=1 << params.bits).astype(np.float32)
    tokens = ["", "a", "the", "thander", "é東京", "x" * 300, "thanders"]
    want = [(sum(map(numbers.tolist().__getitem__, rows)), len(rows)) for rows in (quality.token_features(t, params.grams, (1 << params.bits) - 1) for t in tokens)]
    for most in (1, 1000):
        monkeypatch.setattr(quality, "REMEMBERED_GRAMS", most, raising=False)
        known = quality.TokenNumbers(numbers, params)
        assert [known[t] for t in tokens] == want
        assert 0 < len(known.grams) <= most
