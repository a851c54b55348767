"""Copies in the training draw."""

import numpy as np

from verishelf.llm import lang_id


def test_copies_are_drawn_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lang_id.Network, "train", lambda self, windows, target, **k: seen.update(windows=windows, target=target))
    rows = [(f"text number {i} of its own, which goes on {i * 7}", "a") for i in range(60)] + [("one text that came often", "a")] * 2000 + [(f"b-text {i} and more {i * 3}", "b") for i in range(60)]
    lang_id.train_lang_id(spark.createDataFrame(rows, "text string, lang string"), lang_id.F.lit(True), max_windows=60, steps=1)
    assert len(np.unique(seen["windows"], axis=0)) == len(seen["windows"]) == 60
    assert 15 <= (seen["target"] == 0).sum() <= 45
