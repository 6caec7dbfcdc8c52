"""The reader that is made ready against the tagger itself, and windows decoded together against one by one."""

import numpy as np

from segmenta.llm import pii


def test_reader_is_the_tagger():
    model = pii.trained()
    texts = [t for t, _ in pii.examples(60, 3)]
    x = np.zeros((len(texts), pii.WINDOW), np.uint8)
    for row, text in zip(x, texts, strict=True):
        row[: len(text)] = pii.codes(text)[: pii.WINDOW]
    assert (pii.Reader(model).tags(x) == model.decode(x)).mean() > 0.9999


def test_windows_are_decoded_together_and_gates_may_saturate(monkeypatch):
    reader, calls, plain = pii.Reader(pii.trained()), [], pii.viterbi
    x = np.stack([pii.codes(t)[: pii.TRAIN_WINDOW] for t, _ in pii.examples(40, 4)])
    alone = np.concatenate([reader.tags(row[None]) for row in x])
    monkeypatch.setattr(pii, "viterbi", lambda scores, moves: calls.append(scores.shape[2]) or plain(scores, moves))
    assert (reader.tags(x, 4) == alone).all() and alone.any()
    assert len(calls) == 1 and not reader.tags(x[:0]).size
    extreme = pii.Tagger(size=12, width=8)
    extreme.p = {k: v * 400 for k, v in extreme.p.items()}
    with np.errstate(all="raise", over="warn", under="ignore"):
        assert pii.Reader(extreme).tags(np.tile(np.arange(pii.WINDOW, dtype=np.uint8) % pii.SYMBOLS, (3, 1))).shape == (3, pii.WINDOW)
