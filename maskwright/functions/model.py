"""Scores of names by a token classifier in ONNX files, for :mod:`maskwright.functions.verifier`."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from maskwright.functions.verifier import WordPiece, person_probability, span_score


@lru_cache(maxsize=4)
def _loaded(path: str, sha256: str | None, vocabulary: tuple[str, ...]):
    """One session a process and file; a file that isn't the pinned one is refused."""
    import onnxruntime

    with open(path, "rb") as f:
        data = f.read()
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the model isn't the pinned one")
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # Spark runs a task a core
    return onnxruntime.InferenceSession(data, options, providers=["CPUExecutionProvider"]), WordPiece(list(vocabulary))


class TokenClassifier:
    """A scorer of (window, name): the best person probability of the tokens of the name's first place.

    ``path`` is a file that all executors reach; only it and the vocabulary
    travel with a task.  Inputs that the model names beside ``input_ids`` are the
    attention mask (ones) and token types (zeros).  A model that can't be loaded
    raises, and a verifier that raises rejects nothing.
    """

    def __init__(self, path: str, vocabulary: list[str], sha256: str | None = None):
        self.path, self.vocabulary, self.sha256 = path, tuple(vocabulary), sha256

    def __call__(self, window: str, name: str) -> float:
        session, cut = _loaded(self.path, self.sha256, self.vocabulary)
        start = window.find(name)
        if start < 0:
            return 0.0
        tokens = cut(window)
        ids = np.array([[cut.ids.get(p, cut.ids.get(cut.unknown, 0)) for p, _, _ in tokens]], np.int64)
        given = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
        (logits,) = session.run(None, {x.name: given[x.name] for x in session.get_inputs()})[:1]
        return span_score(tokens, person_probability(logits[0]), start, start + len(name))
