"""Fuzzy search for terms among a text's words: bounds in numpy, the exact ratio for the few that pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from ..functions.text import ratio_of

_BINS = 32


def _histogram(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") % _BINS, minlength=_BINS)


@dataclass
class FuzzyTerm:
    rule: int
    order: int
    text: str
    size: int  # in words
    threshold: float
    minus_score: float

    def __post_init__(self) -> None:
        self.counts = _histogram(self.text)


class FuzzySearch:
    """Finds, for each term, the most similar run of as many words, the earliest of equals, at or over the term's threshold."""

    def __init__(self, terms: Sequence[FuzzyTerm]):
        self.by_size: dict[int, list[FuzzyTerm]] = {}
        for t in terms:
            if t.size:
                self.by_size.setdefault(t.size, []).append(t)

    def __call__(self, words: Sequence[str]) -> list[tuple[FuzzyTerm, str]]:
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4") % _BINS
        counts = np.bincount(np.repeat(np.arange(n), lengths) * _BINS + chars, minlength=n * _BINS).reshape(n, _BINS)
        sums = np.concatenate([np.zeros((1, _BINS), dtype=np.int64), np.cumsum(counts, axis=0)])
        found = []
        for size, terms in self.by_size.items():
            runs = max(0, n - size + 1)
            length = ends[size:] - ends[:runs] + size - 1 if runs else np.zeros(0, dtype=np.int64)
            bins = sums[size:] - sums[:runs] if runs else np.zeros((0, _BINS), dtype=np.int64)
            if size > 1 and runs:
                bins = bins.copy()
                bins[:, ord(" ") % _BINS] += size - 1
            for term in terms:
                best, best_text = 0.0, ""
                both = length + len(term.text)
                # The ratio is at most twice the shorter length, and twice the shared characters, over both lengths.
                near = np.flatnonzero(2 * np.minimum(length, len(term.text)) >= (term.threshold - 1e-9) * both)
                if len(near):
                    shared = np.minimum(bins[near], term.counts).sum(axis=1)
                    near = near[2 * shared >= (term.threshold - 1e-9) * both[near]]
                for i in near:
                    candidate = " ".join(words[i : i + size])
                    if candidate != term.text:
                        r = ratio_of(term.text, candidate)
                        if r > best:
                            best, best_text = r, candidate
                if best >= term.threshold:
                    found.append((term, best_text))
        return found
