"""Scores of rendered patterns."""

from __future__ import annotations

import numpy as np


def symmetry_score(gray: np.ndarray) -> float:
    """Half of one plus the correlation of an image and its mirror image, within 0 .. 1; half for an even gray."""
    a, b = gray.astype(float).ravel(), gray[:, ::-1].astype(float).ravel()
    a, b = a - a.mean(), b - b.mean()
    return float(np.clip(0.5 * ((a * b).sum() / (np.sqrt((a * a).sum() * (b * b).sum()) + 1e-12) + 1), 0, 1))


def pattern_stability(frames: list[np.ndarray], step: int = 3) -> float:
    """Mean cosine of neighbours among every step-th frame; one for fewer than two."""
    own = [f.astype(float).ravel() for f in frames[::step]]
    if len(own) < 2:
        return 1.0
    return float(np.mean([(a * b).sum() / (np.sqrt((a * a).sum() * (b * b).sum()) + 1e-12) for a, b in zip(own, own[1:])]))
