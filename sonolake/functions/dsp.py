"""Acoustic features of waveforms in NumPy; no Spark in here."""

from __future__ import annotations

import numpy as np

TINY = 1e-20


def normalise(x: np.ndarray) -> np.ndarray:
    """Divided by the largest magnitude, where that is above 1e-6."""
    top = np.abs(x).max(initial=0.0)
    return x / top if top > 1e-6 else x


def spectral(x: np.ndarray, rate: int) -> dict[str, float]:
    """Centroid, bandwidth, roll-off (85 %), flatness of magnitudes, energy, entropy, zero crossings and loudness."""
    n = len(x)
    mag = np.abs(np.fft.rfft(x)) if n else np.zeros(0)
    out = dict.fromkeys(("spectral_centroid_hz", "spectral_bandwidth_hz", "spectral_rolloff_hz", "spectral_flatness", "spectral_entropy", "zero_crossing_rate"), 0.0)
    if n >= 2:
        m, f = mag + TINY, np.fft.rfftfreq(n, 1 / rate)
        p = m * m
        s = p.sum() + TINY
        c = (f * p).sum() / s
        at = min(int(np.searchsorted(np.cumsum(p), 0.85 * s)), len(f) - 1)
        out |= {"spectral_centroid_hz": c, "spectral_bandwidth_hz": np.sqrt(((f - c) ** 2 * p).sum() / s), "spectral_rolloff_hz": f[at], "spectral_flatness": np.exp(np.log(m).mean()) / (m.mean() + TINY)}
        q = mag * mag
        q = q / (q.sum() + TINY)
        q = q[q > TINY]
        sign = np.where(x >= 0, 1, -1)
        out |= {"spectral_entropy": -(q * np.log(q)).sum(), "zero_crossing_rate": np.count_nonzero(sign[1:] != sign[:-1]) / (n - 1)}
    rms = np.sqrt((x * x).mean()) if n else 0.0
    return {k: float(v) for k, v in (out | {"signal_energy": (x * x).sum(), "loudness": 20 * np.log10(rms + TINY)}).items()}


def harmonic_ratio(x: np.ndarray, rate: int, f0: float) -> float:
    """Share of power near the first eight harmonics (overlaps count twice)."""
    n = len(x)
    if f0 <= 0 or n < 2:
        return 0.0
    p, f = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(n, 1 / rate)
    half = max(2 * rate / n, 5.0)
    near = sum(p[np.abs(f - k * f0) <= half].sum() for k in range(1, 9) if k * f0 < rate / 2)
    return float(near / (p.sum() + TINY))


def mel_filters(n_fft: int, rate: int, count: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, count + 2) / 2595) - 1)
    bins = np.clip(np.floor((n_fft + 1) * hz / rate).astype(int), 0, n_fft // 2)
    bank = np.zeros((count, n_fft // 2 + 1))
    for i, (a, b, c) in enumerate(zip(bins, bins[1:], bins[2:])):
        bank[i, a:b] = (np.arange(a, b) - a) / max(b - a, 1)
        bank[i, b:c] = (c - np.arange(b, c)) / max(c - b, 1)
    return bank


def mfcc_mean(x: np.ndarray, rate: int, count: int = 13, n_fft: int = 2048, hop: int = 512, mels: int = 40) -> list[float]:
    """Mean over frames of the orthonormal DCT-II of log mel power; zeros for less than one frame."""
    if len(x) < n_fft:
        return [0.0] * count
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * np.hanning(n_fft)
    power = np.log(np.maximum((np.abs(np.fft.rfft(frames)) ** 2) @ mel_filters(n_fft, rate, mels).T, 1e-10))
    basis = np.cos(np.pi * np.outer(np.arange(count), np.arange(mels) + 0.5) / mels) * np.sqrt(2 / mels)
    basis[0] /= np.sqrt(2)
    return np.round((power @ basis.T).mean(axis=0), 6).tolist()


def local_peaks(y: np.ndarray, height: float, distance: int, prominence: float) -> np.ndarray:
    """Maxima (plateaus by their middle) of a height, then the highest within a distance, then of a prominence."""
    step = y[1:] - y[:-1]
    edge = step.nonzero()[0] + 1  # where a plateau begins
    a = ((step > 0) & (y[1:] >= height)).nonzero()[0] + 1
    after = edge.searchsorted(a, "right")
    if len(a) and after[-1] == len(edge):  # the last one has no end
        a, after = a[:-1], after[:-1]
    b = edge[after]
    top = y[a] > y[b]
    at = (a[top] + b[top] - 1) // 2
    if len(at) > 1:
        keep, low, high = np.ones(len(at), bool), at.searchsorted(at - distance, "right"), at.searchsorted(at + distance)
        for i in y[at].argsort(kind="stable")[::-1]:
            if keep[i]:
                keep[low[i] : high[i]] = False  # what is closer than the distance
                keep[i] = True
        at = at[keep]

    def drops(top: float, away: np.ndarray) -> bool:
        """Whether values on the way from a peak fall by the prominence before one is higher."""
        low = top - away >= prominence
        return bool(low[(low | (away > top)).argmax()])

    return np.array([i for i in at if drops(y[i], y[i::-1]) and drops(y[i], y[i:])], int)


def strongest_peaks(x: np.ndarray, count: int, height: float, distance: int, prominence: float = 0.04) -> tuple[np.ndarray, np.ndarray]:
    """(spectrum places, scaled magnitudes) of the strongest peaks, strongest first; the largest value if there is no peak."""
    m = np.abs(np.fft.rfft(x))
    m = m / (m.max() + 1e-12)
    at = local_peaks(m, height, distance, prominence)
    if not len(at):
        at = np.array([np.argmax(m)])
    at = at[np.argsort(m[at], kind="stable")[::-1][:count]]
    return at, m[at]


def dominant(x: np.ndarray, rate: int, magnitudes: np.ndarray | None = None) -> float:
    """Frequency of the strongest peak of the scaled spectrum (whose magnitudes may be given); 0 for less than 64 samples."""
    if len(x) < 64:
        return 0.0
    m = np.abs(np.fft.rfft(x)) if magnitudes is None else magnitudes
    m = m / (m.max() + 1e-12)
    at = local_peaks(m, 0.06, 6, 0.04)
    return float((at[np.argmax(m[at])] if len(at) else np.argmax(m)) * rate / len(x))


def frame_profile(x: np.ndarray, scale: float, rate: int) -> tuple[float, list[float], list[float], float]:
    """(loudness, spatial frequencies of at most six peaks, their magnitudes, dominant frequency) of one frame."""
    if len(x) < 64:
        return 0.0, [2.5 + scale * 0.5], [1.0], 0.0
    at, m = strongest_peaks(x, 6, 0.08, 5)
    spatial = 2.5 + np.sqrt(at / (len(x) // 2 + 1)) * scale
    return float(np.sqrt((x * x).mean())), spatial.tolist(), m.tolist(), float(at[0] * rate / len(x))


def windows(n: int, rate: int) -> list[tuple[int, int]]:
    """(offset, length) of quarter-second windows at half steps; one window if there is no room for more."""
    w = int(0.25 * rate)
    return [(o, w) for o in range(0, n - w, max(w // 2, 1))] if n > w > 0 else [(0, n)]


def vote(candidates: list[tuple[int, float]], harmonics: int = 4) -> int:
    """The bin that collects most energy from bins that are its small multiples; ties go to the first seen."""
    energy: dict[int, float] = {}
    for f, e in candidates:
        for d in range(1, harmonics + 1):
            if f > 0 and f % d == 0:
                energy[f // d] = energy.get(f // d, 0.0) + e
    return max(energy, key=energy.__getitem__) if energy else 0


def peak_frequency(x: np.ndarray, rate: int) -> dict[str, float | str]:
    """The voted frequency, and time, amplitude, loudness and the eight strongest peaks (whole Hz, joined by |) of its best window."""
    if len(x) < 64:
        return {"peak_frequency_hz": 0.0, "peak_time_s": 0.0, "peak_amplitude": 0.0, "peak_rms": 0.0, "peaks_hz": ""}
    found = []
    for o, w in windows(len(x), rate):
        part = x[o : o + w]
        m = np.abs(np.fft.rfft(part))
        found.append((round(dominant(part, rate, m)), float((m**2).sum()), o, w))
    f0 = vote([(f, e) for f, e, _, _ in found])
    own = [c for c in found if f0 and c[0] > 0 and c[0] % f0 == 0] or found[:1]
    _, _, o, w = max(own, key=lambda c: c[1])
    part = x[o : o + w]
    peaks = "|".join(f"{k * rate / max(int(rate * 0.25), 1):.0f}" for k in strongest_peaks(part, 8, 0.06, 6)[0])
    return {"peak_frequency_hz": float(f0), "peak_time_s": o / rate, "peak_amplitude": float(np.abs(part).max()), "peak_rms": float(np.sqrt((part * part).mean())), "peaks_hz": peaks}
