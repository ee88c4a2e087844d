"""Signal features of one recording in numpy; recordings are independent, so each is a group or a row."""

from __future__ import annotations

import numpy as np


def mel_filters(rate: int, n_fft: int, bands: int, htk: bool = False) -> np.ndarray:
    """Triangular filters [band, bin], area-normalised on the Slaney scale, of height 1 on the HTK scale."""
    step = np.log(6.4) / 27

    def to_mel(f):
        return 1127 * np.log1p(f / 700) if htk else np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1000) / 1000) / step)

    def to_hz(m):
        return 700 * np.expm1(m / 1127) if htk else np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * step))

    edges = to_hz(np.linspace(to_mel(np.array(0.0)), to_mel(np.array(rate / 2)), bands + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    tri = np.maximum(0, np.minimum(up, down))
    return tri if htk else tri * (2 / (edges[2:] - edges[:-2]))[:, None]


def power_frames(x: np.ndarray, n_fft: int, window: np.ndarray, hop: int) -> np.ndarray:
    """Power spectra [frame, bin] of windowed frames that fit in x."""
    if len(x) < n_fft:
        return np.empty((0, n_fft // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.abs(np.fft.rfft(frames * window, axis=1)) ** 2


def log_mel(x: np.ndarray, rate: int = 16000, n_fft: int = 512, width: int = 400, hop: int = 160, bands: int = 128) -> np.ndarray:
    """Pre-emphasised, zero-padded by half a frame, Hann window in the middle of the frame, ln(power + 2^-24)."""
    x = np.append(x[:1], x[1:] - 0.97 * x[:-1])
    x = np.pad(x, n_fft // 2)
    window = np.pad(np.hanning(width + 1)[:-1], ((n_fft - width) // 2, n_fft - width - (n_fft - width) // 2))
    return np.log(power_frames(x, n_fft, window, hop) @ mel_filters(rate, n_fft, bands).T + 2.0**-24)


def log_mel_clamped(x: np.ndarray, rate: int = 16000, n_fft: int = 400, hop: int = 160, bands: int = 80) -> np.ndarray:
    """Reflected ends, log10 with a floor of 1e-10, at most 8 below the largest value, scaled by (v + 4) / 4; the last frame goes."""
    x = np.pad(x, n_fft // 2, mode="reflect") if len(x) > n_fft // 2 else np.pad(x, n_fft // 2)
    v = np.log10(np.maximum(power_frames(x, n_fft, np.hanning(n_fft + 1)[:-1], hop)[:-1] @ mel_filters(rate, n_fft, bands).T, 1e-10))
    return (np.maximum(v, v.max() - 8) + 4) / 4 if v.size else v


def filter_bank(x: np.ndarray, rate: int = 16000, width: int = 400, hop: int = 160, bands: int = 80) -> np.ndarray:
    """Frames without their mean, pre-emphasised, under a Hamming window; ln of HTK-scale filters, mean over time removed."""
    n_fft = 512
    if len(x) < width:
        return np.empty((0, bands))
    f = np.lib.stride_tricks.sliding_window_view(x, width)[::hop].astype(float)
    f = f - f.mean(1, keepdims=True)
    f = np.concatenate([f[:, :1] * 0.03, f[:, 1:] - 0.97 * f[:, :-1]], axis=1) * np.hamming(width)
    p = np.abs(np.fft.rfft(f, n_fft, axis=1)) ** 2
    v = np.log(np.maximum(p @ mel_filters(rate, n_fft, bands, True).T, np.finfo(np.float32).eps))
    return v - v.mean(0)


def biquad(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float]) -> np.ndarray:
    """Second-order recursive filter, sample by sample."""
    y, x1, x2, y1, y2 = np.empty(len(x)), 0.0, 0.0, 0.0, 0.0
    for i, v in enumerate(x):
        o = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
        x2, x1, y2, y1 = x1, v, y1, o
        y[i] = o
    return y


def coefficients(kind: str, f: float, rate: int, q: float) -> tuple[tuple[float, float, float], tuple[float, float]]:
    """The usual high-pass and notch designs."""
    w = 2 * np.pi * f / rate
    alpha, c = np.sin(w) / (2 * q), np.cos(w)
    b = ((1 + c) / 2, -(1 + c), (1 + c) / 2) if kind == "highpass" else (1.0, -2 * c, 1.0)
    return tuple(v / (1 + alpha) for v in b), (-2 * c / (1 + alpha), (1 - alpha) / (1 + alpha))


def clean_up(x: np.ndarray, rate: int = 16000) -> np.ndarray:
    """A 75 Hz high-pass, then notches at 50 and 60 Hz."""
    for kind, f, q in (("highpass", 75.0, 0.7071), ("notch", 50.0, 30.0), ("notch", 60.0, 30.0)):
        x = biquad(x, *coefficients(kind, f, rate, q))
    return x


def resample(x: np.ndarray, rate: int, to: int = 16000, half: int = 16) -> np.ndarray:
    """Windowed-sinc interpolation at the new sample times; not the same bits as any library's."""
    if rate == to or not len(x):
        return x
    n, cut = int(len(x) * to / rate), min(1.0, to / rate)
    at = np.arange(n) * rate / to
    base = np.floor(at).astype(int)
    reach = int(half / cut)
    k = np.arange(-reach + 1, reach + 1)
    d = at[:, None] - (base[:, None] + k)
    w = np.sinc(d * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / reach, -1, 1)))
    return (np.pad(x, reach)[base[:, None] + k + reach] * w).sum(1)
