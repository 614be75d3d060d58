"""Signal processing on batches (numpy): log-mel, RMS levels, YIN, resampling, crossfade. Plain functions; UDFs wrap them."""

from __future__ import annotations

import math

import numpy as np

from ..schemas import FeatureConfig, WindowConfig


def frames_of(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames [n, size] that lie inside x."""
    if len(x) < size:
        return np.empty((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def mel_filters(cfg: FeatureConfig = FeatureConfig()) -> np.ndarray:
    """Triangles on the HTK mel scale, [n_fft / 2 + 1, n_mels]."""
    to_mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    points = 700.0 * (10.0 ** (np.linspace(to_mel(cfg.f_min), to_mel(cfg.f_max), cfg.n_mels + 2) / 2595.0) - 1.0)
    f = np.linspace(0, cfg.sample_rate / 2, cfg.n_fft // 2 + 1)
    up = (f[:, None] - points[None, :-2]) / np.diff(points)[None, :-1]
    down = (points[None, 2:] - f[:, None]) / np.diff(points)[None, 1:]
    return np.maximum(0.0, np.minimum(up, down))


def log_mel(x: np.ndarray, cfg: FeatureConfig = FeatureConfig()) -> np.ndarray:
    """[T, n_mels]: power spectrogram of centred, reflected Hann frames, mel, log(m + floor)."""
    x = np.asarray(x, np.float64)
    if not len(x):
        return np.empty((0, cfg.n_mels))
    half = cfg.n_fft // 2
    x = np.pad(x, half, mode="reflect" if len(x) > half else "constant")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(cfg.n_fft) / cfg.n_fft)
    power = np.abs(np.fft.rfft(frames_of(x, cfg.n_fft, cfg.hop) * window, axis=1)) ** 2
    return np.log(power @ mel_filters(cfg) + cfg.log_floor)


def rms_db(x: np.ndarray) -> float:
    return float(20 * np.log10(np.sqrt(np.mean(np.square(np.asarray(x, np.float64)))) + 1e-8)) if len(x) else float(20 * np.log10(1e-8))


def frame_db(x: np.ndarray, size: int = 1024, hop: int = 320) -> np.ndarray:
    return 20 * np.log10(np.sqrt(np.mean(np.square(frames_of(np.asarray(x, np.float64), size, hop)), axis=1)) + 1e-8)


def yin(x: np.ndarray, rate: int = 16_000, f_min: float = 70.0, f_max: float = 1000.0, size: int = 1024, hop: int = 320, trough: float = 0.1) -> np.ndarray:
    """Fundamental of each frame (de Cheveigne and Kawahara 2002): cumulative mean normalised difference, first trough below the
    threshold or else the lowest, parabolic refinement."""
    fr = frames_of(np.asarray(x, np.float64), size, hop)
    lo, hi = int(rate // f_max), min(int(np.ceil(rate / f_min)), size // 2)
    n, w = len(fr), size - hi
    if not n:
        return np.empty(0)
    spectrum = np.fft.rfft(fr, 2 * size)
    head = np.fft.rfft(fr[:, :w], 2 * size)
    cross = np.fft.irfft(spectrum * np.conj(head), 2 * size)[:, : hi + 1]
    energy = np.cumsum(np.pad(fr**2, ((0, 0), (1, 0))), axis=1)
    moved = energy[:, w : w + hi + 1] - energy[:, : hi + 1]
    d = np.maximum(energy[:, w : w + 1] + moved - 2 * cross, 0.0)
    lags = np.arange(1, hi + 1)
    cmnd = np.ones((n, hi + 1))
    cmnd[:, 1:] = d[:, 1:] * lags / np.maximum(np.cumsum(d[:, 1:], axis=1), 1e-12)
    part = cmnd[:, lo : hi + 1]
    low = np.pad(part, ((0, 0), (1, 1)), constant_values=np.inf)
    minimum = (part <= low[:, :-2]) & (part < low[:, 2:]) & (part < trough)
    at = np.where(minimum.any(1), minimum.argmax(1), part.argmin(1)) + lo
    k = np.clip(at, 1, hi - 1)
    a, b, c = (cmnd[np.arange(n), k + s] for s in (-1, 0, 1))
    bend = a - 2 * b + c
    shift = np.where(np.abs(bend) > 1e-12, np.clip((a - c) / np.where(bend == 0, 1, 2 * bend), -1, 1), 0.0)
    return rate / (k + shift)


def semitones(f0: np.ndarray) -> np.ndarray:
    return 12 * np.log2(np.maximum(f0, 1.0) / 55.0)


def resample(x: np.ndarray, rate: int, to: int, zeros: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Band-limited resampling (J. O. Smith's windowed sinc): each output sample is a weighted sum of the input around it, by a sinc that ends
    at its `zeros`-th zero under a squared cosine, cut off at rolloff times the lower of both half rates. Beyond its ends x is 0."""
    x = np.asarray(x, np.float32)
    if rate == to or not len(x):
        return x
    step = math.gcd(rate, to)
    old, new = rate // step, to // step
    cut = min(old, new) * rolloff / old  # cycles of the sinc for each input sample
    reach = math.ceil(zeros / cut)
    n = -(-len(x) * new // old)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(x.astype(np.float64), (reach, reach + old + 1)), 2 * reach + 2)
    out = np.empty(n)
    for phase in range(min(new, n)):
        at, part = divmod(phase * old, new)
        u = (np.arange(-reach, reach + 2) - part / new) * cut
        taps = np.where(np.abs(u) <= zeros, np.sinc(u) * np.cos(np.pi * u / (2 * zeros)) ** 2 * cut, 0.0)
        rows = len(range(phase, n, new))
        out[phase::new] = near[at : at + (rows - 1) * old + 1 : old] @ taps
    return out.astype(np.float32)


def augment(mel: np.ndarray, rng: np.random.Generator, cfg: WindowConfig = WindowConfig()) -> np.ndarray:
    """Of a window [T, n_mels] in the log domain: random gain; with bandlimit_prob all bands from a drawn one on become the smallest value; masks of
    bands and times, each filled with the mean as it then is. Widths are drawn from 1 on."""
    m = np.array(mel, np.float64)
    times, bands = m.shape
    m += rng.uniform(-cfg.gain_db, cfg.gain_db) * np.log(10) / 20
    if cfg.bandlimit_prob > 0 and rng.random() < cfg.bandlimit_prob and cfg.min_band < bands:
        m[:, rng.integers(cfg.min_band, bands) :] = m.min()
    for _ in range(cfg.n_masks):
        for along, size, most in ((m.T, bands, cfg.freq_mask), (m, times, cfg.time_mask)):
            start = rng.integers(0, max(1, size - most))
            along[start : start + rng.integers(1, most + 1)] = m.mean()
    return m


def to_pcm16(x: np.ndarray) -> np.ndarray:
    """Samples clamped to [-1, 1] as 16-bit integers, halves to even."""
    return np.rint(np.clip(np.asarray(x, np.float64), -1, 1) * 32767).astype("<i2")
