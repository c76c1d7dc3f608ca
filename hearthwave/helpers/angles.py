"""Small numpy helpers for directions of arrival: steering vectors, beam power and subspace spectra of covariances."""

from __future__ import annotations

import functools

import numpy as np

# Element positions in half wavelengths, by antenna. The ideal grid goes row by row (elevation-major).
IDEAL_AZ, IDEAL_EL = tuple(i % 4 for i in range(16)), tuple(i // 4 for i in range(16))
BOARD_AZ = (0, 1, 1, 0, 0, 1, 1, 0, 2, 3, 3, 2, 2, 3, 3, 2)
BOARD_EL = (2, 2, 3, 3, 0, 0, 1, 1, 0, 0, 1, 1, 2, 2, 3, 3)


@functools.lru_cache(maxsize=16)
def steering(az_deg: tuple[float, ...], el_deg: tuple[float, ...], az_at: tuple[int, ...] = IDEAL_AZ, el_at: tuple[int, ...] = IDEAL_EL) -> np.ndarray:
    """Unit responses (azimuths, elevations, antennas), built once per worker."""
    az, el = np.radians(np.array(az_deg))[:, None, None], np.radians(np.array(el_deg))[None, :, None]
    return np.exp(1j * np.pi * (np.array(az_at) * np.sin(az) * np.cos(el) + np.array(el_at) * np.sin(el)))


def scan(low: float, high: float, step: float = 1.0) -> tuple[float, ...]:
    return tuple(np.arange(low, high + step / 2, step).tolist())


def beam(r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """a^H R a of covariances (n, k, k) over all directions: (n, azimuths, elevations)."""
    return np.einsum("mpk,nkl,mpl->nmp", a.conj(), r, a, optimize=True).real


def sources(r: np.ndarray, snapshots: int) -> int:
    """Number of sources by minimum description length."""
    w = np.sort(np.linalg.eigvalsh(r))[::-1].clip(1e-12)
    n = len(w)
    costs = []
    for k in range(n):
        rest = w[k:]
        costs.append(-snapshots * (n - k) * (np.log(rest).mean() - np.log(rest.mean())) + 0.5 * k * (2 * n - k) * np.log(snapshots))
    return int(np.argmin(costs))


def subspace(r: np.ndarray, a: np.ndarray, signals: int | None = None, snapshots: int = 100) -> np.ndarray:
    """MUSIC spectrum of one covariance over all directions."""
    k = sources(r, snapshots) if signals is None else signals
    k = min(max(k, 1), len(r) - 1)
    noise = np.linalg.eigh(r)[1][:, : len(r) - k]
    return 1 / ((np.abs(np.einsum("mpk,kl->mpl", a.conj(), noise)) ** 2).sum(axis=2) + 1e-12)


def peaks(power: np.ndarray, az_deg: tuple[float, ...], el_deg: tuple[float, ...], floor_db: float = -20.0) -> list[tuple[float, float, float]]:
    """(azimuth, elevation, power) of the inner local maxima, strongest first."""
    m = power[1:-1, 1:-1]
    top = np.ones(m.shape, dtype=bool)
    for i in (0, 1, 2):
        for j in (0, 1, 2):
            top &= m >= power[i : i + m.shape[0], j : j + m.shape[1]]
    top &= 10 * np.log10(m / power.max() + 1e-30) >= floor_db
    found = [(az_deg[i + 1], el_deg[j + 1], float(m[i, j])) for i, j in np.argwhere(top)]
    return sorted(found, key=lambda x: -x[2])


def smoothed(x: np.ndarray, grid: tuple[int, int] = (4, 4), sub: tuple[int, int] = (3, 3)) -> np.ndarray:
    """Covariance of snapshots (k, antennas), averaged over the sub-arrays of the grid, forward and backward."""
    k = len(x)
    cube = x.reshape(k, *grid)
    size = sub[0] * sub[1]
    views = [cube[:, p : p + sub[0], q : q + sub[1]].reshape(k, size) for p in range(grid[0] - sub[0] + 1) for q in range(grid[1] - sub[1] + 1)]
    r = sum(v.T @ v.conj() / k for v in views) / len(views)
    return 0.5 * (r + r[::-1, ::-1].conj())
