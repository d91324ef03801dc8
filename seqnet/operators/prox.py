"""Proximal operators of the time-varying graphical lasso, in numpy."""

import numpy as np


def logdet(s: np.ndarray, a: np.ndarray, eta: float) -> np.ndarray:
    """argmin -logdet x + tr(s x) + eta/2 |x - a|^2."""
    d, q = np.linalg.eigh(eta * a - s)
    return (q * ((d + np.sqrt(d * d + 4 * eta)) / (2 * eta))) @ q.T


def soft(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def lasso(x: np.ndarray, t: float) -> np.ndarray:
    """Soft threshold off the diagonal."""
    out = soft(x, t)
    np.fill_diagonal(out, np.diag(x))
    return out


def l1_ball(v: np.ndarray, radius: float) -> np.ndarray:
    if np.abs(v).sum() <= radius:
        return v
    u = np.sort(np.abs(v))[::-1]
    c = (np.cumsum(u) - radius) / np.arange(1, len(u) + 1)
    return soft(v, c[np.nonzero(u > c)[0][-1]])


def difference(d: np.ndarray, t: float, kind: str) -> np.ndarray:
    """argmin t psi(x) + |x - d|^2 / 2 for the penalties of differences."""
    if kind == "l1":
        return soft(d, t)
    if kind == "laplacian":
        return d / (1 + 2 * t)
    if kind == "l2":
        norm = np.linalg.norm(d, axis=0)
        return d * np.where(norm > 0, np.maximum(1 - t / np.where(norm > 0, norm, 1), 0), 0)
    if kind == "linf":
        return d - np.column_stack([l1_ball(d[:, j], t) for j in range(d.shape[1])])
    raise ValueError(kind)


def edge(a: np.ndarray, b: np.ndarray, eta: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """argmin eta psi(x - y) + (|x - a|^2 + |y - b|^2) / 2."""
    if kind == "perturbation":
        return perturbed(a, b, eta)
    mean, d = (a + b) / 2, difference(a - b, 2 * eta, kind)
    return mean + d / 2, mean - d / 2


def perturbed(a: np.ndarray, b: np.ndarray, eta: float, rounds: int = 100, eps: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """The node penalty: x - y = v + v', the columns' norms of v penalised; by ADMM on v with exact x, y."""
    d = a - b
    v = z = d / 2
    u = np.zeros_like(d)
    # given v, |x-a|^2 + |y-b|^2 under x - y = v + v' leaves |v + v' - d|^2 / 4 (d symmetric)
    for _ in range(rounds):
        r = z - u
        sym, skew = (r + r.T) / 2, (r - r.T) / 2
        v = (d + sym) / 3 + skew
        was = z
        z = difference(v + u, eta, "l2")
        u = u + v - z
        if np.linalg.norm(v - z) < eps and np.linalg.norm(z - was) < eps:
            break
    d2 = z + z.T
    mean = (a + b) / 2
    return mean + d2 / 2, mean - d2 / 2
