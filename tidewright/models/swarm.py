"""A small kernel regressor and the particle swarm that tunes it, for bounded samples.

Both run on the driver over at most ``ROWS`` rows, which is what a kernel matrix
allows; larger inputs are refused rather than cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

ROWS = 5000


@dataclass
class KernelRegressor:
    """Epsilon-insensitive regression with a Gaussian kernel, by projected gradient on the dual."""

    C: float = 1.0
    gamma: float = 0.1
    epsilon: float = 0.1
    rounds: int = 300
    x: np.ndarray = field(default=None, repr=False)
    beta: np.ndarray = field(default=None, repr=False)
    shift: float = 0.0

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "KernelRegressor":
        if len(x) > ROWS:
            raise ValueError(f"a kernel model takes at most {ROWS} rows")
        self.x, self.shift = x, float(np.mean(y))
        k = self._kernel(x, x)
        rate = 1.0 / max(float(np.linalg.norm(k, 2)), 1e-9)
        b = v = np.zeros(len(x))
        for t in range(self.rounds):  # accelerated proximal steps
            g = v - rate * (k @ v - (y - self.shift))
            new = np.clip(np.sign(g) * np.maximum(np.abs(g) - rate * self.epsilon, 0), -self.C, self.C)
            v = new + t / (t + 3) * (new - b)
            b = new
        self.beta = b
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._kernel(x, self.x) @ self.beta + self.shift


@dataclass(frozen=True)
class SwarmConfig:
    particles: int = 8
    rounds: int = 10
    spread_start: float = 1.0
    spread_end: float = 0.5
    bounds: tuple[tuple[float, float], ...] = ((-1.0, 3.0), (-4.0, 1.0), (-3.0, 0.0))
    seed: int = 42

    def __post_init__(self):
        if self.particles < 2 or self.rounds < 1:
            raise ValueError("a swarm has at least two particles and one round")
        if not 0 < self.spread_end <= self.spread_start:
            raise ValueError("the spread must shrink and stay above zero")
        if any(a >= b for a, b in self.bounds):
            raise ValueError("bounds must increase")


def swarm(loss: Callable[[np.ndarray], float], config: SwarmConfig = SwarmConfig()) -> tuple[np.ndarray, float, list[float]]:
    """Minimise ``loss`` over points of ten-to-the-power coordinates.

    Each round a particle is drawn about a random point between its own best and
    the swarm's, at a log-distributed distance scaled by its distance from the
    mean best; (point, loss, best loss of each round).
    """
    c, rng = config, np.random.default_rng(config.seed)
    low, high = np.array(c.bounds).T
    at = low + (high - low) * rng.random((c.particles, len(low)))
    score = lambda pts: np.array([loss(10.0**p) for p in pts])
    own, own_loss = at.copy(), score(at)
    if not np.isfinite(own_loss).all():
        raise ValueError("the loss must be finite")
    history = []
    for spread in np.linspace(c.spread_start, c.spread_end, c.rounds):
        top = own[own_loss.argmin()]
        mix = rng.random(at.shape)
        pull = mix * own + (1 - mix) * top
        hop = spread * np.abs(own.mean(0) - at) * -np.log(np.maximum(rng.random(at.shape), 1e-300))
        at = np.clip(np.where(rng.random(at.shape) < 0.5, pull - hop, pull + hop), low, high)
        now = score(at)
        better = now < own_loss
        own[better], own_loss[better] = at[better], now[better]
        history.append(float(own_loss.min()))
    return 10.0 ** own[own_loss.argmin()], float(own_loss.min()), history


def tuned_kernel(x: np.ndarray, y: np.ndarray, folds: int = 3, config: SwarmConfig = SwarmConfig()) -> tuple[KernelRegressor, dict]:
    """The kernel model whose (C, gamma, epsilon) a swarm finds by cross-validated error."""
    if len(x) < 10 or len(x) < folds:
        raise ValueError("at least ten rows are needed")
    fold = np.random.default_rng(config.seed).permutation(len(x)) % folds

    def loss(p: np.ndarray) -> float:
        return float(np.mean([np.abs(KernelRegressor(*p).fit(x[fold != f], y[fold != f]).predict(x[fold == f]) - y[fold == f]).mean() for f in range(folds)]))

    best, mae, history = swarm(loss, config)
    return KernelRegressor(*best).fit(x, y), {"C": best[0], "gamma": best[1], "epsilon": best[2], "cv_mae": mae, "evaluations": config.particles * (config.rounds + 1), "history": history}
