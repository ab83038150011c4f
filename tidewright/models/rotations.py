"""A six-qubit rotation regressor without a quantum package.

Input rotations give a product state of 64 real amplitudes; the trainable layers
(rotation, chain of controlled flips, rotation) are one fixed orthogonal matrix
W; the expectation of the mean Z observable is then the quadratic form
psi' W' D W psi, evaluated for a whole Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.functions.arrow import floats

QUBITS = 6


def _rotation(angle: float) -> np.ndarray:
    c, s = np.cos(angle / 2), np.sin(angle / 2)
    return np.array([[c, -s], [s, c]])


def _layer(angles: np.ndarray) -> np.ndarray:
    """Rotations on all qubits; qubit 0 is the last factor (least significant bit)."""
    m = np.ones((1, 1))
    for a in angles:
        m = np.kron(_rotation(a), m)
    return m


def _flip(control: int, target: int) -> np.ndarray:
    i = np.arange(1 << QUBITS)
    out = np.zeros((1 << QUBITS, 1 << QUBITS))
    out[i ^ (((i >> control) & 1) << target), i] = 1.0
    return out


def observable() -> np.ndarray:
    """Diagonal of the mean of the Z operators of all qubits."""
    i = np.arange(1 << QUBITS)
    return sum(1 - 2 * ((i >> q) & 1) for q in range(QUBITS)) / QUBITS


def quadratic_form(weights: np.ndarray, repetitions: int = 1) -> np.ndarray:
    """The 64 x 64 matrix of the prediction; ``weights`` holds six for each rotation layer."""
    w = np.asarray(weights, float).reshape(repetitions + 1, QUBITS)
    m = _layer(w[0])
    for r in range(1, repetitions + 1):
        for q in range(QUBITS - 1):
            m = _flip(q, q + 1) @ m
        m = _layer(w[r]) @ m
    return m.T @ (observable()[:, None] * m)


def states(angles: np.ndarray) -> np.ndarray:
    """Product states of rows of six input angles."""
    psi = np.ones((len(angles), 1))
    for q in range(QUBITS):
        half = angles[:, q] / 2
        psi = (np.stack([np.cos(half), np.sin(half)], axis=1)[:, :, None] * psi[:, None, :]).reshape(len(angles), -1)
    return psi


def expectation(angles: np.ndarray, weights: np.ndarray, repetitions: int = 1) -> np.ndarray:
    psi = states(angles)
    return np.clip(np.einsum("ni,ij,nj->n", psi, quadratic_form(weights, repetitions), psi, optimize=True), -1.0, 1.0)


def predict(df: DataFrame, angles: list[str], weights: np.ndarray, key: str, low: float = -1.0, high: float = 1.0, repetitions: int = 1) -> DataFrame:
    """(key, prediction): expectations mapped from [-1, 1] to [low, high]; null where an angle is."""
    form = quadratic_form(weights, repetitions)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = floats(b, angles)
            psi = states(np.nan_to_num(x))
            e = np.clip(((psi @ form) * psi).sum(1), -1.0, 1.0)
            y = np.where(np.isnan(x).any(axis=1), np.nan, low + (e + 1) / 2 * (high - low))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y, from_pandas=True)], names=[key, "prediction"])

    return df.select(key, *angles).mapInArrow(run, f"`{key}` {kind}, prediction double")


def fit(angles: np.ndarray, target: np.ndarray, evaluations: int = 80, repetitions: int = 1, seed: int = 42, on_best: Callable | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Weights by parameter shift: each rotation's loss is minimised in turn on a bounded sample.

    ``start`` restarts from earlier weights; ``on_best`` sees each improvement.
    """
    rng = np.random.default_rng(seed)
    w = rng.uniform(-0.1, 0.1, (repetitions + 1) * QUBITS) if start is None else np.array(start, float)
    loss = lambda v: float(np.mean((expectation(angles, v, repetitions) - target) ** 2))
    best, history = loss(w), []
    used, step = 1, np.pi / 4
    history.append(best)
    while used + 2 <= evaluations:
        improved = False
        for i in range(len(w)):
            if used + 2 > evaluations:
                break
            for d in (step, -step):
                v = w.copy()
                v[i] += d
                x = loss(v)
                used += 1
                if x < best:
                    best, w, improved = x, v, True
                    if on_best:
                        on_best(w, best)
                history.append(best)
        if not improved:
            step /= 2
    return w, history
