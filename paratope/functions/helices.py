"""Helices from backbone atoms: hydrogen bonds by the electrostatic energy of Kabsch and Sander (1983), turns and the residues inside them."""

from __future__ import annotations

import numpy as np

#: 332 kcal Å/mol times the partial charges 0.42 e and 0.20 e; the energy below which a bond counts; the length of N-H.
CHARGE, BOND, NH = 332 * 0.42 * 0.20, -0.5, 1.01


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def turns(backbone: np.ndarray, size: int, donors: np.ndarray) -> np.ndarray:
    """Whether the C=O of each residue takes a bond from the N-H of the one `size` further on. backbone: (n, 4, 3) of N, CA, C and O; donors: the residues whose N has a hydrogen; the first one's isn't placed."""
    n = len(backbone)
    out = np.zeros(n, bool)
    if n <= size:
        return out
    nitrogen, alpha, before = backbone[size:, 0], backbone[size:, 1], backbone[size - 1 : -1, 2]
    hydrogen = nitrogen + NH * _unit(_unit(nitrogen - before) + _unit(nitrogen - alpha))
    carbon, oxygen = backbone[:-size, 2], backbone[:-size, 3]
    near = lambda a, b: 1 / np.maximum(np.linalg.norm(a - b, axis=-1), 1e-3)
    energy = CHARGE * (near(oxygen, nitrogen) + near(carbon, hydrogen) - near(oxygen, hydrogen) - near(carbon, nitrogen))
    out[: n - size] = (energy < BOND) & donors[size:]
    return out


def helical(backbone: np.ndarray, donors: np.ndarray | None = None) -> np.ndarray:
    """Whether each residue is inside a helix (donors: those whose N has a hydrogen, all if not given): two turns of the same size in a row make one; those of size 4 come first, and 3 and 5 only where they leave it alone."""
    n, begins = len(backbone), {}
    donors = np.ones(n, bool) if donors is None else donors
    for size in (3, 4, 5):
        turn = np.r_[turns(backbone, size, donors), False]
        begins[size] = np.r_[False, turn[:-2] & turn[1:-1]][:n] if n else np.zeros(0, bool)  # the helix begins behind the first turn's first residue

    def covered(starts: np.ndarray, size: int) -> np.ndarray:
        inside = np.zeros(n + size, bool)
        for k in range(size):
            inside[k : k + n] |= starts
        return inside[:n]

    four = covered(begins[4], 4)
    taken = four | np.r_[four[1:], False] if n else four
    return four | covered(begins[3] & ~taken, 3) | covered(begins[5] & ~taken, 5)
