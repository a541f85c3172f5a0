"""Sequence and structure distances: NumPy kernels for Arrow batches."""

from __future__ import annotations

import numpy as np

AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: The pairs of different residues with a positive BLOSUM62 score. All other pairs score 0 or less, which the distance below treats alike.
POSITIVE_SUBSTITUTIONS = {
    "AS": 1, "RQ": 1, "RK": 2, "ND": 1, "NH": 1, "NS": 1, "DE": 2, "QE": 2, "QK": 1, "EK": 1, "HY": 2,
    "IL": 2, "IM": 1, "IV": 3, "LM": 2, "LV": 1, "MV": 1, "FW": 1, "FY": 3, "ST": 1, "WY": 2,
}
MOST = 4


def substitution_matrix() -> np.ndarray:
    """(256, 256) residue distances by character code: 0 if equal, else min(4, 4 - BLOSUM62)."""
    out = np.full((256, 256), MOST, np.int16)
    np.fill_diagonal(out, 0)
    for pair, score in POSITIVE_SUBSTITUTIONS.items():
        a, b = map(ord, pair)
        out[a, b] = out[b, a] = MOST - score
    return out


_MATRIX = substitution_matrix()


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1", "replace"), np.uint8).reshape(len(words), length)


def loop_distance(a: list[str], b: list[str], *, weight: int = 1, gap: int = 4, ntrim: int = 0, ctrim: int = 0, fixed_gap: bool = True) -> np.ndarray:
    """Distances of pairs of loops: residues are compared from both ends around one gap; each residue of length difference costs `gap`. weight multiplies all."""
    out = np.zeros(len(a), np.int64)
    lengths = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = x or "", y or ""
        if len(x) > len(y):
            x, y = y, x
        lengths.setdefault((len(x), len(y)), []).append((i, x, y))
    for (short, long_), rows in lengths.items():
        at = np.array([r[0] for r in rows])
        if not short:
            out[at] = weight * gap * long_
            continue
        s, t = _codes([r[1] for r in rows], short), _codes([r[2] for r in rows], long_)
        if short == long_:
            stop = max(ntrim, short - ctrim)
            out[at] = weight * _MATRIX[s[:, ntrim:stop], t[:, ntrim:stop]].sum(1)
            continue
        first, last = _gap_places(short, fixed_gap)
        ahead, behind = _MATRIX[s, t[:, :short]].astype(np.int64), _MATRIX[s, t[:, long_ - short :]].astype(np.int64)
        costs = [ahead[:, ntrim:g].sum(1) + behind[:, g : max(g, short - ctrim)].sum(1) for g in range(first, last + 1)]
        out[at] = weight * (np.min(costs, axis=0) + gap * (long_ - short))
    return out


def _costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(len(x), len(y)) sums of the residue distances of two tables of codes, place by place, as one product of matrices: whole numbers that float32 holds."""
    letters = np.unique(x)
    spelled = (x[:, :, None] == letters).reshape(len(x), -1).astype(np.float32)
    return spelled @ _MATRIX[letters][:, y].transpose(2, 0, 1).reshape(-1, len(y)).astype(np.float32)


def loop_distances(a: list[str], b: list[str], *, weight: int = 1, gap: int = 4, ntrim: int = 0, ctrim: int = 0, fixed_gap: bool = True) -> np.ndarray:
    """(len(a), len(b)): loop_distance of every loop of a and every one of b, by position over whole tables of residues."""
    out = np.zeros((len(a), len(b)), np.int32)
    sides = []
    for words in (a, b):
        lengths: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            lengths.setdefault(len(w or ""), []).append(i)
        sides.append({n: (np.array(at), _codes([words[i] or "" for i in at], n)) for n, at in lengths.items()})
    for n, (rows, x) in sides[0].items():
        for m, (cols, y) in sides[1].items():
            short, long_ = min(n, m), max(n, m)
            stop, shift = max(ntrim, short - ctrim), long_ - short
            d = np.zeros((len(rows), len(cols)), np.float32)
            if not shift:
                if stop > ntrim:
                    d = _costs(x[:, ntrim:stop], y[:, ntrim:stop])
            elif short:
                first, last = _gap_places(short, fixed_gap)
                for g in range(first, last + 1):
                    i = np.r_[ntrim:g, g : max(g, short - ctrim)]
                    j = np.r_[ntrim:g, g + shift : max(g, short - ctrim) + shift]
                    at, to = (i, j) if n < m else (j, i)
                    total = _costs(x[:, at], y[:, to])
                    d = total if g == first else np.minimum(d, total)
            d = weight * (d + gap * shift)
            if d.shape == out.shape:  # one length a side
                return d.astype(np.int32)
            out[np.ix_(rows, cols)] = d
    return out


def _gap_places(short: int, fixed: bool) -> tuple[int, int]:
    """The first and last place of the gap in a loop of that length."""
    if fixed:
        place = max(0, min(6, 3 + (short - 5) // 2, short))
        return place, place
    first, last = 5, short - 5
    while first > last:
        first -= 1
        last += 1
    return max(0, first), min(short, last)


#: (regions of a chain, options): loops count once, the third thrice with its ends trimmed.
LOOPS = {"cdr_1": {}, "cdr_2": {}, "cdr_2_5": {}, "cdr_3": {"weight": 3, "ntrim": 3, "ctrim": 2, "fixed_gap": False}}


def receptor_distance(a: dict[str, list[str]], b: dict[str, list[str]], loops: dict[str, dict] = LOOPS) -> np.ndarray:
    """The sum over both chains of the loop distances of paired receptors; a and b map tcr_{1,2}_{region} to lists. Each distinct pair of loops is measured once."""
    n = len(next(iter(a.values())))
    total = np.zeros(n, np.int64)
    for chain in (1, 2):
        for region, options in loops.items():
            name = f"tcr_{chain}_{region}"
            pairs = list(zip(a[name], b[name], strict=True))
            distinct = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
            d = loop_distance([p[0] for p in distinct], [p[1] for p in distinct], **options)
            total += d[[distinct[p] for p in pairs]]
    return total


def receptor_distances(a: dict[str, list[str]], b: dict[str, list[str]], loops: dict[str, dict] = LOOPS) -> np.ndarray:
    """receptor_distance of every receptor of a and every one of b; equal loops are measured once."""
    total = np.zeros((len(next(iter(a.values()))), len(next(iter(b.values())))), np.int32)
    for chain in (1, 2):
        for region, options in loops.items():
            (x, at), (y, to) = (_distinct(side[f"tcr_{chain}_{region}"]) for side in (a, b))
            d = loop_distances(x, y, **options)
            total += d if d.shape == total.shape else d[at][:, to]
    return total


def _distinct(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct words and each word's place among them; where few are equal all words as they are."""
    found = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if 2 * len(found) > len(words):
        return words, np.arange(len(words))
    return list(found), np.array([found[w] for w in words])


def least_distance_by_length(difference: int, loops: dict[str, dict] = LOOPS) -> int:
    """A lower bound of a chain's distance from the difference of its third loops' lengths."""
    return loops["cdr_3"]["weight"] * MOST * difference


def longest_common_substring(a: str, b: str) -> int:
    if not a or not b:
        return 0
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row, best = np.zeros(len(y) + 1, np.int32), 0
    for c in x:
        row[1:] = np.where(y == c, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def superposed_rmsd(fit_a: np.ndarray, fit_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Root-mean-square distance of a and b after moving fit_a onto fit_b by the best rotation (Kabsch)."""
    ca, cb = fit_a.mean(0), fit_b.mean(0)
    u, _, vt = np.linalg.svd((fit_a - ca).T @ (fit_b - cb))
    turn = np.diag([1.0] * (len(vt) - 1) + [np.sign(np.linalg.det(u @ vt)) or 1.0])
    moved = (a - ca) @ (u @ turn @ vt) + cb
    return float(np.sqrt(((moved - b) ** 2).sum(1).mean()))


def complete_linkage(distances: np.ndarray, cut: float) -> np.ndarray:
    """Labels from 1, in order of first appearance: agglomeration by largest distance, stopped where it exceeds `cut`. A nearest-neighbour chain keeps it quadratic."""
    n = len(distances)
    d = distances.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    live, label, chain = np.ones(n, bool), np.arange(n), []
    while live.sum() > 1:
        if not chain:
            open_ = np.flatnonzero(live)
            close = d[open_].min(1) <= cut
            if not close.any():
                break
            chain.append(int(open_[close][0]))
        while True:
            x = chain[-1]
            y = int(np.argmin(np.where(live, d[x], np.inf)))
            if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
                y = chain.pop(-2)
                break
            chain.append(y)
        chain.pop()
        if d[x, y] > cut:
            d[x, :], d[:, x] = np.where(d[x] > cut, np.inf, d[x]), np.where(d[:, x] > cut, np.inf, d[:, x])
            d[x, y] = d[y, x] = np.inf
            continue
        merged = np.maximum(d[x], d[y])
        d[x, :], d[:, x] = merged, merged
        d[x, x] = np.inf
        live[y] = False
        d[y, :] = d[:, y] = np.inf
        label[label == label[y]] = label[x]
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(v), len(seen) + 1) for v in label])


def mahalanobis(points: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """All pairwise distances under an inverse covariance."""
    diff = points[:, None, :] - points[None, :, :]
    return np.sqrt(np.maximum(np.einsum("ijk,kl,ijl->ij", diff, inverse, diff), 0))


def angle_embedded(docking: np.ndarray, angle: int = 1) -> np.ndarray:
    """The docking columns with the angle replaced by its cosine and sine; our choice where none is published."""
    rest = np.delete(docking, angle, axis=1)
    return np.c_[rest, np.cos(docking[:, angle]), np.sin(docking[:, angle])]
