"""Banded global alignment of a short template to a part of a sequence."""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -4


def placed(sequence: str, template: str, low: int, high: int) -> list[int]:
    """For each residue of the template its place (from 0) in the sequence, -1 where it has none.

    Residue t may stand at t + d for d from low to high only. The template is aligned whole, the sequence's ends
    are free; of equal alignments the one with the smaller diagonals at the end is taken.
    """
    n, width = len(template), high - low + 1
    text, far = np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8), -(10**6)
    # score[t, d]: the best of template[:t] against the sequence up to (not including) t + low + d
    score, step = np.full((n + 1, width), far), np.zeros((n + 1, width), np.int8)
    score[0] = 0
    for t in range(1, n + 1):
        letter = ord(template[t - 1])
        at = t - 1 + low + np.arange(width)
        on = (at >= 0) & (at < len(text))
        same = np.where(on, np.where(text[np.clip(at, 0, len(text) - 1)] == letter, MATCH, MISMATCH), GAP)
        matched = score[t - 1] + same
        dropped = np.r_[score[t - 1][1:] + GAP, far]  # the template's residue has no place
        best, how = np.where(dropped > matched, dropped, matched), np.where(dropped > matched, 1, 0).astype(np.int8)
        for d in range(1, width):  # the sequence has a residue more
            if best[d - 1] + GAP > best[d]:
                best[d], how[d] = best[d - 1] + GAP, 2
        score[t], step[t] = best, how
    out, t, d = [-1] * n, n, int(score[n].argmax())
    while t > 0:
        if step[t, d] == 2:
            d -= 1
        elif step[t, d] == 1:
            t, d = t - 1, d + 1
        else:
            at = t - 1 + low + d
            out[t - 1] = at if 0 <= at < len(text) else -1
            t -= 1
    return out
