"""Helices of chains that are built from their torsion angles."""

import numpy as np
import pytest

from paratope.functions.helices import helical
from paratope.operators import features


def placed(a, b, c, length, angle, torsion):
    """The point at `length` from c, at `angle` to b, at `torsion` about b-c to a."""
    bc = (c - b) / np.linalg.norm(c - b)
    n = np.cross(b - a, bc)
    n /= np.linalg.norm(n)
    d = length * np.array([-np.cos(angle), np.sin(angle) * np.cos(torsion), np.sin(angle) * np.sin(torsion)])
    return c + d[0] * bc + d[1] * np.cross(n, bc) + d[2] * n


def chain(angles):
    """(n, 4, 3) backbone of residues with these (phi, psi) in degrees."""
    rad = np.radians
    n, ca, c = np.array([0.0, 0, 0]), np.array([1.46, 0, 0]), np.array([2.0, 1.42, 0])
    rows = []
    for i, (_, psi) in enumerate(angles):
        following = angles[i + 1][0] if i + 1 < len(angles) else -60
        n2 = placed(n, ca, c, 1.33, rad(116), rad(psi))
        o = placed(n, ca, c, 1.23, rad(121), rad(psi + 180))
        rows.append([n, ca, c, o])
        ca2 = placed(ca, c, n2, 1.46, rad(122), np.pi)
        c2 = placed(c, n2, ca2, 1.52, rad(111), rad(following))
        n, ca, c = n2, ca2, c2
    return np.array(rows)


def test_helices_and_strands():
    helix, strand = [(-57, -47)] * 20, [(-120, 130)] * 20
    inside = helical(chain(helix))
    assert inside[1:-1].all() and not inside[0] and not inside[-1]
    assert not helical(chain(strand)).any()
    mixed = helical(chain(strand[:10] + helix + strand[:10]))
    assert mixed[12:28].all() and not mixed[:9].any() and not mixed[-9:].any()
    three = helical(chain([(-49, -26)] * 16))
    assert three[2:-2].all()
    for n in range(4):
        assert not helical(chain(helix[:n]) if n else np.zeros((0, 4, 3))).any()


def test_flags_of_jobs(spark):
    rows = []
    for job, role, angles in (("a", "mhc_1", [(-57, -47)] * 20), ("a", "mhc_2", [(-120, 130)] * 12), ("b", "mhc_1", [(-120, 130)] * 5 + [(-57, -47)] * 20)):
        for i, residue in enumerate(chain(angles)):
            rows += [(job, role, i, name, *map(float, p)) for name, p in zip(("N", "CA", "C", "O"), residue, strict=True)]
    rows.append(("b", "mhc_1", 99, "CA", 0.0, 0.0, 0.0))
    atoms = spark.createDataFrame(rows, "job_name string, role string, resindex int, name string, x double, y double, z double")
    flags = features.helix_flags(atoms)
    found = {}
    for r in flags.collect():
        found.setdefault((r.job_name, r.role), []).append((r.resindex, r.is_helix))
    counts = {k: sum(v for _, v in rows) for k, rows in found.items()}
    assert counts["a", "mhc_1"] == 18 and counts["a", "mhc_2"] == 0 and counts["b", "mhc_1"] == pytest.approx(18, abs=2) and len(found["b", "mhc_1"]) == 26
    jobs = spark.createDataFrame([("a", "I"), ("b", "I")], "job_name string, mhc_class string")
    assert {r.job_name for r in features.mhc_helices(flags, jobs).collect()} == {"a", "b"}


def test_prolines_give_no_hydrogen(spark):
    """Prolines side by side take a helix its bonds there, which parts it."""
    backbone = chain([(-57, -47)] * 24)
    donors = np.ones(24, bool)
    donors[10:14] = False
    assert helical(backbone).sum() == 22 and helical(backbone, donors).sum() < 22
    rows = [("a", "mhc_1", i, name, "PRO" if 10 <= i < 14 else "ALA", *map(float, p)) for i, residue in enumerate(backbone) for name, p in zip(("N", "CA", "C", "O"), residue, strict=True)]
    atoms = spark.createDataFrame(rows, "job_name string, role string, resindex int, name string, resname string, x double, y double, z double")
    flags = [r.is_helix for r in features.helix_flags(atoms).orderBy("resindex").collect()]
    assert flags == helical(backbone, donors).tolist()
    assert sum(r.is_helix for r in features.helix_flags(atoms.drop("resname")).collect()) == 22
