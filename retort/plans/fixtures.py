"""Structures with known outcomes, by the step that they show: (SMILES, flags' outcome: valid, log, canonical SMILES)."""

from __future__ import annotations

OK = "Success"
FLAGS: dict[str, dict] = {
    "default": {}, "stereo": {"remove_stereo": True}, "isotopes": {"remove_isotopes": True}, "hydrogens": {"remove_isotopes": False},
    "salts": {"remove_solvents": False}, "solvents": {"remove_salts": False}, "mixtures": {"remove_mixtures": True},
    "mixtures_strict": {"remove_mixtures": True, "keep_largest_fragment": False}, "inorganic": {}, "radicals": {},
    "neutralize": {}, "reject_charged": {"reject_non_neutral": True}, "atoms": {"check_valid_atoms": True},
    "atoms_strict": {"check_valid_atoms": True, "strict_atom_check": True},
}
CASES: dict[str, list[tuple[str | None, str, str | None]]] = {
    "default": [("OCC", OK, "CCO"), ("", "Empty SMILES", None), (None, "Empty SMILES", None), ("234", "Invalid SMILES", None), ("C1=CC=CC=C1", OK, "c1ccccc1"), ("NaCl", "Invalid SMILES", None), ("c1ccc2ccccc2c1", OK, "c1ccc2ccccc2c1")],
    "stereo": [("N[C@@H](C)C(=O)O", OK, "CC(N)C(=O)O"), ("F/C=C/F", OK, "FC=CF")],
    "isotopes": [("[13CH3]CO", OK, "CCO"), ("[2H]C([2H])([2H])O", OK, "CO")],
    "hydrogens": [("[H]C([H])([H])C", OK, "CC"), ("[2H]C", OK, "[2H]C")],
    "salts": [("C[NH3+].[Cl-]", OK, "CN"), ("[Na+].CCCC(C)S", OK, "CCCC(C)S"), ("CC(=O)[O-].[Na+]", OK, "CC(=O)O"), ("CCCS.CCCS.Cl", OK, "CCCS")],
    "solvents": [("CCO.CO", OK, "CCO"), ("CCCCCS.CC#N", OK, "CCCCCS"), ("CCCS.CCCS.CO", OK, "CCCS")],
    "mixtures": [("c1ccccc1.CCCCS", OK, "c1ccccc1"), ("CCCCS.CS", OK, "CCCCS"), ("CS.CCS", "Mixture removal failed", None)],
    "mixtures_strict": [("c1ccccc1.CCCCS", "Mixture removal failed", None), ("CCCCS", OK, "CCCCS")],
    "inorganic": [("C", "Inorganic removal failed", None), ("C#N", "Inorganic removal failed", None), ("CC#N", OK, "CC#N"), ("O", "Inorganic removal failed", None), ("O=C=O", "Inorganic removal failed", None), ("ClC(=O)Cl", "Inorganic removal failed", None)],
    "radicals": [("C[CH2]", "Radical check failed", None), ("CC", OK, "CC")],
    "neutralize": [("C[N+](C)(C)C", OK, "C[N+](C)(C)C"), ("c1cc[nH+]cc1.[Cl-]", OK, "c1ccncc1"), ("CC[S-].[K+]", OK, "CCS")],
    "reject_charged": [("C[N+](C)(C)C", "Charge neutralization and Non-neutral rejection failed", None), ("CCS", OK, "CCS")],
    "atoms": [("CC[Hg]CC", "Atom validation failed", None), ("C[Si](C)(C)C", OK, "C[Si](C)(C)C"), ("CCCl.[Zr]", OK, "CCCl")],
    "atoms_strict": [("CCCl.[Zr]", "Atom validation failed", None), ("CCCl", OK, "CCCl")],
}
#: SMILES, heavy atoms, all atoms, weight to two decimals, whether it has an aromatic ring of carbon, whether a hydroxyl.
COUNTED = [
    ("CCO", 3, 9, 46.07, False, True), ("c1ccccc1", 6, 12, 78.11, True, False), ("CC(=O)Oc1ccccc1C(=O)O", 13, 21, 180.16, True, True),
    ("C", 1, 5, 16.04, False, False), ("bad(", None, None, None, False, False), (None, None, None, None, False, False), ("Oc1ccccc1", 7, 13, 94.11, True, True),
]


def literal(v: object) -> str:
    """SQL text of a value."""
    match v:
        case None:
            return "NULL"
        case bool():
            return str(v).lower()
        case str():
            return "'" + v.replace("'", "''") + "'"
        case _:
            return str(v)


def values(rows: list[tuple]) -> str:
    """SQL rows, numbered in a first column."""
    return ", ".join("(" + ", ".join([str(i), *map(literal, r)]) + ")" for i, r in enumerate(rows))
