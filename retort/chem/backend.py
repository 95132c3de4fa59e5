"""The kernel behind structure operators: RDKit where it is installed, else this package's own."""

from __future__ import annotations

from functools import cache


@cache
def rdkit():
    """RDKit's Chem module, or None."""
    try:
        from rdkit import Chem, RDLogger
    except ImportError:
        return None
    RDLogger.DisableLog("rdApp.*")
    return Chem


def inchi(smiles: str | None) -> tuple[str | None, str | None]:
    """(InChI, InChIKey); NotImplementedError without RDKit, whose algorithm has no other implementation."""
    chem = rdkit()
    if chem is None:
        raise NotImplementedError("InChI needs RDKit")
    m = chem.MolFromSmiles(smiles or "") if smiles else None
    return (None, None) if m is None else (chem.MolToInchi(m) or None, chem.MolToInchiKey(m) or None)
