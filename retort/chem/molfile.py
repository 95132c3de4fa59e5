"""MDL molfiles (V2000) and SD records: reading and writing."""

from __future__ import annotations

import re

from .elements import NUMBER
from .molecule import Atom, Bond, InvalidMolecule, Molecule, sanitize
from .writer import to_smiles

_CHARGES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}  #: charge codes of the atom block


def read_molblock(text: str) -> Molecule:
    """The molecule of a V2000 connection table."""
    lines = text.split("\n")
    try:
        counts = lines[3]
        n_atoms, n_bonds = int(counts[:3]), int(counts[3:6])
        m = Molecule()
        for line in lines[4 : 4 + n_atoms]:
            symbol = line[31:34].strip()
            number = NUMBER.get({"D": "H", "T": "H"}.get(symbol, symbol))
            if number is None:
                raise InvalidMolecule(f"no element: {symbol}")
            code = int(line[36:39] or 0) if len(line) > 36 else 0
            m.add_atom(Atom(number, charge=_CHARGES.get(code, 0), isotope={"D": 2, "T": 3}.get(symbol, 0)))
        bonds = []
        for line in lines[4 + n_atoms : 4 + n_atoms + n_bonds]:
            a, b, order = int(line[:3]) - 1, int(line[3:6]) - 1, int(line[6:9])
            bonds.append((a, b, order))
        first_charge = True
        for line in lines[4 + n_atoms + n_bonds :]:
            if line.startswith("M  END"):
                break
            tag, values = line[:6], [int(v) for v in line[9:].split()] if line[:6] in ("M  CHG", "M  ISO", "M  RAD") else []
            for i, v in zip(values[::2], values[1::2], strict=True):
                if tag == "M  CHG":
                    if first_charge:
                        for a in m.atoms:
                            a.charge = 0
                        first_charge = False
                    m.atoms[i - 1].charge = v
                elif tag == "M  ISO":
                    m.atoms[i - 1].isotope = v
        if any(order == 4 for _, _, order in bonds):
            for a, b, order in bonds:
                if order == 4:
                    m.atoms[a].aromatic = m.atoms[b].aromatic = True
        for a, b, order in bonds:
            m.add_bond(Bond(a, b, order, order == 4))
    except (ValueError, IndexError) as e:
        raise InvalidMolecule(f"no connection table: {e}") from e
    from .molecule import kekulize

    kekulize(m)
    # Written hydrogens stay atoms; others are counted as for plain symbols.
    return sanitize(m)


def write_molblock(m: Molecule, title: str = "") -> str:
    """A V2000 connection table without coordinates; hydrogens stay implicit."""
    lines = [title, "  retort", "", f"{len(m.atoms):3d}{len(m.bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    for a in m.atoms:
        lines.append(f"{0:10.4f}{0:10.4f}{0:10.4f} {a.symbol:<3} 0  0  0  0  0  0  0  0  0  0  0  0")
    lines += [f"{b.a + 1:3d}{b.b + 1:3d}{b.order:3d}  0" for b in m.bonds]
    for tag, field in (("CHG", "charge"), ("ISO", "isotope")):
        found = [(i + 1, getattr(a, field)) for i, a in enumerate(m.atoms) if getattr(a, field)]
        for k in range(0, len(found), 8):
            part = found[k : k + 8]
            lines.append(f"M  {tag}{len(part):3d}" + "".join(f"{i:4d}{v:4d}" for i, v in part))
    return "\n".join([*lines, "M  END"])


_PROPERTY = re.compile(r"^>.*<([^>]*)>.*$")


def read_record(record: str) -> tuple[str | None, dict[str, str]]:
    """(SMILES or None, properties) of an SD record."""
    record = record.replace("\r\n", "\n")
    block, _, rest = record.partition("M  END")
    # Whatever stands above the counts line, title and comment make three lines.
    lines = block.split("\n")
    start = next((i for i, line in enumerate(lines) if line.rstrip().endswith("V2000")), 0)
    block = "\n".join(["", "", "", *lines[start:]])
    properties, name, value = {}, None, []
    for line in rest.split("\n")[1:]:
        if m := _PROPERTY.match(line):
            name, value = m.group(1), []
        elif name is not None and line.strip():
            value.append(line)
            properties[name] = "\n".join(value)
        elif name is not None:
            properties.setdefault(name, "")
            name = None
    try:
        return to_smiles(read_molblock(block + "M  END")), properties
    except InvalidMolecule:
        return None, properties


def write_record(m: Molecule, properties: dict[str, object]) -> str:
    lines = [write_molblock(m)]
    for k, v in properties.items():
        if v is not None:
            lines += [f">  <{k}>", str(v), ""]
    return "\n".join([*lines, "$$$$"])
