"""Rules of standardisation: valid atoms, salts, solvents, neutralisation. Immutable; every change gives new rules."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .molecule import InvalidMolecule, parse, parse_unchecked
from .smarts import UnsupportedSmarts, compile_smarts
from .writer import to_smiles

# Elements that may occur, neutralisation of charged atoms (pattern and what replaces its atom), patterns
# of inorganic carbon compounds, and the counter-ions, acids and bases (as patterns) and solvents that are stripped.
VALID_ATOMS = frozenset("Br C Cl F H I N O P S Si As Se Te At".split())
NEUTRALIZATION = (
    ("[n+;H]", "n"), ("[N+;!H0]", "N"), ("[$([O-]);!$([O-][#7])]", "O"), ("[S-;X1]", "S"), ("[$([N-;X2]S(=O)=O)]", "N"),
    ("[$([N-;X2][C,N]=C)]", "N"), ("[$([n-]1nnnc1),$([n-]1nncn1)]", "[nH]"), ("[$([N-]C=O)]", "N"), ("[$([N-;X2]C#N)]", "N"),
    ("[$([O-][N]C=O)]", "O"),
)
INORGANIC = (
    "[#6]#[#7]", "[#8]=[#6]=[#8]", "[#6]#[#8]", "[#8]=[#6]=[#16]", "[#8]=[#6]=[#6]=[#6]=[#8]", "[#8]~[#6](=[#8])~[#8]",
    "[#16]=[#6]=[#16]", "[#7]=[#6]=[#8]", "[#8]-[#6]#[#7]", "[#16]-[#6]#[#7]", "[#7]=[#6]=[#16]", "[#34]-[#6]#[#7]",
    "[F,Cl,Br,I]-[#6]#[#7]", "[#7]#[#6]-[#6]#[#7]", "[Cl]-[#6](=[#8])-[Cl]", "[Cl]-[#6](=[#16])-[Cl]", "[#6]",
)
SALTS = (
    "F[B-](F)(F)F",
    "NC(CCCNC(=N)N)C(=O)O",
    "CN(C)CCO",
    "CCN(CC)CCO",
    "NCCO",
    "CNCC(O)C(O)C(O)C(O)CO",
    "CC(=O)O",
    "CC(=O)NCC(=O)O",
    "CCCCCCCCCCCCCCCCCC(=O)O",
    "OC(=O)CCCCC(=O)O",
    "[Al]",
    "N",
    "OCC(O)C1OC(=O)C(=C1O)O",
    "NC(CC(=O)O)C(=O)O",
    "[Ba]",
    "C(Cc1ccccc1)NCc2ccccc2",
    "C(CNCc1ccccc1)NCc2ccccc2",
    "OC(=O)c1ccccc1",
    "OS(=O)(=O)c1ccccc1",
    "[Bi]",
    "Br",
    "CCCC=O",
    "CCCC(=O)OCC",
    "[Ca]",
    "CC1(C)C2CCC1(CS(=O)(=O)O)C(=O)C2",
    "OC(=O)O",
    "Cl",
    "C[N+](C)(C)CCO",
    "OC(=O)CC(O)(CC(=O)O)C(=O)O",
    "OS(=O)(=O)c1ccc(Cl)cc1",
    "OS(=O)(=O)NC1CCCCC1",
    "NC1CCCCC1",
    "OC(=O)C(Cl)Cl",
    "CCNCC",
    "CC(C)(N)CO",
    "OCCNCCO",
    "NCCN",
    "OS(=O)(=O)CCS(=O)(=O)O",
    "OCCN1CCCC1",
    "CC(C)(C)N",
    "CCCCCCCCCCCCOS(=O)(=O)O",
    "CCS(=O)(=O)O",
    "CCOS(=O)(=O)O",
    "F",
    "OC=O",
    "OCC(O)C(O)C(O)C(O)C(O)C(=O)O",
    "OCC(O)C(O)C(O)C(O)C(=O)O",
    "OC1OC(C(O)C(O)C1O)C(=O)O",
    "NC(CCC(=O)O)C(=O)O",
    "OCC(O)CO",
    "OCC(O)COP(=O)(O)O",
    "F[P](F)(F)(F)(F)F",
    "OP=O",
    "I",
    "OCCS(=O)(=O)O",
    "[K]",
    "CC(O)C(=O)O",
    "OCC(O)C(OC1OC(CO)C(O)C(O)C1O)C(O)C(O)C(=O)O",
    "[Li]",
    "NCCCCC(N)C(=O)O",
    "OC(CC(=O)O)C(=O)O",
    "OC(=O)C=CC(=O)O",
    "CS(=O)(=O)O",
    "OP(=O)=O",
    "COS(=O)(=O)O",
    "[Mg]",
    "OP(=O)(O)F",
    "[Na]",
    "OS(=O)(=O)c1cccc2c(cccc12)S(=O)(=O)O",
    "OS(=O)(=O)c1ccc2ccccc2c1",
    "O[N](=O)O",
    "OC(=O)C(=O)O",
    "CCCCCCCCCCCCCCCC(=O)O",
    "OC(=O)c1cc2ccccc2c(Cc3c(O)c(cc4ccccc34)C(=O)O)c1O",
    "OCl(=O)(=O)=O",
    "Nc1ccc(cc1)P(=O)(O)O",
    "OP(=O)(O)O",
    "Oc1c(cc(cc1[N+](=O)[O-])[N+](=O)[O-])[N+](=O)[O-]",
    "C1CNCCN1",
    "CC(O)CO",
    "O=C1NS(=O)(=O)c2ccccc12",
    "OC(=O)c1ccccc1O",
    "[Ag]",
    "[Sr]",
    "OC(=O)CCC(=O)O",
    "OS(=O)(=O)O",
    "OC(=O)c1cccc(c1O)S(=O)(=O)O",
    "[S-2]",
    "OC(=O)c1ccc(cc1)C(=O)O",
    "Cc1ccc(cc1)S(=O)(=O)O",
    "Oc1cc(Cl)c(Cl)cc1Cl",
    "CCN(CC)CC",
    "OC(=O)C(c1ccccc1)(c2ccccc2)c3ccccc3",
    "OC(=O)C(F)(F)F",
    "NC(CO)(CO)CO",
    "CCCCC1CCC(CC1)C(=O)O",
    "CCCC(=O)O",
    "CCCCCC(=O)O",
    "CC12CCC(CC1)(C=C2)C(=O)O",
    "OC(=O)CCC1CCCC1",
    "CN(C)CCC(=O)O",
    "OC(=O)CN(CCN(CC(=O)O)CC(=O)O)CC(=O)O",
    "CCCCCCCCC=CCCCCCCCC(=O)O",
    "CCCCCCC(=O)O",
    "CCOC(=O)O",
    "COCCO",
    "OC(=O)CNC(=O)c1ccccc1",
    "CCC(CC)C(=O)OCO",
    "CCCCCCCCCCCCCCOP(=O)(O)O",
    "OC(=O)c1occc1",
    "OC(=O)c1ccccc1C(=O)c2ccc(O)cc2",
    "CCCCCCCCCCCC(=O)O",
    "CC=C(C)C(=O)O",
    "COC(=O)CC(O)(CCCC(C)(C)O)C(=O)O",
    "OC(=O)c1cccc(c1)S(=O)(=O)O",
    "CSCCC(N)C(=O)C",
    "OC(=O)c1cccnc1",
    "OO",
    "OC(=O)CCc1ccccc1",
    "OC(=O)Cc1ccccc1",
    "CC(C)(C)C(=O)O",
    "CCC(=O)O",
    "CC(C)(C)CC(=O)O",
    "OCCN(CCO)CCO",
    "CCCCCCCCCCC(=O)O",
    "OC(=O)CCCCCCCCC=C",
    "CCCCC(=O)O",
    "O",
    "OC(=O)c1ccc2ccccc2c1O",
    "[Zn]",
    "c1c[nH]cn1",
    "OCCN1CCOCC1",
    "CC(=O)Nc1ccc(cc1)C(=O)O",
    "CC1(C)C(CCC1(C)C(=O)O)C(=O)O",
    "CCCCCCCCCC(=O)O",
    "CCCCCCCC(=O)O",
    "OC(=O)C=Cc1ccccc1",
    "OC(C(O)C(O)C(=O)O)C(O)C(=O)O",
    "OC(=O)c1cc(O)ccc1O",
    "OC(=O)CCCC(=O)O",
    "OC(=O)CCC(=O)C(=O)O",
    "OCC(=O)O",
    "CC(C)C(=O)O",
    "OC(C(=O)O)c1ccccc1",
    "OC(=O)c1cc(=O)nc(=O)n1",
    "OC(=O)C1CCC(=O)N1",
    "OC(C(O)C(=O)O)C(=O)O",
    "SC#N",
    "CI",
    "OS(=O)O",
    "C1CCC(CC1)NC2CCCCC2",
    "OS(=O)(=O)C(F)(F)F",
    "Cc1cc(C)c(c(C)c1)S(=O)(=O)O",
    "OC(=O)CC(=O)O",
    "OS(=O)(=O)F",
    "CC(=O)OS(=O)(=O)O",
    "[H]",
    "[Rb]",
    "[Cs]",
    "[Fr]",
    "[Be]",
    "[Ra]",
    "C(=O)C(O)C(O)C(O)C(O)C(=O)O",
    "CC(O)CN(C)C",
)
SOLVENTS = (
    "CC(C)O",
    "ClCCl",
    "CC(=O)C",
    "ClC(Cl)Cl",
    "CS(=O)C",
    "CCOC(=O)C",
    "CCO",
    "CO",
    "C1CCOC1",
    "CC#N",
    "C(=O)N(C)C",
    "CCCCCC",
    "Cc1ccccc1",
    "CCOCC",
)


class RuleError(ValueError):
    pass


def _pattern_key(smarts: str) -> str:
    """What tells salts apart: canonical SMILES where the pattern is one, else its text."""
    try:
        return to_smiles(parse_unchecked(smarts))
    except InvalidMolecule:
        return smarts


def _solvent_key(smiles: str) -> str:
    try:
        return to_smiles(parse(smiles))
    except InvalidMolecule as e:
        raise RuleError(f"no structure: {smiles}") from e


def _check_pattern(smarts: str) -> None:
    try:
        compile_smarts(smarts)
    except UnsupportedSmarts as e:
        raise RuleError(f"no pattern: {smarts}") from e


@dataclass(frozen=True)
class Rules:
    atoms: frozenset[str] = VALID_ATOMS
    salts: tuple[str, ...] = SALTS
    solvents: tuple[str, ...] = SOLVENTS
    neutralization: tuple[tuple[str, str], ...] = NEUTRALIZATION

    def with_neutralization(self, reactant: str, product: str) -> Rules:
        """An equal rule changes nothing; another product for a reactant replaces its rule and comes last."""
        _check_pattern(reactant)
        try:
            parse_unchecked(product)
        except InvalidMolecule as e:
            raise RuleError(f"no product: {product}") from e
        if (reactant, product) in self.neutralization:
            return self
        return replace(self, neutralization=(*(r for r in self.neutralization if r[0] != reactant), (reactant, product)))

    def without_neutralization(self, reactant: str) -> Rules:
        """KeyError if there is no such rule."""
        if all(r != reactant for r, _ in self.neutralization):
            raise KeyError(reactant)
        return replace(self, neutralization=tuple(r for r in self.neutralization if r[0] != reactant))

    def with_atoms(self, *symbols: str) -> tuple[Rules, list[str]]:
        """The rules, and symbols that are no elements."""
        good = []
        for s in symbols:
            try:
                parse_unchecked(f"[{s}]")
                good.append(s)
            except InvalidMolecule:
                continue
        return replace(self, atoms=self.atoms | set(good)), [s for s in symbols if s not in good]

    def without_atoms(self, *symbols: str) -> tuple[Rules, list[str]]:
        return replace(self, atoms=self.atoms - set(symbols)), [s for s in symbols if s not in self.atoms]

    def _with(self, kind: str, key, items: tuple[str, ...]) -> tuple[Rules, list[str]]:
        now, failed = getattr(self, kind), []
        for s in items:
            try:
                if kind == "salts":
                    _check_pattern(s)
                if key(s) not in {key(x) for x in now}:
                    now = (*now, s)
            except RuleError:
                failed.append(s)
        return replace(self, **{kind: now}), failed

    def _without(self, kind: str, key, items: tuple[str, ...]) -> tuple[Rules, list[str]]:
        now, failed = getattr(self, kind), []
        for s in items:
            try:
                left = tuple(x for x in now if key(x) != key(s))
            except RuleError:
                left = now
            if left == now:
                failed.append(s)
            now = left
        return replace(self, **{kind: now}), failed

    def with_salts(self, *smarts: str) -> tuple[Rules, list[str]]:
        return self._with("salts", _pattern_key, smarts)

    def without_salts(self, *smarts: str) -> tuple[Rules, list[str]]:
        return self._without("salts", _pattern_key, smarts)

    def with_solvents(self, *smiles: str) -> tuple[Rules, list[str]]:
        return self._with("solvents", _solvent_key, smiles)

    def without_solvents(self, *smiles: str) -> tuple[Rules, list[str]]:
        return self._without("solvents", _solvent_key, smiles)

    def to_dict(self) -> dict[str, list]:
        return {"atoms": sorted(self.atoms), "salts": list(self.salts), "solvents": list(self.solvents), "neutralization": list(self.neutralization)}

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(kind, pattern, product)."""
        rows = [(k, v, None) for k in ("atoms", "salts", "solvents") for v in self.to_dict()[k]]
        rows += [("neutralization", a, b) for a, b in self.neutralization]
        return spark.createDataFrame(rows, "kind string, pattern string, product string")

    def describe(self) -> str:
        lines = [f"Valid atoms: {', '.join(sorted(self.atoms))}", "Neutralisation:"]
        lines += [f"  {a} -> {b}" for a, b in self.neutralization]
        for kind in ("salts", "solvents"):
            lines += [f"{kind.capitalize()} ({len(getattr(self, kind))}):", *(f"  {s}" for s in getattr(self, kind))]
        return "\n".join(lines)


def read_rule_file(path: str) -> list[tuple[str, str]]:
    """(name, pattern) of a tab-separated file; comments and lines without two fields are left out."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip() and not line.startswith("#")]
    return [(r[0].strip(), r[1].strip()) for r in rows if len(r) >= 2]
