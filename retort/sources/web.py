"""Connectors to public web services of chemical properties, for enrich().

Each is a CallConnector around a small function over a Web, which does the requests; tests put another in its place.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from ..chem.backend import inchi
from ..functions.cas import clean_text
from ..operators.enrich import CallConnector, GivenUp

quoted = urllib.parse.quote


@dataclass(frozen=True)
class Web:
    """HTTP with a time limit. A page that isn't there is None; other client errors are GivenUp, the rest OSError."""

    timeout: float = 15.0
    headers: dict[str, str] = field(default_factory=dict)

    def text(self, url: str, query: dict[str, str] | None = None, body: dict | None = None) -> str | None:
        if query:
            url = f"{url}?{urllib.parse.urlencode(query)}"
        data = None if body is None else json.dumps(body).encode()
        headers = self.headers | ({"Content-Type": "application/json"} if data else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=self.timeout) as reply:
                return reply.read().decode()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if 400 <= e.code < 500 and e.code != 429:
                raise GivenUp(url) from e
            raise

    def json(self, url: str, query: dict[str, str] | None = None, body: dict | None = None):
        got = self.text(url, query, body)
        return None if got is None else json.loads(got)


Fetch = Callable[[str, str, list[str]], dict]


def _chosen(values: dict, properties: list[str]) -> dict:
    return {p: v for p, v in values.items() if p in properties and v not in (None, "")}


def _first_cas(names: list[str]) -> str | None:
    return next((c for n in names if (c := clean_text(n))), None)


# Fixed values below: the services' addresses and the names of their fields.
PUBCHEM = "https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound"
CHEMSPIDER = "https://api.rsc.org/compounds/v1"
COMPTOX = "https://comptox.epa.gov/ctx-api/chemical"
CACTUS = "https://cactus.nci.nih.gov/chemical/structure"
CHEMBL = "https://www.ebi.ac.uk/chembl/api/data/molecule.json"
COMMON_CHEMISTRY = "https://commonchemistry.cas.org/api"


def pubchem(web: Web | None = None, **pace) -> CallConnector:
    """Properties and synonyms by name, CAS number (as a name) or structure; through the compound number if need be."""
    web = web or Web()

    def of(space: str, value: str, properties: list[str]) -> dict:
        at, found = f"{PUBCHEM}/{space}/{quoted(value, safe='')}", {}
        table = web.json(f"{at}/property/CanonicalSMILES,ConnectivitySMILES,IUPACName,MolecularWeight/JSON") or {}
        if rows := table.get("PropertyTable", {}).get("Properties"):
            r = rows[0]
            found = {"smiles": r.get("CanonicalSMILES") or r.get("ConnectivitySMILES"), "iupac": r.get("IUPACName"), "mw": r.get("MolecularWeight")}
        if {"name", "cas"} & set(properties):
            listed = (web.json(f"{at}/synonyms/JSON") or {}).get("InformationList", {}).get("Information") or [{}]
            names = listed[0].get("Synonym") or []
            found |= {"name": names[0] if names else None, "cas": _first_cas(names)}
        return _chosen(found, properties)

    def fetch(key: str, kind: str, properties: list[str]) -> dict:
        space = "smiles" if kind == "smiles" else "name"
        if found := of(space, key, properties):
            return found
        numbers = (web.json(f"{PUBCHEM}/{space}/{quoted(key, safe='')}/cids/JSON") or {}).get("IdentifierList", {}).get("CID")
        return of("cid", str(numbers[0]), properties) if numbers else {}

    return CallConnector("pubchem", fetch, **pace)


def chemspider(key: str, web: Web | None = None, polls: int = 3, nap: Callable[[float], None] = time.sleep, **pace) -> CallConnector:
    """A search job, then the first hit's record: structure, weight and name."""
    web = web or Web(headers={"apikey": key, "Accept": "application/json"})
    names = {"smiles": ("SMILES", "smiles"), "mw": ("MolecularWeight", "molecularWeight"), "name": ("CommonName", "commonName")}

    def fetch(value: str, kind: str, properties: list[str]) -> dict:
        asked = [p for p in properties if p in names]
        if not asked:
            return {}
        by = "smiles" if kind == "smiles" else "name"
        job = (web.json(f"{CHEMSPIDER}/filter/{by}", body={by: value}) or {}).get("queryId")
        for _ in range(polls if job else 0):
            state = (web.json(f"{CHEMSPIDER}/filter/{job}/status") or {}).get("status")
            if state == "Complete":
                hits = (web.json(f"{CHEMSPIDER}/filter/{job}/results") or {}).get("results") or []
                if not hits:
                    return {}
                record = web.json(f"{CHEMSPIDER}/records/{hits[0]}/details", {"fields": ",".join(names[p][0] for p in asked)}) or {}
                return _chosen({p: record.get(names[p][1]) for p in asked}, properties)
            if state == "Failed":
                return {}
            nap(2)
        return {}

    return CallConnector("chemspider", fetch, **pace)


def _inchikey(smiles: str) -> str | None:
    try:
        return inchi(smiles)[1]
    except NotImplementedError:
        return None


def comptox(key: str, web: Web | None = None, **pace) -> CallConnector:
    """By name or CAS number, or by a structure's InChIKey where that can be computed."""
    web = web or Web(headers={"x-api-key": key})
    names = {"smiles": "smiles", "iupac": "iupacName", "mw": "averageMass", "cas": "casrn", "name": "preferredName"}

    def fetch(value: str, kind: str, properties: list[str]) -> dict:
        term = _inchikey(value) if kind == "smiles" else value
        hits = web.json(f"{COMPTOX}/search/equal/{quoted(term, safe='')}") if term else None
        number = hits[0].get("dtxsid") if isinstance(hits, list) and hits else None
        record = web.json(f"{COMPTOX}/detail/search/by-dtxsid/{quoted(number, safe='')}") if number else None
        return _chosen({p: (record or {}).get(f) for p, f in names.items()}, properties)

    return CallConnector("comptox", fetch, **pace)


def cactus(web: Web | None = None, **pace) -> CallConnector:
    """One request for each property; of several CAS numbers the shortest."""
    web = web or Web(timeout=10.0)
    names = {"cas": "cas", "iupac": "iupac_name", "smiles": "smiles", "mw": "mw", "name": "names"}

    def fetch(value: str, kind: str, properties: list[str]) -> dict:
        term = _inchikey(value) if kind == "smiles" else value
        found = {}
        for p in properties if term else ():
            lines = (web.text(f"{CACTUS}/{quoted(term, safe='')}/{names[p]}") or "").strip().split("\n")
            if p == "cas":
                found[p] = min((c for x in lines if (c := clean_text(x))), key=len, default=None)
            else:
                found[p] = lines[0] if p == "name" else "\n".join(lines)
        return _chosen(found, properties)

    return CallConnector("cactus", fetch, **pace)


def chembl(web: Web | None = None, **pace) -> CallConnector:
    """By exact canonical structure or preferred name; knows no CAS numbers."""
    web = web or Web()
    by = {"smiles": "molecule_structures__canonical_smiles__exact", "name": "pref_name__iexact"}

    def fetch(value: str, kind: str, properties: list[str]) -> dict:
        found = (web.json(CHEMBL, {by[kind]: value}) or {}).get("molecules") if kind in by else None
        if not found:
            return {}
        m = found[0]
        name = m.get("pref_name")
        values = {"smiles": (m.get("molecule_structures") or {}).get("canonical_smiles"), "iupac": name, "mw": (m.get("molecule_properties") or {}).get("full_mwt"), "name": name}
        return _chosen(values, properties)

    return CallConnector("chembl", fetch, **pace)


def common_chemistry(key: str, web: Web | None = None, **pace) -> CallConnector:
    """A search, then the first hit's detail; knows no IUPAC names. Errors count as nothing found."""
    web = web or Web(headers={"X-Api-Key": key})

    def fetch(value: str, kind: str, properties: list[str]) -> dict:
        try:
            hits = (web.json(f"{COMMON_CHEMISTRY}/search", {"q": value}) or {}).get("results") or [{}]
            number = hits[0].get("rn")
            d = (web.json(f"{COMMON_CHEMISTRY}/detail", {"cas_rn": number}) if number else None) or {}
        except (OSError, GivenUp, ValueError):
            return {}
        values = {"smiles": d.get("canonicalSmile") or d.get("smile"), "mw": d.get("molecularMass"), "cas": d.get("rn"), "name": d.get("name") or next(iter(d.get("synonyms") or []), None)}
        return _chosen(values, properties)

    return CallConnector("cas", fetch, **pace)


SERVICES = {"pubchem": pubchem, "chemspider": chemspider, "comptox": comptox, "cactus": cactus, "chembl": chembl, "cas": common_chemistry}


def connectors(sources: str | list[str], keys: dict[str, str] | None = None, **pace) -> list[CallConnector]:
    """Connectors by name, in order. ValueError for an unknown source or one without its key."""
    out = []
    for s in [sources] if isinstance(sources, str) else sources:
        make = SERVICES.get(s.strip().lower())
        if make is None:
            raise ValueError(f"unknown source: {s}")
        if make in (chemspider, comptox, common_chemistry):
            if not (keys or {}).get(s.strip().lower()):
                raise ValueError(f"{s} needs a key")
            out.append(make(keys[s.strip().lower()], **pace))
        else:
            out.append(make(**pace))
    return out
