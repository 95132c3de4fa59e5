import json

import pytest

from retort.functions.cas import clean_text
from retort.sources import web


class Stub:
    """Pages by the end of their address; anything else isn't there."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def text(self, url, query=None, body=None):
        self.asked.append((url, query, body))
        return next((p if isinstance(p, str) else json.dumps(p) for end, p in self.pages.items() if url.endswith(end)), None)

    def json(self, url, query=None, body=None):
        got = self.text(url, query, body)
        return None if got is None else json.loads(got)


EVERY = ["smiles", "cas", "iupac", "mw", "name"]


def test_pubchem():
    table = {"PropertyTable": {"Properties": [{"ConnectivitySMILES": "CCO", "IUPACName": "ethanol", "MolecularWeight": "46.07"}]}}
    names = {"InformationList": {"Information": [{"Synonym": ["alcohol", "64-17-4", "64-17-5"]}]}}
    c = web.pubchem(Stub({"MolecularWeight/JSON": table, "synonyms/JSON": names}))
    assert c.fetch("64-17-5", "cas", EVERY) == {"smiles": "CCO", "iupac": "ethanol", "mw": "46.07", "name": "alcohol", "cas": "64-17-5"}
    assert c.fetch("x", "name", ["mw"]) == {"mw": "46.07"}
    late = Stub({"name/odd%2Fname/cids/JSON": {"IdentifierList": {"CID": [702]}}, "cid/702/property/CanonicalSMILES,ConnectivitySMILES,IUPACName,MolecularWeight/JSON": table})
    assert web.pubchem(late).fetch("odd/name", "name", ["iupac"]) == {"iupac": "ethanol"}
    assert web.pubchem(Stub({})).fetch("x", "smiles", EVERY) == {}


def test_chemspider():
    stub = Stub({"filter/name": {"queryId": "q"}, "q/status": {"status": "Complete"}, "q/results": {"results": [5, 6]}, "records/5/details": {"smiles": "CCO", "commonName": "Ethanol"}})
    assert web.chemspider("k", stub).fetch("ethanol", "name", ["name", "smiles", "cas"]) == {"smiles": "CCO", "name": "Ethanol"}
    naps = []
    slow = Stub({"filter/smiles": {"queryId": "q"}, "q/status": {"status": "Processing"}})
    assert web.chemspider("k", slow, nap=naps.append).fetch("CCO", "smiles", ["name"]) == {} and naps == [2, 2, 2]


def test_comptox():
    stub = Stub({"equal/64-17-5": [{"dtxsid": "D1"}], "by-dtxsid/D1": {"smiles": "CCO", "casrn": "64-17-5", "averageMass": 46.07, "preferredName": "Ethanol"}})
    c = web.comptox("k", stub)
    assert c.fetch("64-17-5", "cas", EVERY) == {"smiles": "CCO", "mw": 46.07, "cas": "64-17-5", "name": "Ethanol"}
    assert c.fetch("none", "name", EVERY) == {} and c.fetch("CCO", "smiles", EVERY) == {}


def test_cactus():
    c = web.cactus(Stub({"ethanol/cas": "8024-45-1\n64-17-5\n64-17-4", "ethanol/names": "alcohol\nethanol\n", "ethanol/mw": "46.07"}))
    assert c.fetch("ethanol", "name", EVERY) == {"cas": "64-17-5", "name": "alcohol", "mw": "46.07"}


def test_chembl():
    page = {"molecules": [{"pref_name": "ETHANOL", "molecule_structures": {"canonical_smiles": "CCO"}, "molecule_properties": None}]}
    c = web.chembl(Stub({"molecule.json": page}))
    assert c.fetch("ethanol", "name", EVERY) == {"smiles": "CCO", "iupac": "ETHANOL", "name": "ETHANOL"} and c.fetch("64-17-5", "cas", EVERY) == {}


def test_common_chemistry():
    stub = Stub({"search": {"results": [{"rn": "64-17-5"}]}, "detail": {"rn": "64-17-5", "smile": "CCO", "synonyms": ["alcohol"]}})
    assert web.common_chemistry("k", stub).fetch("x", "name", EVERY) == {"smiles": "CCO", "cas": "64-17-5", "name": "alcohol"}

    class Broken:
        def json(self, *a):
            raise OSError

    assert web.common_chemistry("k", Broken()).fetch("x", "name", EVERY) == {}


def test_by_name():
    assert [c.source for c in web.connectors(["PubChem ", "cas"], {"cas": "k"}, interval=0)] == ["pubchem", "cas"]
    for bad in ("nowhere", "comptox"):
        with pytest.raises(ValueError):
            web.connectors(bad)


@pytest.mark.parametrize("case", [("CAS: 64-17-5", "64-17-5"), ("50000", "50-00-0"), ("7732-18-4", None), ("n/a", None), (None, None), ("64175.0", None)])
def test_cas_text(case):
    assert clean_text(case[0]) == case[1]
