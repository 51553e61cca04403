"""Settings of a run, and their INI form."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields

from infotraj.operators.estimators import ESTIMATORS
from infotraj.sources.selection import PAIR_TYPES

_FLAGS = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}
#: What the names of worksets stand for. Pairs bring their types' one-dimensional sets along.
WORKSETS = {"NOTHING": (), "NONE": (), "B1D": ("bond",), "A1D": ("angle",), "D1D": ("torsion",), "1D": ("bond", "angle", "torsion"),
    "BB2D": ("BB",), "AA2D": ("AA",), "DD2D": ("DD",), "BA2D": ("BA",), "BD2D": ("BD",), "AD2D": ("AD",), "XX2D": ("BB", "AA", "DD"), "XY2D": ("BA", "BD", "AD"), "2D": tuple(PAIR_TYPES)}


@dataclass
class Config:
    """Defaults are those of the INI keys of the same names; section names are in SECTIONS."""

    infilepath: str = ""
    outfilepath: str = ""
    nsteps: int = 20
    discretize: bool = True
    calcentropy: bool = True
    genconvgdata: bool = True
    fname: list[str] = field(default_factory=list)
    shuffleframes: bool = False
    shuffledofs: bool = False
    randseed: int = 0
    optimizedih: bool = True
    pdfmethod: str = "histogram"
    nbins: list[int] = field(default_factory=lambda: [30])
    referencenbins: int = 30
    writefreq: bool = False
    writeset: list[str] = field(default_factory=list)
    writestepstart: int = 255
    writestepstride: int = 1
    nmaxconf: int = 5
    kappa: float = 1.0
    sdosteps: float = 5.0
    sdoiterations: int = 1000
    sdoconvlimit: float = 1e-4
    workset: list[str] = field(default_factory=lambda: ["2D"])
    usesubset: bool = False
    useneighbor: bool = False
    subsetfile: str = ""
    neighborfile: str = ""
    jacobian: bool = True
    scoringmethod: str = "MIE"
    estimator: list[str] = field(default_factory=lambda: ["MM"])
    startframe: int = 0
    strideframe: int = 1
    nframe: int = 0
    inputframes: list[int] = field(default_factory=list)
    nbond: int = 0
    nangle: int = 0
    ndihed: int = 0
    infofile: str = "progress.info"
    reportfileext: str = "csv"
    strict_math: bool = False

    def __post_init__(self) -> None:
        self.scoringmethod = self.scoringmethod.upper()
        self.estimator = [e.upper() for e in self.estimator]
        if self.scoringmethod not in ("MIE", "AMIE", "MIST", "AMIST"):
            raise ValueError(f"scoringmethod {self.scoringmethod}")
        if self.pdfmethod.lower() not in ("histogram", "vonmiseskde"):
            raise ValueError(f"pdfmethod {self.pdfmethod}")
        if not self.estimator or set(self.estimator) - set(ESTIMATORS):
            raise ValueError(f"estimator {self.estimator}")
        for name in (*self.workset, *self.writeset):
            if name.upper() not in WORKSETS:
                raise ValueError(f"workset {name}")
        if min(self.nframe, self.nbond, self.nangle, self.ndihed, *self.inputframes, 0) < 0:
            raise ValueError("a count is negative")
        if self.nsteps < 1 or self.strideframe < 1 or self.startframe < 0 or not all(1 <= n <= 255 for n in self.nbins):
            raise ValueError("nsteps, strideframe, startframe or nbins out of range")

    @property
    def kde(self) -> bool:
        return self.pdfmethod.lower() == "vonmiseskde"

    def parts(self, names: list[str]) -> tuple[list[str], list[str]]:
        """The types and pair types of some worksets. States exist for torsions only."""
        found = {p for n in names for p in WORKSETS[n.upper()]}
        pairs = [p for p in PAIR_TYPES if p in found and (not self.kde or p == "DD")]
        types = {t for t in ("bond", "angle", "torsion") if t in found} | {t for p in pairs for t in PAIR_TYPES[p][1:]}
        return [t for t in ("bond", "angle", "torsion") if t in types and (not self.kde or t == "torsion")], pairs


#: The sections of an INI file and their keys.
SECTIONS = {
    "control": "infilepath outfilepath infofile nsteps discretize calcentropy genconvgdata cachedscrtdimspercpu cacheentcdimspercpu dscrinfofreq entcinfofreq",
    "discretization": "fname nframe nbond nangle ndihed shuffleframes shuffledofs randseed optimizedih pdfmethod",
    "histogram": "nbins referencenbins writefreq writeset writestepstart writestepstride",
    "vonmiseskde": "nmaxconf kappa sdosteps sdoiterations sdoconvlimit writefreq writeset writestepstart writestepstride",
    "entropy": "workset usesubset useneighbor subsetfile neighborfile jacobian scoringmethod estimator startframe strideframe nframe shuffleblocks shuffleblocktimes reportfileext strict_math",
}
#: Keys of one section whose names another one has too.
RENAMED = {("discretization", "nframe"): "inputframes"}


def _value(kind: str, text: str):
    words = text.replace(",", " ").split()
    if kind == "bool":
        return _FLAGS[text.strip().lower()]
    if kind.startswith("list"):
        return [int(w) for w in words] if "int" in kind else words
    return {"int": int, "float": float, "str": str}[kind](text.strip())


def parse(text: str) -> Config:
    """From INI text. A histogram or vonmiseskde section counts if it is that of the method.

    Keys that steer caches, progress counts or shuffled blocks are known but change nothing here; unknown sections and
    keys are refused. discretization.nframe is the frames to take of each input file, entropy.nframe those of all
    frames that entropies look at, counted before start and stride.
    """
    ini = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), strict=False, interpolation=None)
    ini.read_string(text)
    found = {(s.lower(), k.lower()): v for s in ini.sections() for k, v in ini[s].items()}
    strange = [f"{s}.{k}" for s, k in found if k not in SECTIONS.get(s, "").split()]
    if strange or (strange := [s for s in ini.sections() if s.lower() not in SECTIONS]):
        raise ValueError(f"unknown settings: {', '.join(strange)}")
    method = found.get(("discretization", "pdfmethod"), "histogram").strip().lower()
    kinds = {f.name: str(f.type) for f in fields(Config)}
    given = {}
    for section in SECTIONS:
        if section in ("histogram", "vonmiseskde") and section != method:
            continue
        for (s, key), value in found.items():
            name = RENAMED.get((s, key), key)
            if s == section and name in kinds and value.strip():
                given[name] = _value(kinds[name], value)
    return Config(**given)
