"""Fixed values of molecular biology, from public sources, and their SQL form."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------------------------------
#: NCBI genetic code 1, bases in the order t c a g; * is a stop.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("taa", "tag", "tga")
START = "atg"
HIS_CODONS = ("cat", "cac")
#: Nearest neighbours, 5' to 3': enthalpy in kcal/mol and entropy in cal/mol K, in tenths.
NEIGHBOURS = {
    "aa": (-76, -213), "at": (-72, -204), "ta": (-72, -213), "ca": (-85, -227), "gt": (-84, -224),
    "ct": (-78, -210), "ga": (-82, -222), "cg": (-106, -272), "gc": (-98, -244), "gg": (-80, -199),
}
#: Kyte and Doolittle 1982, in tenths.
HYDROPATHY = {
    "A": 18, "R": -45, "N": -35, "D": -35, "C": 25, "Q": -35, "E": -35, "G": -4, "H": -32, "I": 45,
    "L": 38, "K": -39, "M": 19, "F": 28, "P": -16, "S": -8, "T": -7, "W": -9, "Y": -13, "V": 42,
}
#: Average masses of free amino acids in ten-thousandths of a dalton.
RESIDUE_MASS = {
    "A": 890932, "R": 1742010, "N": 1321179, "D": 1331027, "C": 1211582, "Q": 1461445, "E": 1471293,
    "G": 750666, "H": 1551546, "I": 1311729, "L": 1311729, "K": 1461876, "M": 1492113, "F": 1651891,
    "P": 1151305, "S": 1050926, "T": 1191192, "W": 2042252, "Y": 1811885, "V": 1171463,
}
WATER = 180150
#: Nucleotide monophosphate masses in hundredths of a dalton; an oligo loses 61.96.
BASE_MASS = {"a": 31321, "c": 28918, "g": 32921, "t": 30420}
OLIGO_LOSS = 6196
GAS_CONSTANT = 1.987
IUPAC = {
    "a": "a", "c": "c", "g": "g", "t": "t", "r": "ag", "y": "ct", "s": "cg", "w": "at", "k": "gt",
    "m": "ac", "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt",
}
#: Name, site, and the 0-based place of the base after which the top strand is cut.
ENZYMES = (
    ("AatII", "gacgtc", 4), ("AluI", "agct", 1), ("BamHI", "ggatcc", 0), ("EcoRI", "gaattc", 0),
    ("EcoRV", "gatatc", 2), ("HaeIII", "ggcc", 1), ("HindIII", "aagctt", 0), ("HinfI", "gantc", 0),
    ("KpnI", "ggtacc", 4), ("MboI", "gatc", -1), ("NcoI", "ccatgg", 0), ("NdeI", "catatg", 1),
    ("NotI", "gcggccgc", 1), ("PstI", "ctgcag", 4), ("SacI", "gagctc", 4), ("SalI", "gtcgac", 0),
    ("SmaI", "cccggg", 2), ("TaqI", "tcga", 0), ("XbaI", "tctaga", 0), ("XhoI", "ctcgag", 0),
)
#: Feature types whose direction is kept when a library entry is found.
DIRECTED = ("CodingRegion", "Ori", "Promoter", "AntibioticResistance")
FRAMES = ("Fwd0", "Fwd1", "Fwd2", "Rev0", "Rev1", "Rev2")
# ----------------------------------------------------------------------------------------------------

COMPLEMENT = str.maketrans("acgt", "tgca")


def reverse_complement(seq: str) -> str:
    return seq.translate(COMPLEMENT)[::-1]


def codon_rows() -> list[tuple[str, str]]:
    return [("".join(c), aa) for c, aa in zip(product("tcag", repeat=3), GENETIC_CODE)]


def neighbour_rows() -> list[tuple[str, int, int]]:
    """All 16 pairs: a pair and its reverse complement have the same values."""
    both = {p: v for pair, v in NEIGHBOURS.items() for p in (pair, reverse_complement(pair))}
    return [(p, *v) for p, v in sorted(both.items())]


def enzyme_rows() -> list[tuple[int, str, str, int, bool]]:
    return [(i, name, site, cut, 2 * (cut + 1) == len(site)) for i, (name, site, cut) in enumerate(ENZYMES)]


def site_rows() -> list[tuple[int, str, str]]:
    """``(enzyme_id, site, strand)`` with every ambiguity spelled out; palindromes once."""
    out = []
    for i, _, site, *_ in enzyme_rows():
        spelled = {"".join(s) for s in product(*(IUPAC[c] for c in site))}
        for s in sorted(spelled):
            out.append((i, s, "fwd"))
            if reverse_complement(s) not in spelled:
                out.append((i, reverse_complement(s), "rev"))
    return out


TABLES = {
    "codons": ("codon string, aa string", codon_rows),
    "neighbours": ("pair string, dh int, ds int", neighbour_rows),
    "hydropathy": ("aa string, value int", lambda: sorted(HYDROPATHY.items())),
    "residue_mass": ("aa string, mass int", lambda: sorted(RESIDUE_MASS.items())),
    "base_mass": ("base string, mass int", lambda: sorted(BASE_MASS.items())),
    "enzymes": ("enzyme_id int, enzyme string, site string, cut_after int, is_blunt boolean", enzyme_rows),
    "enzyme_sites": ("enzyme_id int, spelled string, strand string", site_rows),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows(), schema)


def values_sql(name: str) -> str:
    """The table as a common table expression."""
    schema, rows = TABLES[name]
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    cell = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"{name}({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows()) + ")"
