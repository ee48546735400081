"""Codons as numbers: 16a + 4b + c over A, C, G, T; 64 where a base is missing."""

from __future__ import annotations

import numpy as np

BASES = "ACGT"
MISSING = 64
#: standard genetic code over T, C, A, G (fixed values)
_TCAG = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _code() -> str:
    at = ["TCAG".index(b) for b in BASES]
    return "".join(_TCAG[16 * at[i // 16] + 4 * at[i // 4 % 4] + at[i % 4]] for i in range(64))


#: amino acid of each codon, '-' for a missing one
AMINO = _code() + "-"
STOPS = tuple(i for i in range(64) if AMINO[i] == "*")

_ID = np.full(256, 4, np.uint8)
for _k, _b in enumerate(BASES):
    _ID[ord(_b)] = _ID[ord(_b.lower())] = _k
#: what a sequence may hold besides bases; IUPAC letters count as missing
KNOWN = frozenset("ACGTacgt.-Nn" + "RYSWKMBDHVryswkmbdhv")


def base_ids(seq: str) -> np.ndarray:
    """0 to 3, and 4 for anything that is no base."""
    return _ID[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def codon_ids(seq: str) -> np.ndarray:
    """Codons of frame 0; a rest of one or two bases is left out."""
    ids = base_ids(seq)
    ids = ids[: len(ids) // 3 * 3].reshape(-1, 3).astype(np.int64)
    return np.where((ids == 4).any(1), MISSING, ids @ np.array([16, 4, 1]))


def codon(i: int) -> str:
    return BASES[i // 16] + BASES[i // 4 % 4] + BASES[i % 4] if i < MISSING else "NNN"


def peptide(seq: str) -> str:
    return "".join(AMINO[i] for i in codon_ids(seq))
