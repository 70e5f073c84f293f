"""Fixed values and canonical column names.

The tables in this module are domain constants: results are only comparable
between tools when the same masses, notations and physical constants are used.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: physical constants -------------------------------------
CARBON_ISOTOPE_MASS_SHIFT = 1.00335
H2O_MASS = 18.0106
PROTON_MASS = 1.007276

# --- Fixed values: fast cross-correlation (Eng et al., 2008) ---------------
XCORR_BIN_SIZE = 1.0005079
XCORR_BIN_OFFSET = 0.4
XCORR_NUM_WINDOWS = 10
XCORR_MAX_OFFSET = 75
XCORR_WINDOW_NORM_VALUE = 50.0

# --- Fixed values: residue token -> monoisotopic mass ----------------------
RESIDUE_MASSES: dict[str, float] = {
    "G": 57.021464,
    "A": 71.037114,
    "S": 87.032028,
    "P": 97.052764,
    "V": 99.068414,
    "T": 101.047670,
    "C": 103.009185,
    "L": 113.084064,
    "I": 113.084064,
    "N": 114.042927,
    "D": 115.026943,
    "Q": 128.058578,
    "K": 128.094963,
    "E": 129.042593,
    "M": 131.040485,
    "H": 137.058912,
    "F": 147.068414,
    "R": 156.101111,
    "Y": 163.063329,
    "W": 186.079313,
    "U": 150.953633,
    "O": 237.147727,
    "K[UNIMOD:1]": 170.105528,
    "K[UNIMOD:3]": 354.172561,
    "C[UNIMOD:4]": 160.030649,
    "Q[UNIMOD:7]": 129.042594,
    "R[UNIMOD:7]": 157.085127,
    "N[UNIMOD:7]": 115.026943,
    "S[UNIMOD:21]": 166.998028,
    "T[UNIMOD:21]": 181.01367,
    "Y[UNIMOD:21]": 243.029329,
    "E[UNIMOD:27]": 111.032028,
    "Q[UNIMOD:28]": 111.032029,
    "K[UNIMOD:34]": 142.110613,
    "R[UNIMOD:34]": 170.116761,
    "M[UNIMOD:35]": 147.035400,
    "P[UNIMOD:35]": 113.047679,
    "K[UNIMOD:36]": 156.126263,
    "R[UNIMOD:36]": 184.132411,
    "K[UNIMOD:37]": 170.141913,
    "K[UNIMOD:58]": 184.121178,
    "K[UNIMOD:64]": 228.111007,
    "K[UNIMOD:121]": 242.137890,
    "K[UNIMOD:122]": 156.089878,
    "R[UNIMOD:188]": 162.121240,
    "K[UNIMOD:214]": 272.197026,
    "K[UNIMOD:259]": 136.109162,
    "R[UNIMOD:267]": 166.109380,
    "Y[UNIMOD:275]": 192.053493,
    "C[UNIMOD:312]": 222.013284,
    "K[UNIMOD:481]": 132.120070,
    "K[UNIMOD:737]": 357.257895,
    "S[UNIMOD:737]": 316.194960,
    "K[UNIMOD:747]": 214.095357,
    "K[UNIMOD:1289]": 198.136828,
    "K[UNIMOD:1363]": 196.121178,
    "K[UNIMOD:1848]": 242.126657,
    "K[UNIMOD:1849]": 214.131742,
    "K[UNIMOD:2016]": 432.302109,
    "[UNIMOD:1]": 42.010565,
    "[UNIMOD:5]": 43.005814,
    "[UNIMOD:214]": 144.102063,
    "[UNIMOD:385]": -17.026549,
    "[UNIMOD:737]": 229.162932,
    "[UNIMOD:2016]": 304.207146,
    "(+25.98)": 25.980265,
}

# --- Fixed values: engine notation -> UNIMOD token -------------------------
# Beam-search CSV notation.
BEAM_CSV_REMAPPING: dict[str, str] = {
    "M(ox)": "M[UNIMOD:35]",
    "M(+15.99)": "M[UNIMOD:35]",
    "S(p)": "S[UNIMOD:21]",
    "T(p)": "T[UNIMOD:21]",
    "Y(p)": "Y[UNIMOD:21]",
    "S(+79.97)": "S[UNIMOD:21]",
    "T(+79.97)": "T[UNIMOD:21]",
    "Y(+79.97)": "Y[UNIMOD:21]",
    "Q(+0.98)": "Q[UNIMOD:7]",
    "N(+0.98)": "N[UNIMOD:7]",
    "Q(+.98)": "Q[UNIMOD:7]",
    "N(+.98)": "N[UNIMOD:7]",
    "C(+57.02)": "C[UNIMOD:4]",
    "(+42.01)": "[UNIMOD:1]",
    "(+43.01)": "[UNIMOD:5]",
    "(-17.03)": "[UNIMOD:385]",
}
# mzTab notation.
MZTAB_REMAPPING: dict[str, str] = {
    "M+15.995": "M[UNIMOD:35]",
    "Q+0.984": "Q[UNIMOD:7]",
    "N+0.984": "N[UNIMOD:7]",
    "C+57.021": "C[UNIMOD:4]",
    "C[Carbamidomethyl]": "C[UNIMOD:4]",
    "M[Oxidation]": "M[UNIMOD:35]",
    "N[Deamidated]": "N[UNIMOD:7]",
    "Q[Deamidated]": "Q[UNIMOD:7]",
    "[Acetyl]": "[UNIMOD:1]",
    "[Carbamyl]": "[UNIMOD:5]",
    "[Ammonia-loss]": "[UNIMOD:385]",
    "+42.011": "[UNIMOD:1]",
    "+43.006": "[UNIMOD:5]",
    "-17.027": "[UNIMOD:385]",
}
# Title-keyed TSV notation.
TITLE_TSV_REMAPPING: dict[str, str] = {
    "M[+15.995]": "M[UNIMOD:35]",
    "C[+57.021]": "C[UNIMOD:4]",
    "N[+0.984]": "N[UNIMOD:7]",
    "Q[+0.984]": "Q[UNIMOD:7]",
    "[+42.011]": "[UNIMOD:1]",
    "[+43.006]": "[UNIMOD:5]",
    "[-17.027]": "[UNIMOD:385]",
    "[+43.006-17.027]": "(+25.98)",
    "C[Carbamidomethyl]": "C[UNIMOD:4]",
    "M[Oxidation]": "M[UNIMOD:35]",
    "N[Deamidated]": "N[UNIMOD:7]",
    "Q[Deamidated]": "Q[UNIMOD:7]",
    "[Acetyl]": "[UNIMOD:1]",
    "[Carbamyl]": "[UNIMOD:5]",
}
# Modifications that may only stand at the N-terminus of a title-keyed TSV row.
TITLE_TSV_NTERM_MODS: tuple[str, ...] = (
    "[+43.006-17.027]",
    "[+42.011]",
    "[+43.006]",
    "[-17.027]",
)
# search_engine markers of an mzTab file that carries beam candidates and
# penalised scores.
BEAM_ENGINE_MARKERS: tuple[str, ...] = ("MS:1003281", "Casanovo")

# Fixed value: the least probability a logarithm is taken of.
PROBABILITY_FLOOR = 1e-10

# --- Token grammar ----------------------------------------------------------
# A token is a bracketed modification, a residue with an optional modification,
# or a bare signed mass delta. Hyphens between terminal parts match nothing.
TOKEN_PATTERN = (
    r"(\[[^\]]+\]|\([^)]+\)"
    r"|[A-Z](?:\[[^\]]+\]|\([^)]+\)|[+-]?\d*\.\d+)?"
    r"|[+-]\d*\.\d+)"
)

# --- Canonical schema -------------------------------------------------------
BEAM_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("sequence", T.ArrayType(T.StringType())),
            T.StructField("log_prob", T.DoubleType()),
            T.StructField("token_log_probs", T.ArrayType(T.DoubleType())),
        ]
    )
)

PREDICTED_ION_SCHEMA = T.StructType(
    [
        T.StructField("spectrum_id", T.StringType()),
        T.StructField("peptide_sequences", T.StringType()),
        T.StructField("precursor_charges", T.IntegerType()),
        T.StructField("collision_energies", T.IntegerType()),
        T.StructField("intensities", T.DoubleType()),
        T.StructField("mz", T.DoubleType()),
        T.StructField("annotation", T.StringType()),
    ]
)
