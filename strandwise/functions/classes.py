"""Class vocabularies and parameters by class."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class tokens by category.
CATEGORIES = {
    "LTR": ["RLG", "RLC", "RLB", "RLR", "RLE", "LTR", "RLX", "Gypsy", "Copia", "BEL"],
    "LINE": ["LINE", "RIL", "RIT", "RIX", "Penelope"],
    "SINE": ["SINE", "RST", "RSX", "Non-LTR"],
    "DNA-TIR": [
        "DNA", "TIR", "hAT", "hAT-Ac", "MULE", "MLE", "MuDR", "Tourist", "CACTA", "PILE", "POLE", "Stowaway", "TcMar-Stowaway", "PIF", "Harbinger", "Tc1",
        "En-Spm", "EnSpm", "CMC-EnSpm", "PiggyBac", "Mirage", "P-element", "Transib", "DTA", "DTH", "DTT", "DTM", "DTC", "DTX", "DTR", "DTE", "Merlin", "DTP",
        "DTB", "polinton", "Academ", "Crypton",
    ],
    "MITE": ["MITE"],
    "Helitron": ["Helitron", "DHH", "DHX", "helitron"],
    "Simple-repeat": ["Low_complexity", "repeat_region", "Simple_repeat", "Low", "Satellite"],
}

#: The shorter vocabulary: retroposons together, MITE with the terminal inverted repeats.
FEWER_CATEGORIES = {
    "LTR": CATEGORIES["LTR"],
    "Non-LTR": CATEGORIES["LINE"] + CATEGORIES["SINE"] + ["nonLTR", "YR", "Retroposon"],
    "DNA-TIR": CATEGORIES["DNA-TIR"] + CATEGORIES["MITE"],
    "Helitron": CATEGORIES["Helitron"],
    "Simple-repeat": CATEGORIES["Simple-repeat"],
}


def category(te_class: Column, fewer: bool = False) -> Column:
    """The category of the last token of a class, split at slashes, that the vocabulary knows; Unknown without."""
    words = {w: k for k, tokens in (FEWER_CATEGORIES if fewer else CATEGORIES).items() for w in tokens}
    known = F.create_map(*(F.lit(x) for kv in sorted(words.items()) for x in kv))
    found = F.filter(F.transform(F.reverse(F.split(te_class, "/")), lambda w: F.try_element_at(known, w)), lambda c: c.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit("Unknown"))


@dataclass(frozen=True)
class Parameters:
    """A preset; a user's own values win over it, and a preset's ``min_seq_num`` has a floor of 10."""

    cons_thr: float
    ext_thr: float
    ext_step: int
    max_ext: int
    gap_nul_thr: float
    max_msa_lines: int = 100
    top_msa_lines: int = 100
    min_seq_num: int = 10
    min_blast_len: int = 150
    gap_thr: float = 0.4
    crop_end_div_thr: float = 0.7
    crop_end_div_win: int = 40
    crop_end_gap_thr: float = 0.1
    crop_end_gap_win: int = 250
    poly_len: int = 10
    mini_orf: int = 200
    ext_check_win: int = 150

    def with_user(self, **own) -> Parameters:
        given = {k: v for k, v in own.items() if v is not None}
        return replace(self, **{"min_seq_num": max(10, self.min_seq_num)} | given)


# The two presets.
PRESETS = {
    "conserved": Parameters(cons_thr=0.7, ext_thr=0.65, ext_step=1000, max_ext=7000, gap_nul_thr=0.7),
    "divergent": Parameters(cons_thr=0.65, ext_thr=0.6, ext_step=1500, max_ext=8000, gap_nul_thr=0.65),
}

# What classes change; later rules win over earlier ones.
CLASS_RULES = (
    ("DNA", "prefix", {"ext_step": 500, "max_ext": 7000, "crop_end_gap_win": 100, "ext_check_win": 50, "buffer": 200}),
    ("MITE", "inside", {"ext_step": 150, "max_ext": 1000, "min_blast_len": 50, "crop_end_gap_win": 40, "ext_check_win": 50, "buffer": 80}),
    ("SINE", "prefix", {"ext_step": 200, "max_ext": 1400, "min_blast_len": 50, "ext_check_win": 50, "buffer": 100}),
)


def class_parameters(te_class: Column, preset: Parameters = PRESETS["conserved"]) -> Column:
    """struct(ext_step, max_ext, min_blast_len, crop_end_gap_win, ext_check_win, buffer) by class."""
    fields = []
    for name in ("ext_step", "max_ext", "min_blast_len", "crop_end_gap_win", "ext_check_win", "buffer"):
        value = F.lit(400 if name == "buffer" else getattr(preset, name))
        for token, how, rule in CLASS_RULES:
            fits = te_class.startswith(token) if how == "prefix" else te_class.contains(token)
            if name in rule:
                value = F.when(fits, rule[name]).otherwise(value)
        fields.append(value.alias(name))
    return F.struct(*fields)


def extension_threshold(te_class: Column, threshold: float) -> Column:
    """Lines are allowed a lower threshold."""
    return F.when(te_class.startswith("LINE"), threshold - 0.1).otherwise(threshold)
