"""The shipped configuration for myeloid cohorts. Operators take these as arguments; none of them is built in.

Fixed values: names, ranges, thresholds, gene sets and patterns below have to equal those of the method that is reproduced.
"""

from __future__ import annotations

MEASURES = ["BM_BLAST", "WBC", "ANC", "MONOCYTES", "HB", "PLT"]

RANGES = {"BM_BLAST": (0, 100), "WBC": (0, 400), "ANC": (0, 100), "MONOCYTES": (0, 100), "PLT": (0, 3000), "HB": (2, 25)}

RATIOS = {
    "neutrophil_ratio": ("ANC", "WBC"),
    "monocyte_ratio": ("MONOCYTES", "WBC"),
    "platelet_wbc_ratio": ("PLT", "WBC"),
    "blast_platelet_ratio": ("BM_BLAST", "PLT"),
}

THRESHOLDS = {
    "anemia_moderate": ("HB", "<", 10),
    "anemia_severe": ("HB", "<", 8),
    "thrombocytopenia_moderate": ("PLT", "<", 100),
    "thrombocytopenia_severe": ("PLT", "<", 50),
    "neutropenia_moderate": ("ANC", "<", 1.5),
    "neutropenia_severe": ("ANC", "<", 1.0),
    "leukocytosis_high": ("WBC", ">", 30),
    "high_blast_count": ("BM_BLAST", ">", 20),
}

SCORES = {
    "cytopenia_score": ["anemia_moderate", "thrombocytopenia_moderate", "neutropenia_moderate"],
    "proliferation_score": ["high_blast_count", "leukocytosis_high"],
}
SCORE_FLAGS = {"pancytopenia": ("cytopenia_score", 3)}
LOGS = ["WBC", "PLT", "ANC", "MONOCYTES"]

RARE_CENTER, OTHER_CENTER = 40, "CENTER_OTHER"

FAVORABLE_GENES = ["NPM1", "CEBPA"]
ADVERSE_GENES = ["TP53", "ASXL1", "RUNX1", "BCOR", "EZH2", "SF3B1", "SRSF2", "STAG2", "U2AF1", "ZRSR2"]
INTERMEDIATE_GENES = ["FLT3", "DNMT3A", "TET2", "IDH1", "IDH2", "KIT"]
RAS_GENES = ["NRAS", "KRAS", "PTPN11"]
FIRST_TIER_GENES = ["CBL", "DDX41", "CUX1", "NF1", "PHF6", "SETBP1", "JAK2", "MLL", "WT1", "ETV6", "PPM1D"]
SECOND_TIER_GENES = ["GATA2", "KMT2C", "BCORL1", "MPL", "SH2B3", "CSNK1A1"]
FURTHER_GENES = [
    "ETNK1", "BRCC3", "CTCF", "EP300", "ZBTB33", "GNB1", "ASXL2", "ARID2", "PRPF8", "GNAS",
    "U2AF2", "KMT2D", "CREBBP", "NFE2", "CSF3R", "RAD21", "SMC1A", "SMC3", "KDM6A", "SUZ12", "EED", "STAT3",
]
GENES = sorted({*FAVORABLE_GENES, *ADVERSE_GENES, *INTERMEDIATE_GENES, *RAS_GENES, *FIRST_TIER_GENES, *SECOND_TIER_GENES, *FURTHER_GENES})

PATHWAYS = {
    "DNA_methylation": ["DNMT3A", "TET2", "IDH1", "IDH2"],
    "RNA_splicing": ["SF3B1", "SRSF2", "U2AF1", "ZRSR2"],
    "Chromatin_modification": ["ASXL1", "EZH2", "BCOR", "KDM6A", "SUZ12", "EED"],
    "Transcription_factors": ["NPM1", "CEBPA", "RUNX1"],
    "Tumor_suppressor": ["TP53"],
    "Tyrosine_kinase": ["FLT3", "KIT"],
    "RAS_signaling": ["NRAS", "KRAS", "PTPN11"],
    "Cohesin_complex": ["STAG2", "RAD21", "SMC1A", "SMC3"],
    "JAK_STAT": ["STAT3"],
}

VAF_THRESHOLDS = {"TP53": 0.55, "FLT3": 0.25, "NPM1": 0.5, "CEBPA": 0.5, "DNMT3A": 0.5, "IDH1": 0.5, "IDH2": 0.5}

MUTATION_TYPES = {
    "TP53_truncating": {"gene": "TP53", "column": "EFFECT", "pattern": "nonsense|frameshift|splice_site|stop_gained"},
    "CEBPA_biallelic": {"gene": "CEBPA", "least": 2},
    "FLT3_ITD": {"gene": "FLT3", "column": "EFFECT", "pattern": "ITD|internal tandem duplication"},
    "FLT3_TKD": {"gene": "FLT3", "column": "PROTEIN_CHANGE", "pattern": "D835|I836"},
}

COMUTATIONS = {
    "NPM1_pos_FLT3_neg": {"genes": ["NPM1", "FLT3"], "status": [1, 0]},
    "double_hit_spliceosome": {"pathway": "RNA_splicing", "least": 2},
    "triple_hit_epigenetic": {"pathway": "DNA_methylation", "least": 3},
    "vaf_ratio_FLT3_NPM1": {"numerator": "FLT3", "denominator": "NPM1"},
}

INTERACTIONS = {
    "cyto_normal_mol_favorable": {"base": "normal_karyotype", "any_of": ["mut_NPM1", "CEBPA_biallelic"], "none_of": ["FLT3_ITD"]},
    "cyto_normal_mol_adverse": {"base": "normal_karyotype", "any_of": ["FLT3_ITD"]},
    "cyto_favorable_mol_adverse_kit": {"base": "any_favorable_cyto", "any_of": ["mut_KIT"]},
    "cyto_complex_and_mol_tp53": {"base": "complex_karyotype", "any_of": ["mut_TP53"]},
}

# two more rules, left out unless they are asked for
EXTRA_INTERACTIONS = {
    "lucky_high_burden_survivor": {"base": "mut_RUNX1", "any_of": ["mut_ASXL1", "mut_STAG2"]},
    "unlucky_low_burden_aggressive": {"base": "high_blast_count", "all_of": ["thrombocytopenia_severe"]},
}

CORE_FEATURES = [
    "SEX_XY", "SEX_UNKNOWN",
    "BM_BLAST", "WBC", "ANC", "MONOCYTES", "HB", "PLT",
    "clinical_all_missing",
    "cyto_is_missing", "complex_karyotype",
    "eln_cyto_favorable", "eln_cyto_intermediate", "eln_cyto_adverse",
    "mut_TP53", "mut_NPM1", "mut_FLT3", "mut_ASXL1", "mut_RUNX1",
    "mut_DNMT3A", "mut_IDH1", "mut_IDH2", "mut_TET2",
    "mut_SF3B1", "mut_SRSF2", "mut_U2AF1", "mut_ZRSR2",
    "mut_STAG2", "mut_EZH2",
    "total_mutations", "num_oncogene_muts", "num_tsg_muts",
    "impact_HIGH", "impact_MODERATE",
    "vaf_max", "high_vaf_ratio", "TP53_high_VAF", "FLT3_ITD",
    "eln_mol_favorable", "eln_mol_intermediate", "eln_mol_adverse",
    "cyto_normal_mol_adverse", "cyto_complex_and_mol_tp53", "NPM1_pos_FLT3_neg",
    "lucky_high_burden_survivor", "unlucky_low_burden_aggressive",
]
EXPLORATORY_FEATURES = [
    *CORE_FEATURES,
    "neutrophil_ratio", "monocyte_ratio", "platelet_wbc_ratio", "blast_platelet_ratio",
    "anemia_severe", "thrombocytopenia_severe", "neutropenia_severe", "leukocytosis_high",
    "monosomal_karyotype", "num_cyto_abnormalities",
    "structural_count", "numerical_count",
    "has_derivative_chromosome", "has_marker_chromosome",
    "mut_BCOR", "mut_BCORL1", "mut_CBL", "mut_CEBPA", "mut_CREBBP",
    "mut_CUX1", "mut_DDX41", "mut_GATA2", "mut_KIT",
    "mut_KRAS", "mut_NF1", "mut_NRAS", "mut_SETBP1",
    "DNA_methylation_count", "RNA_splicing_count", "Chromatin_modification_count",
    "Transcription_factors_count", "Tumor_suppressor_count", "Tyrosine_kinase_count",
    "RAS_signaling_count", "Cohesin_complex_count",
    "vaf_mean", "vaf_std", "high_vaf_mutations",
    "double_hit_spliceosome", "triple_hit_epigenetic",
]
#: By name; the default takes all columns.
FEATURE_SETS = {"default": None, "core": CORE_FEATURES, "exploratory": EXPLORATORY_FEATURES}

CLINVAR_CATEGORIES = {"pathogenic": "Pathogenic", "likely_pathogenic": "Likely_pathogenic", "benign": "Benign", "uncertain": "Uncertain", "conflicting": "Conflicting"}
CADD_HIGH = 20.0
ARMS = {"5q": "del_5q_or_mono5", "7q": "monosomy_7_or_del7q", "17p": "del_17p_or_i17q"}

# karyotype text: fixed values
SPECIFIC_ABNORMALITIES = {
    "trisomy_8": r"\+\s*8(?![0-9])|\btris(omy|omia)?\s*8(?![0-9])",
    "t_9_11": r"t\s*\(\s*9\s*;\s*11\s*\)",
    "minus_Y": r"\bminus_y\b|-\s*y(?![a-zA-Z0-9])|\bdely\b",
    "plus_21": r"\+\s*21(?![0-9])|\btris(omy|omia)?\s*21(?![0-9])",
    "del_5q_or_mono5": r"-\s*5(?![0-9])|\b(mono|del)\w*\s*5|\bdel\s*\(\s*5\s*\)\s*\(q",
    "monosomy_7_or_del7q": r"-\s*7(?![0-9])|\b(mono|del)\w*\s*7|\bdel\s*\(\s*7\s*\)\s*\(q",
    "del_17p_or_i17q": r"del\s*\(\s*17\s*\)\s*\(p|i\s*\(\s*17\s*\)\s*\(q|17p-",
    "rearr_3q26": r"inv\(3\).*q26|t\(3;.*\).*q26|t\(.*;3\).*q26",
    "del_12p": r"del\s*\(\s*12\s*\)\s*\(p",
    "monosomy_X": r"-\s*x(?![a-z0-9])|\bmono(?:somy)?\s*x",
    "trisomy_X": r"\+\s*x(?![a-z0-9])|\btris(?:omy|omia)?\s*x",
    "trisomy_Y": r"\+\s*y(?![a-z0-9])|\btris(?:omy|omia)?\s*y",
}

EVENTS = {
    "n_t": r"t\(",
    "n_del": r"del\(|del,|\bdel\b",
    "n_inv": r"inv\(",
    "n_add": r"add\(|\badd\b",
    "n_der": r"der\(",
    "n_ins": r"ins\(",
    "n_i": r"i\(",
    "n_dic": r"dic\(",
    "n_ring": r"(?:r\(|\+r[a-z0-9]*(?:\[[^\]]+\])?)",
    "n_mar": r"[+-]\s*m(?:ar)?[a-z0-9]*(?:\[[^\]]+\])?",
    "n_dmin": r"dmin",
    "n_plus": r"\+",
    "n_minus": r"-",
    "chromosome_range_flag": r"\b\d{2}\s*[-~]\s*\d{2}\b",
}

NORMALIZATION = [
    (r"order\s*(?=\()", "der"),
    (r"ordel\s*(?=\()", "del"),
    (r"\b9ph\b", "t(9;22)"),
    (r"\bph\s*\+\b", "t(9;22)"),
    (r"([+-]\s*[xy])\s*\[[0-9]+\]", "$1"),
    (r"([+-]\s*m(?:ar)?[a-z0-9]*)\s*\[[0-9]+\]", "$1"),
    (r"([+-]\s*r[a-z0-9]*)\s*\[[0-9]+\]", "$1"),
]
FREE_TEXT_COMPLEX = r">=3|>3|complex|multiple abnormalities"
FAVORABLE_CYTO = r"t\s*\(\s*8\s*;\s*21\s*\)|inv\s*\(\s*16\s*\)|t\s*\(\s*16\s*;\s*16\s*\)"
STRUCTURAL = ["n_t", "n_del", "n_inv", "n_add", "n_der", "n_ins", "n_i", "n_dic", "n_ring"]
COMPLEX_FROM = 3

PRIORITY_RULES = [("mut_", "_altered"), ("mut_", "_count"), ("log_", ""), ("mean", "median")]
CORRELATION_LIMIT, RARE_SHARE, TAU = 0.96, 0.005, 7.0
