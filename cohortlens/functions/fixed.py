"""Fixed values of the domain: enumerations, patterns and defaults that results depend on. Stated as they are."""

# Enumerations
INCLUSION_TIERS = ["exclude", "ftld_strict", "ftld_broad"]
SYNDROMES = ["bvFTD", "svPPA", "nfvPPA", "lvPPA", "PPA_unspecified", "PSP", "CBS", "FTD_MND", "FTLD_unspecified", "not_reported"]
POSITIVE_SYNDROMES = ["svPPA", "nfvPPA", "lvPPA", "PPA_unspecified"]
SECONDARY_ENDPOINTS = ["PSP", "CBS", "FTD_MND", "svPPA", "nfvPPA", "lvPPA"]
INCLUSION_BASES = ["author_reports_ftld_or_ppa_or_psp_or_cbs_or_ftd_mnd", "meets_consensus_criteria_explicitly_stated", "genetic_confirmed_pathogenic", "neuropath_confirmed", "specialist_dx_reported", "unclear_basis"]
NON_FTLD_CATEGORIES = ["vascular_stroke_or_poststroke_aphasia", "primary_psychiatric_or_functional", "brain_tumor_or_mass", "infection_inflammatory_or_autoimmune", "tbi_or_structural", "toxic_metabolic_or_medication", "epilepsy_seizure_related", "other_neurodegenerative_non_ftld", "other_neurologic", "unclear"]
CONFIDENCES = ["high", "medium", "low"]
TAG_STATUSES = ["present", "explicitly_absent", "not_reported", "uncertain"]
SYMPTOM_TAGS = ["apraxia_of_speech", "agrammatism", "semantic_loss", "behavioral_change_disinhibition_or_apathy", "compulsions_or_rigid_routines", "parkinsonism", "oculomotor_vertical_gaze_palsy", "limb_apraxia_or_alien_limb", "mnd_signs", "psychosis_hallucinations"]
SEGMENT_TYPES = ["case_presentation", "disease_course", "clinical_features_summary", "neuropsych_language_testing", "imaging_biomarkers", "pathology_genetics", "treatment_response", "other"]
IMAGING_MODALITIES = ["mri", "ct", "fdg_pet", "spect", "other"]
IMAGING_LATERALITIES = ["left", "right", "bilateral", "diffuse", "unknown"]
IMAGING_REGIONS = ["frontal", "temporal", "parietal", "insula", "cingulate", "basal_ganglia", "brainstem", "cerebellum", "other", "unknown"]
GENETICS_STATUSES = ["confirmed_pathogenic", "reported_uncertain", "tested_negative", "not_reported", "unclear"]
NEUROPATH_STATUSES = ["confirmed", "not_reported", "unclear"]
PATHOLOGY_TYPES = ["tau", "tdp43", "fus", "mixed", "other", "unknown"]
KEY_GENES = ["MAPT", "GRN", "C9ORF72"]
INITIAL_DIAGNOSES = ["ftld", "psychiatric", "ad", "vascular_stroke", "other_neuro", "other", "not_reported", "unknown", "missing"]
MISDIAGNOSES = ["yes", "no", "not_reported", "unknown", "missing"]

# Diagnosis categories that belong to another field, and where they go
DIAGNOSIS_MAPPING = {"other_neurodegenerative_non_ftld": "other_neuro", "other_neurologic": "other_neuro", "vascular_stroke_or_poststroke_aphasia": "vascular_stroke", "primary_psychiatric_or_functional": "psychiatric"}

# Scenarios of the robustness suite: (name, include broad tier, fit components on, clusters, embedding)
SCENARIOS = [
    ("primary_strict_pca_discovery_k4_bge", False, "discovery", 4, "BAAI/bge-small-en-v1.5"),
    ("sens_include_broad_pca_all_k4_bge", True, "all", 4, "BAAI/bge-small-en-v1.5"),
    ("sens_k3_strict_pca_discovery_bge", False, "discovery", 3, "BAAI/bge-small-en-v1.5"),
    ("sens_k5_strict_pca_discovery_bge", False, "discovery", 5, "BAAI/bge-small-en-v1.5"),
    ("sens_k6_strict_pca_discovery_bge", False, "discovery", 6, "BAAI/bge-small-en-v1.5"),
    ("sens_embed_e5_strict_pca_discovery_k4", False, "discovery", 4, "intfloat/e5-small-v2"),
]

# Patterns
EXCLUDE_SECTION = r"\b(methods?|materials?|statistics?|references?|acknowledg(?:e)?ments?|funding|disclosure|conflicts?|ethics)\b"
MUST_SECTION = r"\b(cases?|patients?)\b"
CANDIDATE_SECTION = r"\b(cases?|patients?|clinical|presentations?|history|course|symptoms?|phenotyp(?:e|ic)?|exam(?:ination)?|neurolog(?:y|ical)?)\b"
DIAGNOSIS_TRIGGER = r"\b(frontotemporal|ftd|ftld|primary\s+progressive\s+aphasia|ppa\b|semantic\s+variant|svppa|nonfluent|nfvppa|logopenic|lvppa|progressive\s+supranuclear\s+palsy|psp\b|corticobasal|cbs\b|motor\s+neuron|als\b|ftd[- ]?mnd|diagnos(?:is|ed)|met\s+criteria|fulfill(?:ed|s)\s+criteria|bvftd|grn\b|mapt\b|c9orf72\b|tdp-?43|tauopathy|pick\s+disease)\b"
STRICT_SECTION = r"\b(case\s*(reports?|presentations?|series|stud(?:y|ies))\b|description\s+of\s+the\s+case\b|clinical\s+case\b|proband\b|index\s+case\b|patient(?:s)?\b)"
ANCHORS = [
    ("age_year_old", r"\b(?:a|an)\s+\d{1,3}(?:[-‐‑‒–—− ]+)year(?:[-‐‑‒–—− ]+)old\b"),
    ("case_or_patient_number", r"\b(?:case|patient)\s*(?:#?\s*)?(?:\d+|[ivx]+)\b"),
    ("patient_was_years_old", r"\b(?:the|this)\s+patient\b.{0,80}\b(?:was|is)\b.{0,40}\b\d{1,3}\s+years?\s+old\b"),
    ("proband", r"\bproband\b"),
    ("index_case", r"\bindex\s+case\b"),
    ("patient_presented_or_admitted", r"\b(?:the\s+patient|this\s+patient)\b.{0,80}\b(presented|was admitted|was hospitalized|developed)\b"),
]
CASE_WORDS = ["case", "patient", "presentation", "clinical"]
SELECT_WORDS = ["case", "patient", "presentation", "course"]

# Words for yes and no
TRUE_WORDS = ["1", "true", "t", "yes", "y"]
FALSE_WORDS = ["0", "false", "f", "no", "n", ""]

# Names that a public repository must not hold
FORBIDDEN_EXTENSIONS = [".xlsx", ".xls", ".parquet", ".pq", ".pkl", ".pickle", ".joblib", ".npz", ".pt", ".pth", ".ckpt", ".h5", ".hdf5"]
FORBIDDEN_NAMES = ["adjudication_template.csv", "segments.csv", "case_labels_long.csv", "case_labels_wide.csv", "case_labels.csv"]
PLACEHOLDERS = ["data/README.md", "data/external/.gitkeep", "data/interim/.gitkeep", "data/processed/.gitkeep", "data/raw/.gitkeep", "results/.gitkeep", "results/README.md"]
CASE_WORDS = ["segments", "case_labels", "case-labels"]
RATER_WORDS = ["rater", "ratings", "kappa", "adjudication"]

# Defaults
SEED, PERMUTATIONS, FDR_Q, CLUSTERS, PCA_SHARE, PCA_MOST = 42, 5000, 0.05, 4, 0.95, 50
BOOTSTRAPS, BOOTSTRAP_SHARE, SEEDS = 200, 0.8, 10
