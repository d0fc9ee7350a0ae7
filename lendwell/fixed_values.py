"""Names, codes, word lists, patterns and message formats.

Everything in this module is data, not logic. The values are part of the
public contract of the results (column names, code tables, texts that appear
in outputs), so they are stated plainly here and nowhere else.
"""

from __future__ import annotations

# --- fixed values: register columns -------------------------------------

TARGET = "LoanApproved"

PREDICTORS = (
    "income",
    "loan_amount",
    "loan_term",
    "loan_purpose",
    "loan_type",
    "lien_status",
    "preapproval",
    "debt_to_income_ratio",
    "combined_loan_to_value_ratio",
    "property_value",
    "occupancy_type",
    "construction_method",
    "total_units",
    "submission_of_application",
    "interest_only_payment",
    "balloon_payment",
)

AUDIT_ONLY = (
    "applicant_age",
    "derived_race",
    "derived_ethnicity",
    "derived_sex",
)

CURATED_COLUMNS = (*PREDICTORS, *AUDIT_ONLY, TARGET)

# Curated name -> register name, where the two differ.
REGISTER_NAME = {"combined_loan_to_value_ratio": "loan_to_value_ratio"}

OPEN_END = "open-end_line_of_credit"

FILTER_COLUMNS = (
    "activity_year",
    "action_taken",
    "reverse_mortgage",
    OPEN_END,
    "business_or_commercial_purpose",
    "total_units",
)

NUMERIC_COLUMNS = (
    "income",
    "loan_amount",
    "loan_term",
    "combined_loan_to_value_ratio",
    "property_value",
)

MISSING_MARKERS = ("", "NA", "N/A", "EXEMPT", "NULL", "NONE")

# Codes that mean "exempt" or "not applicable" in the given columns.
NOT_REPORTED_CODE = {
    "preapproval": "1111",
    "submission_of_application": "1111",
    "interest_only_payment": "1111",
    "balloon_payment": "1111",
    "applicant_age": "8888",
}

POPULATION_YEAR = "2023"
APPROVED_ACTIONS = ("1", "2")
DENIED_ACTION = "3"
ELIGIBLE_UNITS = ("1", "2", "3", "4")
NO_FLAG = "2"

# Columns that would leak the decision or a protected attribute.
LEAKAGE_COLUMNS = (
    "action_taken", "lei", "derived_msa-md", "state_code", "county_code",
    "census_tract", "purchaser_type", "interest_rate", "rate_spread",
    "hoepa_status", "total_loan_costs", "total_points_and_fees",
    "origination_charges", "discount_points", "lender_credits",
    "prepayment_penalty_term", "initially_payable_to_institution",
    "aus-1", "aus-2", "aus-3", "aus-4", "aus-5",
    "denial_reason-1", "denial_reason-2", "denial_reason-3", "denial_reason-4",
    "applicant_credit_score_type", "co-applicant_credit_score_type",
    "applicant_ethnicity-1", "applicant_ethnicity-2", "applicant_ethnicity-3",
    "applicant_ethnicity-4", "applicant_ethnicity-5",
    "co-applicant_ethnicity-1", "co-applicant_ethnicity-2",
    "co-applicant_ethnicity-3", "co-applicant_ethnicity-4",
    "co-applicant_ethnicity-5",
    "applicant_race-1", "applicant_race-2", "applicant_race-3",
    "applicant_race-4", "applicant_race-5",
    "co-applicant_race-1", "co-applicant_race-2", "co-applicant_race-3",
    "co-applicant_race-4", "co-applicant_race-5",
    "applicant_sex", "co-applicant_sex",
    "applicant_ethnicity_observed", "co-applicant_ethnicity_observed",
    "applicant_race_observed", "co-applicant_race_observed",
    "applicant_sex_observed", "co-applicant_sex_observed",
    "co-applicant_age", "applicant_age_above_62", "co-applicant_age_above_62",
    "manufactured_home_secured_property_type",
    "manufactured_home_land_property_interest",
    "tract_population", "tract_minority_population_percent",
    "ffiec_msa_md_median_family_income", "tract_to_msa_income_percentage",
    "tract_owner_occupied_units", "tract_one_to_four_family_homes",
    "tract_median_age_of_housing_units",
)

SAMPLE_SIZE = 50_000
SAMPLE_SEED = 42
HOLDOUT_SHARE = 0.20
CV_FOLDS = 5
CSV_SIZE_LIMIT = 100 * 1024 * 1024

# --- fixed values: engineered features ----------------------------------

FEATURE_NUMERIC = (
    "income",
    "loan_amount",
    "combined_loan_to_value_ratio",
    "property_value",
    "loan_term_years",
    "loan_to_income",
    "property_value_to_income",
    "loan_to_property_value",
    "non_amortizing_feature_count",
)

FEATURE_CATEGORICAL = (
    "loan_purpose",
    "loan_type",
    "lien_status",
    "preapproval",
    "dti_category",
    "occupancy_type",
    "construction_method",
    "total_units",
    "submission_of_application",
    "interest_only_payment",
    "balloon_payment",
)

# Features known only after underwriting has started.
WORKFLOW_FEATURES = (
    "income",
    "combined_loan_to_value_ratio",
    "property_value",
    "loan_to_income",
    "property_value_to_income",
    "loan_to_property_value",
    "dti_category",
)

# Published bands and the upper edges used for published numbers.
DTI_BANDS = {
    "<20%": "lt_20",
    "20%-<30%": "20_to_29",
    "30%-<36%": "30_to_35",
    "50%-60%": "50_to_60",
    ">60%": "gt_60",
}
DTI_EDGES = (
    (20, "lt_20"),
    (30, "20_to_29"),
    (36, "30_to_35"),
    (43, "36_to_42"),
    (50, "43_to_49"),
)
DTI_CLOSED_EDGE = (60, "50_to_60")
DTI_ABOVE = "gt_60"

TRACKED_FEATURES = (
    "total_units",
    "loan_to_property_value",
    "non_amortizing_feature_count",
)

# --- fixed values: first-generation table -------------------------------

V1_INVALIDABLE = ("Income", "LoanAmount")
V1_NUMERIC = ("Age", "CreditScore", "YearsExperience")
V1_CATEGORICAL = ("Gender", "Education", "City", "EmploymentType")
V1_PREDICTORS = (*V1_INVALIDABLE, *V1_NUMERIC, *V1_CATEGORICAL)

# --- fixed values: business names of features and codes -----------------

BUSINESS_NAME = {
    "income": "Annual income (USD thousands)",
    "loan_amount": "Requested loan amount",
    "combined_loan_to_value_ratio": "Combined loan-to-value ratio",
    "property_value": "Property value",
    "loan_term_years": "Loan term (years)",
    "loan_to_income": "Loan-to-income ratio",
    "property_value_to_income": "Property-value-to-income ratio",
    "loan_to_property_value": "Loan-to-property-value ratio",
    "non_amortizing_feature_count": "Non-amortizing feature count",
    "loan_purpose": "Loan purpose",
    "loan_type": "Loan type",
    "lien_status": "Lien status",
    "preapproval": "Preapproval status",
    "dti_category": "Debt-to-income band",
    "occupancy_type": "Occupancy type",
    "construction_method": "Construction method",
    "total_units": "Property units",
    "submission_of_application": "Application submission channel",
    "interest_only_payment": "Interest-only payment flag",
    "balloon_payment": "Balloon payment flag",
}

CODE_LABEL = {
    "loan_purpose": {
        "1": "Home purchase",
        "2": "Home improvement",
        "31": "Refinancing",
        "32": "Cash-out refinancing",
        "4": "Other purpose",
        "5": "Not applicable",
    },
    "loan_type": {"1": "Conventional", "2": "FHA", "3": "VA", "4": "USDA/RHS/FSA"},
    "lien_status": {"1": "First lien", "2": "Subordinate lien"},
    "occupancy_type": {
        "1": "Principal residence",
        "2": "Second residence",
        "3": "Investment property",
    },
    "construction_method": {"1": "Site-built", "2": "Manufactured home"},
}
UNKNOWN_LABEL = "unknown"

# Raw columns behind a derived feature; any other feature is its own source.
FEATURE_SOURCES = {
    "loan_term_years": ("loan_term",),
    "loan_to_income": ("loan_amount", "income"),
    "property_value_to_income": ("property_value", "income"),
    "loan_to_property_value": ("loan_amount", "property_value"),
    "dti_category": ("debt_to_income_ratio",),
    "non_amortizing_feature_count": ("interest_only_payment", "balloon_payment"),
}

NON_CAUSAL_NOTE = (
    "SHAP describe contribuciones del modelo a esta prediccion; no demuestra "
    "causalidad, capacidad de repago ni una politica de credito normativa."
)
APPROVED_LABEL = "approved"
DENIED_LABEL = "denied"
PREDICTION_NOTE = (
    "Historical approval prediction; not a default-risk estimate or autonomous decision."
)

# --- fixed values: policy corpus and retrieval --------------------------

OFFICIAL_HOSTS = ("files.consumerfinance.gov", "selling-guide.fanniemae.com")
CHUNK_CHARS = 1_000
CHUNK_OVERLAP = 150
TOP_K = 5
POINT_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # RFC 4122 URL namespace
POINT_PREFIX = "credit-policy-v2/"
CHUNK_FIELDS = (
    "chunk_id",
    "source_id",
    "source_title",
    "institution",
    "source_url",
    "page_or_section",
    "text",
)

# Feature -> text of the policy search it triggers.
POLICY_QUERY = {
    "debt_to_income_ratio": "mortgage underwriting debt-to-income ratio calculation and limits",
    "dti_category": "mortgage underwriting debt-to-income ratio calculation and limits",
    "combined_loan_to_value_ratio": "mortgage combined loan-to-value CLTV calculation and subordinate financing",
    "loan_to_property_value": "mortgage loan-to-value LTV calculation",
    "income": "mortgage underwriting stable predictable income documentation and continuance",
    "loan_to_income": "mortgage underwriting income and debt obligations",
    "property_value_to_income": "mortgage underwriting property value and income",
    "loan_purpose": "HMDA loan purpose definitions and reporting codes",
    "occupancy_type": "HMDA occupancy type principal residence reporting codes",
    "loan_type": "HMDA loan type conventional FHA VA reporting codes",
    "lien_status": "HMDA lien status first lien subordinate lien reporting codes",
    "construction_method": "HMDA construction method site-built manufactured home reporting codes",
    "loan_amount": "HMDA loan amount reporting requirements",
}
MAX_POLICY_QUERIES = 5

# Groups of words counted by the keyword embedder; one dimension each.
KEYWORD_GROUPS = (("income",), ("debt", "dti"), ("ltv", "loan-to-value"))

# --- fixed values: citations, guardrail and answers ---------------------

CITATION_ID = r"^\[?\s*[Ss](\d+)\s*\]?$"
CITATION_CANONICAL = r"\[S\d+\]"

RESULT_FIELDS = (
    "text",
    "source_id",
    "source_title",
    "institution",
    "source_url",
    "page_or_section",
    "chunk_id",
    "score",
)

MSG_FORBIDDEN = "atributos audit-only/target prohibidos: "
MSG_CONTRACT = "Contrato V2 invalido: "
MSG_MISSING = "faltan columnas: "
MSG_UNEXPECTED = "columnas inesperadas: "
MSG_DUPLICATE = "hay columnas duplicadas"
MSG_NOT_OBJECT = "raw_application debe ser un objeto JSON"
MSG_PRIOR_ERRORS = "El workflow contiene errores previos"
MSG_NO_QUERIES = "No se generaron queries desde factores XAI"
MSG_NO_RESULTS = "Retrieval no devolvio resultados"
MSG_BAD_METADATA = "Metadata incompleta en result "
MSG_BAD_HOST = "Fuente fuera de allowlist: "
MSG_NO_COVERAGE = "No hay evidencia documental para ningun factor XAI relevante"
MSG_DISAGREE = "Prediccion ML y evidence package XAI no coinciden"
MSG_BAD_CITATIONS = "Gemini produjo citations no permitidas: "
MSG_NO_CITATION = "Gemini no cito evidencia recuperada"
MSG_ABSTAIN = "Abstencion controlada: "
MSG_ABSTAIN_MODEL = (
    "La evidencia del modelo no puede sintetizarse de forma grounded en esta ejecucion."
)
MSG_ABSTAIN_POLICY = "Evidencia documental oficial insuficiente o invalida."
MSG_WORKFLOW_ERROR = "Error de workflow: "
GUARD_WARNINGS = (
    "Retrieval scores are ranking signals, not calibrated confidence.",
    "No numeric rejection threshold is configured.",
)
STATUS_ABSTAINED = "abstained_insufficient_evidence"
STATUS_REJECTED = "output_validation_failed"
STATUS_SUCCESS = "success"
FINAL_TEXT_FORMAT = (
    "Prediccion del modelo: %s (probabilidad=%.6f)\n\n"
    "Evidencia del modelo:\n%s\n\n"
    "Contexto normativo:\n%s\n\n"
    "Evaluacion final:\n%s"
)

# Published training runs: name, family, feature configuration, stage, parameters.
PUBLISHED_RUNS = (
    ("rf_baseline_full", "random_forest", "full", "baseline",
     {"n_estimators": 250, "max_depth": None, "min_samples_leaf": 1}),
    ("rf_robust_without_workflow_features", "random_forest", "without_workflow_features", "robustness",
     {"n_estimators": 250, "max_depth": None, "min_samples_leaf": 1}),
    ("rf_tuned_01", "random_forest", "full", "tuning",
     {"n_estimators": 400, "max_depth": 18, "min_samples_leaf": 2, "max_features": 0.7}),
    ("xgb_baseline_full", "xgboost", "full", "baseline",
     {"n_estimators": 250, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.9, "colsample_bytree": 0.9}),
    ("xgb_robust_without_workflow_features", "xgboost", "without_workflow_features", "robustness",
     {"n_estimators": 250, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.9, "colsample_bytree": 0.9}),
    ("xgb_tuned_01", "xgboost", "full", "tuning",
     {"n_estimators": 350, "max_depth": 3, "learning_rate": 0.07, "subsample": 0.8, "colsample_bytree": 0.85}),
    ("xgb_tuned_02", "xgboost", "full", "tuning",
     {"n_estimators": 450, "max_depth": 4, "learning_rate": 0.04, "subsample": 0.9, "colsample_bytree": 0.9}),
    ("catboost_baseline_full", "catboost", "full", "baseline",
     {"iterations": 250, "depth": 6, "learning_rate": 0.05}),
    ("catboost_robust_without_workflow_features", "catboost", "without_workflow_features", "robustness",
     {"iterations": 250, "depth": 6, "learning_rate": 0.05}),
    ("catboost_tuned_01", "catboost", "full", "tuning",
     {"iterations": 350, "depth": 4, "learning_rate": 0.06}),
    ("catboost_tuned_02", "catboost", "full", "tuning",
     {"iterations": 450, "depth": 7, "learning_rate": 0.04}),
)
