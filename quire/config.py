"""Fixed values and tunables of the consolidation engine."""

CANDIDATE_THRESHOLD = 0.43
CONTEXT_LIMIT = 1_000_000
API_CONTEXT_LIMIT = 1_050_000
SAFETY_RATIO = 0.6
MAX_BYTES = 5_000_000
MAX_TRANSACTIONS = 50
MAX_MODEL_FAMILIES = 20

# The words below must be exactly these for results to agree.
STOPWORDS = (
    "a an and are as at be by for from has have in into is it its of on or that the their this to was were will with"
).split()
CONCEPT_GROUPS = [
    "repeat repetition redundancy duplicate restatement recur",
    "preserve retain conserve keep maintain",
    "evidence proof record support data",
    "risk danger hazard threat",
    "remove delete eliminate subtract cut",
    "centre center home location section",
    "recommend propose advise should",
    "verify validate check confirm",
]
ROLE_MARKERS = [
    ("cross_reference", ["see ", "refer to", "as set out in", "as explained in"]),
    ("qualification", ["provided that", "subject to", "only if", "unless"]),
    ("limitation", ["however", "limited to", "does not", "cannot"]),
    ("exception", ["except", "other than", "save for"]),
    ("evidence", ["evidence", "recorded", "measurement", "data show", "observed"]),
    ("recommendation", ["recommend", "should", "must implement", "propose"]),
    ("consequence", ["therefore", "consequently", "as a result"]),
    ("definition", ["means", "is defined as", "refers to"]),
    ("reason", ["because", "since", "owing to"]),
]
TITLE_RULES = [
    ("summary", ["summary", "overview", "abstract"]),
    ("analytical", ["analysis", "discussion", "assessment"]),
    ("recommendatory", ["recommendation", "remedy", "proposal"]),
    ("conclusive", ["conclusion", "closing"]),
    ("structural", ["method", "procedure", "protocol"]),
]
EVIDENCE_TITLES = ["evidence", "record", "finding"]
CENTRE_FIT = {
    "analytical": 1.00,
    "definitory": 0.95,
    "recommendatory": 0.90,
    "context": 0.65,
    "conclusive": 0.45,
    "summary": 0.35,
    "evidentiary": 0.30,
    "structural": 0.20,
    "transitional": 0.20,
    "unknown": 0.10,
}
PROTECTED = ("structural", "evidentiary")
RATIONALES = {
    "protected": "Protected structural or evidentiary function remains local.",
    "weak": "Semantic equivalence is not strong enough for automatic consolidation.",
    "centre": "Occurrence is located at the selected logical gravity centre.",
    "echo": "Necessary functional echo is retained outside the canonical treatment.",
    "partial": "Partial overlap contains potential unique residual payload; removal is forbidden.",
    "merge": "Probable redundant payload may be merged, subject to donor and coverage verification.",
}
