"""Word lists, phrases, thresholds and defaults the results depend on."""

# Characters Python's str.strip() and the regex class \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Answers that count as a failed generation once normalised.
INVALID_ANSWERS = ("nan", "none", "")

# Refusals.
REFUSAL_GOLD = "The answer is not found in the document."
REFUSAL_SUBSTRING = "not found in the document"
REFUSAL_EXACT = ("unanswerable", "not answerable", "cannot be answered from the document")
EXPLICIT_REFUSALS = ("cannot be answered", "unanswerable", "no answer in")
SOFT_REFUSALS = (
    "does not mention",
    "does not provide",
    "does not explicitly",
    "does not specifically",
    "does not contain",
    "not in the document",
    "no information",
    "not provide",
)
SOFT_REFUSAL_PREFIX = 160
CONTEXT_DUMP_CHARS = 150
INVENTED_CLASSES = ("invented_answer", "context_dump")
REFUSAL_CLASSES = ("canonical_refusal", "explicit_refusal", "soft_refusal")

# Rubric.
JUDGE_DIMENSIONS = ("grounding", "relevance", "document_necessity", "overall")
EVAL_DIMENSIONS = ("grounding", "relevance", "gold_alignment", "document_necessity", "overall")
TRAIN_RUBRIC_VERSION = "qa_judge_rubric/v2"
EVAL_RUBRIC_VERSION = "qa_judge_rubric/v3_eval_gold"
DEBIAS_RUBRIC_VERSION = "qa_judge_rubric/v3_eval_gold_debias"
TIERS = ("high", "medium", "low", "drop")
MISSING_FIELDS_ERROR = "missing_context_question_or_answer"

# Question forms.
WH_WORDS = ("what", "who", "whom", "whose", "when", "where", "why", "how", "which")
YES_NO_STARTERS = (
    "is", "are", "was", "were", "do", "does", "did", "can", "could", "should",
    "will", "would", "has", "have", "had", "am",
)
YES_NO_HEURISTIC = (
    "do", "does", "did", "is", "are", "was", "were", "can", "could", "will", "would", "has", "have",
)

# Category labels and the default used when a value is not recognised.
CATEGORY_VALUES = {
    "question_type": ("what", "who", "when", "where", "why", "how", "which", "yes_no", "other"),
    "answer_evidence": ("explicit_span", "paraphrase", "multi_span", "light_inference", "heavy_inference"),
    "document_necessity": ("required", "helpful", "not_required"),
    "answer_form": ("entity", "date_or_number", "short_phrase", "sentence"),
    "finetuning_expected_gain": ("low", "medium", "high"),
}
CATEGORY_DEFAULTS = {
    "question_type": "other",
    "answer_evidence": "paraphrase",
    "document_necessity": "required",
    "answer_form": "short_phrase",
    "finetuning_expected_gain": "medium",
}

# Evaluation sizes a timing run must reach to be comparable.
EXPECTED_EVAL_ROWS = {"repliqa": 2000, "quoref": 2418, "squad": 11873}
TIMING_COVERAGE = 0.95

# Adapter weights by tier (high, medium, low).
TIER_WEIGHT_PRESETS = {
    "equal": (1.0, 1.0, 1.0),
    "tier": (0.6, 0.3, 0.1),
    "high_med": (0.67, 0.33, 0.0),
    "low_heavy": (0.4, 0.4, 0.2),
    "inverted": (0.1, 0.3, 0.6),
}

# Arms taken as the baseline of a ceiling comparison when none is named, the first that exists. Fixed values.
AUTO_BASELINES = ("B3_lora_ctx", "B3_lora_all", "B3_lora_no_ctx")
