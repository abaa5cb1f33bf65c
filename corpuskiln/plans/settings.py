"""Our own small lexicons and parameters for the catalogue's queries; callers of the operators pass theirs."""

LANES = ("de", "en", "es", "fr")
LEXICON = {
    "en": ("and", "for", "of", "that", "the", "this", "to", "with"),
    "de": ("das", "der", "die", "ein", "eine", "nicht", "und", "von"),
    "es": ("como", "con", "del", "el", "la", "los", "que", "una"),
    "fr": ("avec", "dans", "des", "est", "la", "le", "que", "une"),
}
TERMS = ("array", "code", "function", "list", "loop")
SUBSTITUTES = {"and": "plus", "of the": "from the", "the": "that"}
PHRASES = (("of the", "belonging to the"), ("and the", "plus the"), ("in", "inside"))
STOP = ("and", "das", "der", "des", "die", "for", "los", "que", "the", "und")
ALIASES = {"that": "this", "tion": "ation"}
ANCHORS = ((("for", "with"), ("of", "from")), (("der",), ("die",)), (("le",), ("la",)))
NEGATIONS = ("kein", "nicht", "no", "not", "pas", "sin")
RATIOS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
SEED = 2026
