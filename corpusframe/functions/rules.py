"""Patterns and small tables whose content decides the results.

They are defaults. Every operator takes them as an argument, so another corpus brings its own.
``WORD`` is the class of word characters: letters, numbers and the underscore of any script.
"""

WORD = r"\p{L}\p{N}_"
EDGE_L = rf"(?<![{WORD}])"
EDGE_R = rf"(?![{WORD}])"


def uni(pattern: str) -> str:
    r"""Unicode reading of a pattern: ``\d``, ``\s``, ``\b`` of any script; only ``\n`` ends a line."""
    return "(?Ud)" + pattern.replace(r"\w", WORD if r"[\w" in pattern else f"[{WORD}]")


# OCR correction rules in the order they apply (name, pattern, replacement).
OCR_RULES = [
    ("l_to_1", EDGE_L + r"l(?=aw|etter|egal|ength|ink)", "1"),
    ("initial_l", r"(?U)(^|\s|\()l(?=[A-Z])", "$1L"),
    ("o_to_0", r"(\p{Nd})O(?=\p{Nd})", "$10"),
    ("zero_to_o", EDGE_L + r"0(?=ver|ther|wn)", "O"),
    ("rn_to_m", r"(?U)rn(?=\s|[aeiou])", "m"),
    ("bar_to_i", r"([a-z])\|([a-z])", "$1i$2"),
    ("one_to_l", r"([a-z])1([a-z])", "$1l$2"),
    ("spaces", r"(?U)\s{2,}", " "),
    ("dashes", "[‐-―]{2,}", "—"),
    ("underscores", r"_{2,}", "—"),
    ("illegal", r"[^" + WORD + r"\s\-:;.,()\[\]\"'" + "—–]", ""),
]
#: The rules without the two that damage correct English words.
SAFE_OCR_RULES = [r for r in OCR_RULES if r[0] not in ("l_to_1", "rn_to_m")]

# Page clean-up in the order it applies.
PAGE_RULES = [
    ("hyphen", rf"([{WORD}]+)-\s*\n\s*([{WORD}]+)", "$1$2"),
    ("space_before", r"\s+([.,;:!?)])", "$1"),
    ("space_after", r"([({])\s+", "$1"),
    ("blanks", r"[ \t]+", " "),
    ("newlines", r"\n{3,}", "\n\n"),
    ("bars", r"[|]{2,}", ""),
    ("rules", r"[_]{3,}", ""),
    ("unclear", rf"[^{WORD}\s" + "ऀ-ॿ" + r".,;:!?()\[\]{}\-'\"/]+", "[UNCLEAR]"),
]

# Character confusions, any case; the lone I depends on digits in the text.
CONFUSIONS_BEFORE = [
    ("l", rf"(?iu){EDGE_L}l{EDGE_R}", "l"),
    ("O", rf"(?iu){EDGE_L}O{EDGE_R}", "0"),
]
LONE_I = rf"(?iu){EDGE_L}I{EDGE_R}"
CONFUSIONS_AFTER = [
    ("rn", r"(?iu)rn", "m"),
    ("ii", r"(?iu)ii", "u"),
    ("1s", r"(?iu)1s", "is"),
]

IMPLAUSIBLE = r"[^\p{L}\p{N} .,;:\-'\"()\[\]{}]"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"

# Reference spellings, any case.
REFERENCE_RULES = [
    ("act", rf"(?iU){EDGE_L}Act[\s,]", "Act,"),
    ("sec", rf"(?iU){EDGE_L}Sec\.?\s*(\p{{Nd}}+)", "Section $1"),
    ("subsec", rf"(?iU){EDGE_L}Sub[\-\s]+sec\.?\s*\((\p{{Nd}}+[a-z]?)\)", "Sub-section ($1)"),
    ("clause", rf"(?iU){EDGE_L}Clause\s*\(([a-z])\)", "Clause ($1)"),
]

# Preferred spelling of terms.
TERM_MAP = [
    ("biological resources", "biological resource"),
    ("biodiversity", "biodiversity"),
    ("traditional knowledge", "traditional knowledge"),
]

# Native terms put into English before translation, by language.
GLOSSARY = {
    "kn": {
        "ಪೆಟೆಂಟ್": "patent", "ಪೆಟೆಂಟ್‌ಗಳು": "patents", "ಪೆಟೆಂಟ್ ಕಾನೂನು": "patent law",
        "ಪೆಟೆಂಟ್ ಅಧಿನಿಯಮ": "patent act", "ಕಲಮ": "section", "ಧಾರಾ": "section", "ಕायದೆ": "act",
        "ಅಧಿನಿಯಮ": "act", "ನ್ಯಾಯಾಂಗ": "legal", "ಗೌಪ್ಯ": "confidential", "ಔಷಧಿ": "drug", "ಔಷಧಿಗಳು": "drugs",
        "ವೈದ್ಯಕೀಯ": "medical", "ರೋಗ": "disease", "ಚಿಕಿತ್ಸೆ": "treatment", "ಎಂದಿಗ": "what is",
        "என்று": "what is", "ಅর্থ": "meaning", "ಅರ್ಥವಾಗುತ್ತದೆ": "means", "ಯಾವುದೇ": "any", "ಹೇಗೆ": "how",
        "ಏನು": "what", "ಯಾಕೆ": "why", "ಯಾವಾಗ": "when", "ಎಲ್ಲಿ": "where", "ಯಾರು": "who",
    },
    "ml": {
        "പെട്ടന്റ്": "patent", "പെട്ടന്റുകള്": "patents", "പെട്ടന്റ് നിയമം": "patent act",
        "വകുപ്പ്": "section", "ധാര": "section", "നിയമം": "act", "കാനൂന്": "law", "നിയമപരമായ": "legal",
        "രഹസ്യമായ": "confidential", "മരുന്ന്": "drug", "മരുന്നുകള്": "drugs", "വൈദ്യ": "medical",
        "രോഗം": "disease", "ചികിത്സ": "treatment", "എന്താണ്": "what is", "അര്‍ത്ഥം": "meaning",
        "അര്‍ത്ഥമാക്കുന്നു": "means", "എന്ത്": "what", "എങ്ങിനെ": "how", "എന്തുകൊണ്ട്": "why",
        "അപ്പോള്": "when", "എവിടെ": "where", "ആര്": "who",
    },
}

# What is taken out of model responses, in order. (?d) makes \n the only line end.
SCRUB_RULES = [
    ("role", r"<\|(?:system|user|assistant)\|>", ""),
    ("think", r"(?s)<\|think\|>.*?<\|endofthink\|>", ""),
    ("reasoning", r"(?s)<\|reasoning\|>.*?<\|endofreasoning\|>", ""),
    ("thinking", r"(?s)Thinking\.\.\..*?done thinking\.", ""),
    ("thinking2", r"(?s)Thinking\.\.\..*?done thinking", ""),
    ("first", r"(?imdU)^First, I need to[^.]*\.\s*", ""),
    ("let_me_look", r"(?imdU)^Let me (analyze|look at|examine|check)[^.]*\.\s*", ""),
    ("based", r"(?imdU)^Based on the context,\s*", ""),
    ("looking", r"(?imdU)^Looking at the context,\s*", ""),
    ("from", r"(?imdU)^From the context,\s*", ""),
    ("according", r"(?imdU)^According to the context,\s*", ""),
    ("shows", r"(?imdU)^The context (shows|indicates|states)\s+", ""),
    ("i_need", r"(?imdU)^I (need to|will|should)\s+", ""),
    ("let_me_see", r"(?imdU)^Let me (see|find|determine)\s+", ""),
    ("given", r"(?imd)^We are given.*?(?=\.|$)", ""),
    ("context_has", r"(?imd)^The context has.*?(?=\.|$)", ""),
    ("lets_look", r"(?imd)^Let's look at.*?(?=\.|$)", ""),
    ("review", r"(?imd)^Let me review.*?(?=\.|$)", ""),
    ("is", r"(?imd)^The (question|context) is.*?(?=\.|$)", ""),
    ("source", r"(?imdU)^SOURCE \d+[:.]\s*", ""),
    ("answer", r"(?imdU)^Answer[:.]?\s*", ""),
    ("sources", r"(?imdU)^Sources[:.]?\s*", ""),
    ("confidence", r"(?imdU)^Confidence[:.]?\s*", ""),
    ("check", r"(?imd)^Let me check.*?(?=\.|$)", ""),
    ("tags", r"<\|[^|]+\|>", ""),
    ("ansi_colour", r"\x1b\[[0-9;]*m", ""),
    ("ansi_mode", r"\x1b\[\?[0-9]*[hl]", ""),
    ("ansi_move", r"\x1b\[[0-9]*[A-Z]", ""),
    ("cursor", r"\[\?25[hl]", ""),
    ("sync", r"\[\?2026[hl]", ""),
    ("column", r"\[\d+G", ""),
    ("erase", r"\[K", ""),
    ("move", r"\[\d+[A-Z]", ""),
    ("control", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
]
ANSWER_BLOCK = r"(?sd)\*\*Answer\*\*:.*?(?:\*\*Sources\*\*:.*?)?(?:\*\*Confidence\*\*:.*?)?(?:\n|\z)"

# Heads of provisions and items. Content runs from the end of a head to the next one.
HEAD_LOOSE = uni(r"(?:^|\n)\s*(\d+)\.\s*([^\n]{5,200})")
HEAD_STRICT = uni(r"(?:^|\n)\s*(\d+)\.\s+(?:\([^)]+\)\s*)?([A-Z][^\n]{10,})")
SUBSTITUTION = uni(r"(?i)(?:^|\n)\s*For\s+section\s+(\d+)\s+of\s+the\s+principal\s+Act,?\s+the\s+following\s+section"
                r"\s+shall\s+be\s+substituted")
AMENDING = uni(r"(?i)(?:^|\n)\s*(\d+)\.\s+(?:In\s+section\s+\d+|For\s+section\s+\d+|After\s+section\s+\d+)")
AMENDMENT_OF = uni(r"(?i)(?:^|\n)\s*(\d+)\.\s+((?:Amendment|Substitution|Insertion|Omission|Repeal)\s+of\s+section"
                r"\s+(\d+))")
DEFINITION_HEAD = uni(r"""(?i)(?:^|\n)\s*[(\[]([a-z])\)\s+["']?([^"']+)["']?\s+means""")
DEFINITION_LINE = uni(r"""(?i)^["']?([A-Za-z\s]+)["']?\s+(?:means?|shall\s+mean|is\s+defined\s+as)\s+(.*?)$""")
TERM_USE = uni(r"""(?i)["']?([A-Za-z\s]+)["']?\s+(?:means?|shall\s+mean|is\s+defined\s+as|refers?\s+to)\s+""")
#: The same matches in linear time: a match can only begin where a run of letters begins, at a quote,
#: or where the previous match ended.
TERM_USE_FAST = TERM_USE.replace("(?i)", r"""(?i)(?:(?<![A-Za-z\s])|\G|(?=["']))""")
ITEM_HEADS = {
    "schedule": uni(r"(?i)(?:^|\n)\s*Schedule\s+([IVX]+|\d+)[\s.\-:]*([^\n]*)"),
    "form": uni(r"(?i)(?:^|\n)\s*Form\s+([A-Z0-9]+)[\s.\-:]*([^\n]*)"),
    "table": uni(r"(?i)(?:^|\n)\s*Table\s+(\d+)[\s.\-:]*([^\n]*)"),
}
HEADED_LINES = {
    "section": uni(r"(?i)^Section\s+(\d+[\w\-.]*):?\s*(.*?)$"),
    "rule": uni(r"(?i)^Rule\s+(\d+[\w\-.]*):?\s*(.*?)$"),
}

# Page types by words, in order of precedence (type, words).
PAGE_TYPE_WORDS = [
    ("table_of_contents", ["preamble", "arrangement of sections", "arrangement of rules", "table of contents", "contents"]),
    ("schedule", ["schedule i", "schedule ii", "schedule iii", "schedule iv", "first schedule", "second schedule"]),
    ("form", ["form ", "form no", "form no."]),
]
VALID_PAGE_TYPES = [
    "preamble", "content", "schedule", "form", "definition", "table_of_contents", "appendix", "annexure", "index",
    "amendment", "repeal", "substitution", "insertion", "omission",
]
#: The narrower list the schema check uses.
SCHEMA_PAGE_TYPES = [
    "preamble", "toc", "table_of_contents", "definition", "schedule", "form", "content", "appendix", "index",
]

# Domains by words in the file name, in order: (domain, words, base name).
FILE_DOMAINS = [
    ("Biodiversity", ["biological", "biodiversity"], "Biological Diversity"),
    ("Patents", ["patent"], "Patents"),
    ("Designs", ["design"], "Designs"),
    ("Geographical Indications", ["geographical", "gi_", "gi "], "Geographical Indications of Goods"),
    ("Trademarks", ["trade_mark", "trademark"], "Trade Marks"),
    ("Copyright", ["copyright"], "Copyright"),
]

# Patterns counted per page (category, pattern); any case, ^ at every line.
LEGAL_PATTERNS = [
    ("section_reference", r"\bsection\s+\d+\b"),
    ("subsection_reference", r"\bsub[-\s]?section\s+\(?\d+\)?"),
    ("clause_reference", r"\bclause\s+\(?[a-z]\)?"),
    ("proviso", r"\bprovided\s+that\b"),
    ("further_proviso", r"\bprovided\s+further\s+that\b"),
    ("explanation", r"\bexplanation\b"),
    ("definition", r"\bmeans\b"),
    ("mandatory", r"\bshall\b"),
    ("permissive", r"\bmay\b"),
    ("subject_to", r"\bsubject\s+to\b"),
    ("notwithstanding", r"\bnotwithstanding\b"),
    ("schedule_reference", r"\bschedule\s+[ivx]+\b"),
    ("form_reference", r"\bform\s+[a-z0-9]+\b"),
    ("numbered_section", r"^\d+\.\s+[A-Z]"),
    ("numbered_subsection", r"^\(\d+\)"),
    ("numbered_clause", r"^\([a-z]\)"),
    ("amendment_action", r"\bamendment\s+(?:of|to)\s+section"),
    ("substitution_action", r"\bsubstitution\s+(?:of|for)\s+section"),
    ("insertion_action", r"\binsertion\s+(?:of|after)\s+section"),
    ("omission_action", r"\bomission\s+(?:of|from)\s+section"),
    ("repeal_action", r"\brepeal\s+(?:of|section)"),
]
PROVISION_WORDS = ["section", "subsection", "clause", "provided that", "shall", "explanation"]

# Terms by domain, in the order that breaks ties.
DOMAIN_TERMS = {
    "Biodiversity": ["biological diversity", "biological resources", "biodiversity", "genetic resources",
                     "national biodiversity authority", "state biodiversity board", "biodiversity management committee"],
    "Access and Benefit Sharing": ["access", "benefit sharing", "benefit claimers", "prior approval",
                                   "mutually agreed terms", "fair and equitable"],
    "Traditional Knowledge": ["traditional knowledge", "codified traditional knowledge", "indigenous knowledge",
                              "local communities", "folk variety", "landrace", "cultivar", "farmers' variety"],
    "Patents": ["patent", "invention", "patentable", "patentee", "controller of patents", "patent office",
                "specification", "claims"],
    "Intellectual Property": ["intellectual property", "ip rights", "copyright", "trademark", "design",
                              "geographical indication"],
    "Environment": ["environment", "conservation", "sustainable use", "ecosystem", "species", "habitat"],
    "General Legal": ["shall", "may", "provided that", "notwithstanding", "subject to", "herein", "hereby"],
}

# Cross references, named bodies and dates.
CROSS_REFERENCE = uni(r"(?i)\b(?:section|sub[-\s]?section|clause|sub[-\s]?clause|schedule|form|article|rule)"
                   r"\s+[\d()ivx]+")
ENTITIES = [
    r"(?i)\b(?:National Biodiversity Authority|State Biodiversity Board|Biodiversity Management Committee"
    r"|Central Government|State Government)\b",
    r"(?i)\b(?:Controller|Patent Office|High Court|Supreme Court|National Green Tribunal)\b",
    rf"(?i)\b(?:Ministry of [{WORD}]+|Department of [{WORD}]+)",
]
AUTHORITIES = [
    r"(?i)\b(?:Central Government|State Government|National Biodiversity Authority|State Biodiversity Board"
    r"|Biodiversity Management Committee|Controller|Patent Office|High Court|Supreme Court|National Green Tribunal"
    r"|Registrar)\b",
]
DATES = [
    r"(?i)\b\d{1,2}(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October"
    r"|November|December)\s+\d{4}\b",
    r"\b\d{4}\b",
    r"(?i)\b(?:w\.e\.f\.|with effect from)\s+[\d\-]+\b",
]

# Document types by words of the name (longest key first) and of the pages.
DOC_TYPE_KEYS = [
    ("amendment act", "Amendment Act"), ("notification", "Notification"), ("regulation", "Regulation"),
    ("amendment", "Amendment Act"), ("schedule", "Schedule"), ("order", "Order"), ("rule", "Rule"), ("form", "Form"),
    ("act", "Act"),
]
CHAPTER = uni(r"(?i)CHAPTER\s+([IVX]+)\s*[.\-]?\s*([^\n]+)")

# Retrieval and answer thresholds.
CONFIDENCE_BANDS = [("high", 0.6), ("medium", 0.4), ("low", 0.25)]
MIN_RELEVANCE = 0.3
