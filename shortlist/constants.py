"""Constants, word lists, patterns and texts that define results."""

from __future__ import annotations

# --- Fixed values: search ---------------------------------------------------
LEXICAL_WEIGHT = 0.4
DEFAULT_TOP_K = 10
BM25_K1 = 1.2
BM25_B = 0.75
EMBEDDING_DIM = 384
# Rankings compare scores rounded to this many digits, then the id.
RANK_DIGITS = 9

# --- Fixed values: conversations --------------------------------------------
MAX_USER_TURNS = 8
MAX_RECOMMENDATIONS = 10
RETRIEVAL_TOP_K = 15
CLARIFY_TOP_K = 5
CLARIFY_MIN_QUERY_CHARS = 10
DESCRIPTION_CHARS = 200

CLARIFY = "CLARIFY"
RECOMMEND = "RECOMMEND"
REFINE = "REFINE"
COMPARE = "COMPARE"
REFUSE = "REFUSE"
# Route of a conversation over the turn limit; it is not an intent.
LIMIT = "LIMIT"

# --- Fixed values: patterns on the latest user message ----------------------
REFUSE_PATTERNS = (
    r"\bsalary\b",
    r"\bsalaries\b",
    r"\bpay\s+scale\b",
    r"\bcompensation\b",
    r"\blegal\s+advice\b",
    r"\blawsuit\b",
    r"\bsue\b",
    r"\bwrite\s+(?:me\s+)?(?:a\s+)?(?:poem|story|essay|code|song)\b",
    r"\bignore\s+(?:previous|above|all)\s+instructions\b",
    r"\bforget\s+(?:your|all)\s+(?:rules|instructions)\b",
    r"\bjailbreak\b",
    r"\bpretend\s+you\s+are\b",
    r"\bweather\b",
    r"\brecipe\b",
    r"\bjoke\b",
)

COMPARE_PATTERNS = (
    r"\bdiffer(?:ence|ent|s)?\b",
    r"\bcompare\b",
    r"\bcomparison\b",
    r"\bvs\.?\b",
    r"\bversus\b",
    r"\bwhich\s+(?:one|is\s+better)\b",
    r"\bbetween\b.*\band\b",
)

REFINE_PATTERNS = (
    r"\bactually\b",
    r"\binstead\b",
    r"\bchange\b",
    r"\bswitch\b",
    r"\breplace\b",
    r"\bremove\b",
    r"\badd\b.*\bto\s+the\s+list\b",
    r"\bwhat\s+about\b",
    r"\bcan\s+you\s+also\b",
    r"\bfilter\b",
    r"\bonly\b.*\badaptive\b",
    r"\bonly\b.*\bremote\b",
    r"\bshorter\b",
    r"\bquicker\b",
)

CONFIRM_PATTERNS = (
    r"^(?:yes|yeah|yep|ok|okay|sure|perfect|great|good|confirmed"
    r"|that'?s?\s+(?:it|all|right|correct|fine|what\s+we\s+need))[\.\!\s]*$",
    r"\bthat(?:'?s| is)\s+(?:it|all|right|correct|perfect|great|fine|what\s+we\s+need)\b",
    r"\bgo\s+(?:ahead|with\s+(?:that|these|this))\b",
    r"\bconfirm\b",
    r"\bsounds\s+good\b",
    r"\blet'?s?\s+(?:go|do\s+(?:it|that))\b",
)

# --- Fixed values: one pattern per signal group of the full user context ----
CONTEXT_SIGNALS = (
    r"\b(?:java|python|c\+\+|javascript|sql|react|angular|node)\b",
    r"\b(?:developer|engineer|manager|executive|agent|analyst|admin)\b",
    r"\b(?:entry.?level|mid.?level|senior|graduate|executive|director)\b",
    r"\b(?:personality|cognitive|ability|aptitude|numerical|verbal)\b",
    r"\b(?:sales|customer\s+service|leadership|management|data\s+entry)\b",
    r"\b(?:hiring|selection|screening|assessment|test)\b",
    r"\b(?:contact\s+cent(?:er|re)|call\s+cent(?:er|re))\b",
    r"\b(?:simulation|situational|behavioral|behaviour)\b",
)

# --- Fixed values: job levels, in result order ------------------------------
LEVEL_RULES = (
    ("Entry-Level", r"\bentry.?level\b"),
    ("Graduate", r"\bgraduate\b"),
    ("Mid-Professional", r"\bmid.?(?:level|professional)\b"),
    ("Professional Individual Contributor", r"\bsenior\b|professional\s+individual"),
    ("Manager", r"\bmanager\b"),
    ("Supervisor", r"\bsupervisor\b"),
    ("Director", r"\bdirector\b"),
    ("Executive", r"\bexecutive\b|\bcxo\b|\bc-suite\b"),
    ("Front Line Manager", r"\bfront.?line\s+manager\b"),
)
ADAPTIVE_PATTERN = r"\badaptive\b|\birt\b"
DURATION_PATTERN = r"(?:under|less\s+than|max(?:imum)?|within)\s+(\d+)\s*min"

# --- Fixed values: marks of an earlier recommendation -----------------------
# The address of the caller's own catalog is a parameter where this is used.
PRIOR_MARKERS = ("recommend", "assessment", "here are", "following", "test type")

# --- Fixed values: texts ----------------------------------------------------
NO_HITS_TEXT = "No matching assessments found in the catalog."
CONTEXT_HEADER = "--- CATALOG SEARCH RESULTS (use these for recommendations) ---"
CONTEXT_FOOTER = "--- END CATALOG DATA ---"
JSON_REMINDER = "Respond with valid JSON only."
LIMIT_REPLY = (
    f"We've reached the maximum of {MAX_USER_TURNS} turns for this conversation. "
    "Please start a new conversation if you need further assistance."
)
APOLOGY_REPLY = (
    "I apologize, but I'm having a temporary issue. "
    "Could you please rephrase your question about the catalog?"
)
EMPTY_REPLY = (
    "I can help you find the right assessment. What role are you hiring for?"
)

# --- Fixed values: English stop words (the public Snowball list) ------------
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he
    him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can
    will just don should now
    """.split()
)
