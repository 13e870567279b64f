"""Regular expressions for screening and HTML clean-up, as Spark (Java) regex.

Only the pattern text is fixed; matching runs in Spark's native
``rlike`` / ``regexp_replace``.  Java's ``\\b`` is Unicode-aware while the
original patterns use ASCII word boundaries, so ``\\b`` is written as
ASCII look-arounds where it occurs.
"""

from __future__ import annotations

# Prompt-injection patterns (case-insensitive, unanchored), in order.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+instructions?",
    r"disregard\s+(all\s+)?(previous|prior|above|earlier)\s+instructions?",
    r"forget\s+(all\s+)?(previous|prior|above|earlier)\s+instructions?",
    r"you\s+are\s+now\s+(a|an)\s+",
    r"act\s+as\s+(if\s+you\s+are\s+)?(a|an)\s+",
    r"pretend\s+(you\s+are|to\s+be)\s+",
    r"jailbreak",
    r"dan\s+mode",
    r"developer\s+mode",
    r"\[system\]",
    r"\[assistant\]",
    r"\<\|system\|\>",
    r"\<\|assistant\|\>",
    r"###\s*system",
    r"###\s*assistant",
]

# A base64-looking run, and the characters kept before decoding.
BASE64_RUN = r"[A-Za-z0-9+/]{50,}={0,2}"
BASE64_STRIP = r"[^A-Za-z0-9+/=]"
BASE64_MIN_BYTES = 20

# Reasons reported by the validator.
REASON_INJECTION = "Input contains a potential prompt injection pattern."
REASON_BASE64 = "Input contains base64-encoded prompt injection."
REASON_BLOCKED = "Input matches a blocked pattern."

# ASCII word boundaries (PCRE without /u): before a word character / after one.
_WB_BEFORE = r"(?<![A-Za-z0-9_])"
_WB_AFTER = r"(?![A-Za-z0-9_])"

# Personal-data patterns, checked in this order.
PII_PATTERNS = [
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("phone", r"\+?[\d\s\-\(\)]{10,}"),
    ("ssn", _WB_BEFORE + r"\d{3}[-\s]?\d{2}[-\s]?\d{4}" + _WB_AFTER),
    ("cc", _WB_BEFORE + r"(?:\d{4}[-\s]?){3}\d{4}" + _WB_AFTER),
]

# Tags removed from HTML output (content kept except script/style).
FORBIDDEN_TAGS = ["script", "iframe", "object", "embed", "form", "base", "link", "meta", "style"]


def injection_regexes() -> list[str]:
    """One case-insensitive regex per pattern.  Measured on sf0.1 documents,
    OR-ing them (each keeps Java's literal-prefix scan, and the OR stops at
    the first hit) is ~4x faster than the fused alternation."""
    return ["(?i)" + p for p in INJECTION_PATTERNS]


# Scan forms used only to test whether a match exists.  Each starts matching
# at the left edge of a run of its leading class, which cannot change whether
# some match exists (a match starting inside a run also starts at the run's
# left edge) but keeps long tokens linear instead of quadratic.
BASE64_RUN_SCAN = r"(?<![A-Za-z0-9+/])" + BASE64_RUN
EMAIL_SCAN = r"(?<![a-zA-Z0-9._%+\-])[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def sanitize_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) pairs of the HTML clean-up, applied in order."""
    steps = [
        (r"(?is)<script" + _WB_AFTER + r"[^>]*>.*?</script>", ""),
        (r"(?is)<style" + _WB_AFTER + r"[^>]*>.*?</style>", ""),
    ]
    for tag in FORBIDDEN_TAGS:
        steps.append((rf"(?i)<{tag}(\s[^>]*)?/?>", ""))
        steps.append((rf"(?i)</{tag}>", ""))
    steps += [
        (r"""(?i)\s+on[a-z]+\s*=\s*["'][^"']*["']""", ""),
        (r"(?i)\s+on[a-z]+\s*=\s*[^\s>]+", ""),
        (r"""(?i)href\s*=\s*["']?\s*javascript:""", 'href="javascript:void(0)"'),
        (r"""(?i)src\s*=\s*["']?\s*javascript:""", 'src=""'),
        (r"""(?i)src\s*=\s*["']?\s*data:""", 'src=""'),
    ]
    return steps


def markup_scan(depth: int = 32) -> str:
    """One pattern that takes the next piece of markup, so that replacing it reads a
    text from left to right.  Possessive throughout: linear in the text, also on
    unterminated markup.

    A ``<`` opens markup unless white space follows it.  A tag ends at the ``>`` that
    is neither quoted nor the end of a ``<`` opened within the tag; such inner tags nest
    ``depth`` deep, and one nested deeper runs to the end of the text.  A comment ends
    at ``-->``, ``<? ... ?>`` (but not ``<?xml``) at ``?>`` outside quotes, another
    declaration at ``>`` outside quotes.  What does not end runs to the end of the text.
    NUL characters go as well."""
    quoted = r"""\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)"""
    plain = rf"""(?:[^<>"']++|<(?=\s)|{quoted})*+"""
    tag = plain + r"(?:<(?!\s)(?s:.*+))?+"
    for _ in range(depth):
        tag = rf"{plain}(?:<(?!\s){tag}(?:>|\z){plain})*+"
    comment = r"<!(?=--)(?s:.*?)(?:-->|\z)"
    code = rf"""<\?(?!(?i:xml))(?:[^?"']++|\?(?!>)|{quoted})*+(?:\?>|\z)"""
    declaration = rf"""<!(?!(?i:doctype))(?:[^>"']++|{quoted})*+(?:>|\z)"""
    return rf"{comment}|{code}|{declaration}|<(?!\s){tag}(?:>|\z)|\x00"


MARKUP = markup_scan()

# Characters removed by the final trim (space, tab, LF, CR, NUL, VT).
TRIM_CHARS = " \t\n\r\x00\x0b"
