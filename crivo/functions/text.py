"""Text expressions. All are JVM built-ins; regex classes are spelled out because Java, RE2 and Python differ."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Every Unicode whitespace character of Python's `\s`; Java's `\s` knows six of them.
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
# A word character of Python's `\w`.
WORD = r"\p{L}\p{N}_"
WORD_TOKEN = rf"[{WORD}]{{2,}}"
# Links removed when the training text is composed: scheme, www and two shorteners.
LINK = rf"(^|[^{WORD}])(?:https?://|www\.|bit\.ly/|t\.co/)[^{SPACE}]*"



def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one letter and marks, and these letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(p for _, p in pairs)


ACCENTED, PLAIN = _accents()

# The byline that opens the footer, the credit that follows, and the section that is kept.
FOOTER_SIGNATURE = "Redação ICL"
FOOTER_CREDIT = "Com informações"
FOOTER_KEEP = "Relacionados"

# Terms whose presence may give the source away.
GIVEAWAY_TERMS = ("icl notícias", "jornal conexão", "g1", "leia também", "nsc total", "ndmais", "mpsc", "ministério público")


def normalize_space(text: Column) -> Column:
    """Each whitespace run becomes one space; the ends are stripped."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def rstrip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+$", "")


def raw_hash(text: Column) -> Column:
    return F.md5(text)


def norm_hash(text: Column) -> Column:
    return F.md5(normalize_space(text))


def folded_hash(text: Column) -> Column:
    return F.md5(F.lower(normalize_space(text)))


def compose_text(title: Column, body: Column) -> Column:
    """Title and body in one string, links removed, whitespace normalised; a NULL part is skipped."""
    return normalize_space(F.regexp_replace(F.concat_ws(" ", title, body), LINK, "$1"))


def word_tokens(text: Column) -> Column:
    """Lower-case words of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 3) -> Column:
    """All n-grams for n in low..high, joined by a space. Short documents give fewer, never an error."""
    out, grams = [], tokens
    for n in range(1, high + 1):
        if n > 1:
            # Each gram meets the next word; past the end that word is NULL and so is the gram. The lambda sees only
            # its own arguments: a column inside it would be computed once per element.
            grams = F.zip_with(grams, F.slice(tokens, F.lit(n), F.size(tokens)), lambda g, w: F.concat(g, F.lit(" "), w))
        if n >= low:
            out.append(grams if n == 1 else F.filter(grams, lambda g: g.isNotNull()))
    return out[0] if len(out) == 1 else F.concat(*out)


def strip_accents(text: Column) -> Column:
    """Accented Latin letters become plain ones, and combining marks go."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", "")


def heavy_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Tokens for sparse features: lower case, no accents, no stop words; repeats are kept."""
    tokens = F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(WORD_TOKEN), F.lit(0))
    stops = sorted({w.lower().translate(str.maketrans(ACCENTED, PLAIN)) for w in stop_words})
    return F.filter(tokens, lambda t: ~t.isin(stops)) if stops else tokens


def heavy_normalize(text: Column, stop_words: Sequence[str]) -> Column:
    return F.array_join(heavy_tokens(text, stop_words), " ")


def contains_folded(text: Column, needle) -> Column:
    """Literal, case-folded substring test; `needle` is a string or a column."""
    needle = needle if isinstance(needle, Column) else F.lit(needle)
    return F.contains(F.lower(text), F.lower(needle))


def excerpt(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def footer_pattern(signature: str = FOOTER_SIGNATURE, credit: str = FOOTER_CREDIT, keep: str = FOOTER_KEEP) -> str:
    """Signature, at most one glued word, credit, then everything up to the kept section or the end of the text."""
    gap = f"[{SPACE}]*"
    return (
        rf"(?s){gap}\Q{signature}\E{gap}[{WORD}]*?{gap}\Q{credit}\E(?![{WORD}]).*?(?={gap}\Q{keep}\E(?![{WORD}])|\z)"
    )


def strip_footer(text: Column, pattern: str | None = None) -> Column:
    """Remove each footer and trailing whitespace. NULL stays NULL; a second run changes nothing."""
    return rstrip_space(F.regexp_replace(text, pattern or footer_pattern(), ""))


def mask_terms(text: Column, terms: Sequence[str], mask: str = " ") -> Column:
    """Replace whole-word, case-insensitive occurrences of `terms`; longer terms are tried first."""
    if not terms:
        return text
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    body = "|".join(rf"\Q{t}\E" for t in ordered)
    return F.regexp_replace(text, rf"(?iu)(?<![{WORD}])(?:{body})(?![{WORD}])", mask)
