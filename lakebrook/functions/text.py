"""Text functions as columns: query terms, sentences, white space, slugs, redaction, grounding. JVM-side unless it says so."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that a natural-language question loses before matching.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does",
    "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "what", "when", "where", "which", "who", "why", "with",
)

# Claims about more than the supplied evidence, and what negates them shortly before.
SCOPE_PATTERNS = (
    r"\bthe corpus (?:proves?|establishes?|demonstrates?|shows that|agrees)\b",
    r"\b(?:all|every) sources? (?:agree|show|support|confirm)\b",
    r"\bthe field (?:agrees|has reached consensus|consistently)\b",
    r"\bthe corpus contains (?:no )?conflicting evidence\b",
    r"\b(?:no|zero) (?:other )?sources? (?:disagree|conflict)\b",
    r"\bindustry consensus\b",
    r"\b(?:experts?|researchers?) (?:broadly|generally|widely) agree\b",
)
SCOPE_NEGATION = r"\b(?:not|never|no|without|does not|doesn't|do not|don't|is not|isn't|cannot|can't)\b(?:\W+\w+){0,8}\W*$"
# What makes a claim a constraint; which keys, query strings and headers are secret; where a string is cut.
CONSTRAINT_PATTERN = r"\bmust not\b|\bmust avoid\b|\bshould not\b|^the answer must\b"
SECRET_KEY = r"(password|passwd|token|secret|api[_-]?key|cookie|authorization)"
SIGNED_URL = r"(https?://[^\s\"']+\?)[^\s\"']+"
BEARER = r"(?i)(bearer\s+)[^\s]+"
MAX_STRING = 2000

#: Java's \w and \s are ASCII unless told otherwise.
WORD = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def query_terms(text: Column) -> Column:
    """Lower-case words without stop words, repeated ones kept."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_substantive(text: Column) -> Column:
    """Whether a letter or digit is left when bracketed cues are taken out."""
    return F.regexp_replace(text, r"\[[^\[\]]+\]", " ").rlike(r"[\p{L}\p{N}]")


#: What Unicode's full case folding does beyond lower case, from Python's tables: one letter to another, and one to several.
#: Cherokee is left out: it folds to upper case, which pairs the same letters as lower case does.
_BEYOND = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c.lower() and not "\u13a0" <= c <= "\u13fd" and not "\uab70" <= c <= "\uabbf"}
_ONE = {c: f for c, f in _BEYOND.items() if len(f) == 1} | {"Σ": "σ"}  # Java writes a word's last sigma differently
_SEVERAL = {c: f for c, f in _BEYOND.items() if len(f) > 1} | {"İ": "İ".casefold()}


def casefold(text: Column) -> Column:
    """Unicode's full case folding. Only texts that hold a letter which folds to several are taken apart."""
    several = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    whole = F.when(text.rlike("[" + "".join(_SEVERAL) + "]"), spread).otherwise(text)
    return F.lower(F.translate(whole, "".join(_ONE), "".join(_ONE.values())))


def grounded(quote: Column, text: Column) -> Column:
    """Containment after collapsing white space, ignoring case; an empty quote is never grounded."""
    q = casefold(normalize_ws(quote))
    return (q != "") & F.contains(casefold(normalize_ws(text)), q)


def slugify(text: Column, fallback: str = "", dots: bool = True) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9.]+" if dots else "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def redact(text: Column) -> Column:
    """Query strings of URLs and bearer tokens taken out, then cut at MAX_STRING characters."""
    safe = F.regexp_replace(F.regexp_replace(text, SIGNED_URL, "$1[QUERY_REDACTED]"), BEARER, "$1[REDACTED]")
    return F.when(F.length(safe) > MAX_STRING, F.concat(F.substring(safe, 1, MAX_STRING), F.lit("...[TRUNCATED]"))).otherwise(safe)


def redact_map(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: F.when(k.rlike("(?i)" + SECRET_KEY), F.lit("[REDACTED]")).otherwise(redact(v)))


def redact_arguments(args: Column) -> Column:
    """The argument after a secret flag goes; indexes are needed, so both neighbours are looked at."""

    def one(x: Column, i: Column) -> Column:
        before = F.get(args, i - 1)
        secret = before.startswith("--") & before.rlike("(?i)" + SECRET_KEY)
        return F.when((i > 0) & F.coalesce(secret, F.lit(False)), F.lit("[REDACTED]")).otherwise(redact(x))

    return F.transform(args, one)


def sentences(text: Column) -> Column:
    """Sentence-like pieces, trimmed: runs of .!? with closing quotes or brackets, before white space or the end."""
    marked = F.regexp_replace(text, r"([.!?]+[\"')\]]*)(?=\s|$)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def passage_context(text: Column, quote: Column, chars: int) -> Column:
    """struct(context_before, passage, context_after) around the first place of the quote; null if it isn't there."""
    source, passage = normalize_ws(text), normalize_ws(quote)
    at = F.instr(F.lower(source), F.lower(passage))
    start = F.greatest(F.lit(1), at - chars)
    end = F.least(F.length(source), at + F.length(passage) - 1 + chars)
    before = F.trim(F.substring(source, start, at - start))
    after = F.trim(F.substring(source, at + F.length(passage), end - (at + F.length(passage)) + 1))
    return F.when(
        at > 0,
        F.struct(
            F.when(start > 1, F.concat(F.lit("…"), before)).otherwise(before).alias("context_before"),
            F.substring(source, at, F.length(passage)).alias("passage"),
            F.when(end < F.length(source), F.concat(after, F.lit("…"))).otherwise(after).alias("context_after"),
        ),
    )


def scope_violations(answer: Column, ascii_words: bool = False) -> Column:
    """Those of SCOPE_PATTERNS that stand somewhere without a negation in the 80 characters before. A mark is put before
    each match, so that the pieces up to the n-th mark are what stands before the n-th match. ascii_words: words are of
    ASCII letters, digits and _, as RE2 has them, and any other letter ends one; else of all letters, as Python has them."""
    rule = _ascii_words if ascii_words else "(?iU){}".format

    def broken(pattern: str) -> Column:
        pieces = F.split(F.regexp_replace(F.coalesce(answer, F.lit("")), rule(f"({pattern})"), "\u0001$1"), "\u0001")
        before = lambda n: F.right(F.array_join(F.slice(pieces, F.lit(1), n), ""), F.lit(80))
        matches = F.slice(F.sequence(F.lit(0), F.size(pieces) - 1), F.lit(2), F.size(pieces))
        return F.exists(matches, lambda n: ~before(n).rlike(rule(SCOPE_NEGATION)))

    return F.array_compact(F.array(*[F.when(broken(p), F.lit(p)) for p in SCOPE_PATTERNS]))


def _ascii_words(pattern: str) -> str:
    r"""The pattern with RE2's words and edges of words, without regard to case: there the letters that fold to s and k match
    these and are in \w, but have no part in \b. Java's own \b goes by all letters. Each of the patterns begins with an edge
    before a letter that nothing else folds to, so that this one looks back only."""
    word, folded = "[0-9A-Za-z_]", "0-9A-Za-z_\u017f\u212a"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    parts = {r"\w": f"[{folded}]", r"\W": f"[^{folded}]", "s": "[s\u017f]", "k": "[k\u212a]"}
    first, rest = pattern.split(r"\b", 1)
    return f"(?i){first}(?<!{word})" + re.sub(r"\\.|[sk]", lambda m: edge if m[0] == r"\b" else parts.get(m[0], m[0]), rest)


def shared_end(before: str, caption: str) -> int:
    """How many first characters of caption the text before it ends with: the last value of the prefix function of both."""
    joined = f"{caption}\0{before[len(before) - min(len(before), len(caption)) :]}"
    border = [0] * len(joined)
    for i in range(1, len(joined)):
        k = border[i - 1]
        while k and joined[k] != joined[i]:
            k = border[k - 1]
        border[i] = k + (joined[k] == joined[i])
    return border[-1] if before else 0


def rolled(captions) -> str:
    """Captions in order as prose: of each only what the text shown so far doesn't end with already. Only as much of that
    text is kept at hand as the longest caption could repeat."""
    clean = [c for c in (" ".join(str(x or "").split()) for x in captions) if c]
    most = max(map(len, clean), default=0)
    shown, recent = [], ""
    for caption in clean:
        fresh = caption[shared_end(recent, caption) :].strip()
        if fresh:
            shown.append(fresh)
            recent = f"{recent} {fresh}"[-most:] if recent else fresh
    return " ".join(shown)


@F.pandas_udf(StringType())
def deoverlap(captions: pd.Series) -> pd.Series:
    """Rolling captions as prose; an order-dependent fold over an array that is already in order."""
    return captions.map(lambda c: rolled(c if c is not None else ()))


def extract_json_object(raw: Column) -> Column:
    """The first of: the whole text, a fenced block, first to last brace, that parses as a JSON object; else null."""
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    candidates = F.transform(F.array(raw, fenced, braces), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.get(F.filter(candidates, lambda c: c.startswith("{") & F.try_parse_json(c).isNotNull()), F.lit(0))


# Porter's algorithm (1980), step by step from the paper.
_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


_KINDS = {i: "v" if chr(i) in _VOWELS else "c" for i in range(128)}


def _kinds(w: str) -> str:
    """v for each vowel, c for each consonant; only a y looks at what stands before it."""
    return "".join("c" if _consonant(w, i) else "v" for i in range(len(w))) if "y" in w else w.translate(_KINDS)


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _has_vowel(w: str) -> bool:
    return "v" in _kinds(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
#: Longest first; most words end in none of them, which one look tells.
_ENDS2, _ENDS3, _ENDS4 = (tuple(sorted(ends, key=len, reverse=True)) for ends in (_STEP2, _STEP3, _STEP4))


@functools.lru_cache(1 << 17)
def porter(word: str) -> str:
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif _double(cut) and cut[-1] not in "lsz":
                w = cut[:-1]
            else:
                w = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in ((_STEP2, _ENDS2), (_STEP3, _ENDS3)):
        end = next(e for e in ends if w.endswith(e)) if w.endswith(ends) else None
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = next(e for e in _ENDS4 if w.endswith(e)) if w.endswith(_ENDS4) else None
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _cvc(stem):
            w = stem
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(terms: pd.Series) -> pd.Series:
    """Porter stems, each different term of a batch once."""
    codes, known = pd.factorize(terms)
    return pd.Series([*map(porter, known), None], dtype=object).take(codes).reset_index(drop=True)


# NFKD would decompose more than accents; these are the letters of the corpus's languages.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def without_accents(text: Column) -> Column:
    return F.translate(text, *ACCENTS)
