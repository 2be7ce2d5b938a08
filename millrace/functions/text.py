"""Text projections and predicates (TX1-TX35) as column expressions.

White space is Unicode white space; word characters are letters, numbers and the underscore in any script.
Unicode normal forms and case folding have no built-in: they are Arrow UDFs that get the texts beyond ASCII only.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
#: Languages by alias.
LANGUAGES = {
    "en": ("en", "eng", "english"),
    "ta": ("ta", "tam", "tamil"),
    "hi": ("hi", "hin", "hindi"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "de": ("de", "deu", "ger", "german"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "chinese"),
    "ja": ("ja", "jpn", "japanese"),
    "ko": ("ko", "kor", "korean"),
}
#: Scripts by name, as classes of a regular expression.
SCRIPTS = {
    "latin": r"[A-Za-z\x{00C0}-\x{024F}]",
    "tamil": r"[\x{0B80}-\x{0BFF}]",
    "devanagari": r"[\x{0900}-\x{097F}]",
    "bengali": r"[\x{0980}-\x{09FF}]",
    "telugu": r"[\x{0C00}-\x{0C7F}]",
    "kannada": r"[\x{0C80}-\x{0CFF}]",
    "malayalam": r"[\x{0D00}-\x{0D7F}]",
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]",
    "cyrillic": r"[\x{0400}-\x{04FF}]",
    "greek": r"[\x{0370}-\x{03FF}]",
    "hebrew": r"[\x{0590}-\x{05FF}]",
    "thai": r"[\x{0E00}-\x{0E7F}]",
    "hangul": r"[\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}]",
    "han": r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]",
    "japanese": r"[\x{3040}-\x{30FF}]",
}
#: Words that an acronym skips.
STOP_WORDS = ("a", "an", "and", "for", "of", "the", "to")
#: Approved abstentions, and the marks that may follow a sentence.
ABSTENTIONS = (
    "I cannot verify this from the available evidence.",
    "I can’t verify this from the available evidence.",
    "இந்தக் கூற்றை கிடைக்கும் ஆதாரங்களிலிருந்து சரிபார்க்க முடியவில்லை.",
    "उपलब्ध साक्ष्यों से इस दावे की पुष्टि नहीं कर सकता।",
)
END_MARKS = " .!?！？。॥"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition (the part of TX1 and TX2 that has no built-in)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _nfkc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def _other(x: Column) -> Column:
    """The text if it has a character beyond ASCII, else null: ASCII texts are in every normal form and stay in the JVM."""
    return F.when(F.regexp_like(x, F.lit(r"[^\x00-\x7F]")), x)


def folded(x: Column) -> Column:
    """Unicode compatibility composition, case folded."""
    return F.coalesce(_nfkc_fold(_other(x)), F.lower(x))


def collapse(x: Column) -> Column:
    """White-space runs to one blank, ends trimmed (TX6)."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def optional_text(x: Column) -> Column:
    """Compatibility-composed, trimmed text; blank is null (TX1)."""
    return F.nullif(F.regexp_replace(F.coalesce(nfkc(_other(x)), x), r"(?U)^\s+|\s+$", ""), F.lit(""))


def normalized(x: Column) -> Column:
    """Compatibility-composed, case-folded, collapsed (TX2)."""
    return collapse(folded(x))


def dedup_key(x: Column) -> Column:
    """Curly apostrophes straight, then as TX2 (TX7)."""
    return normalized(F.translate(x, "’‘ʼ", "'''"))


def path_key(x: Column) -> Column:
    """Slashes forward and single, no leading ``./`` or trailing ``/``, lower case (TX3)."""
    p = F.regexp_replace(F.translate(F.trim(x), "\\", "/"), "/+", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "/$", ""))


def basename(x: Column) -> Column:
    return F.substring_index(path_key(x), "/", -1)


def label_key(x: Column) -> Column:
    """The ASCII alphanumeric tokens, lower case, joined by blanks (TX4)."""
    return F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def source_id(x: Column) -> Column:
    """The first ``SRC<number>`` in upper case (TX5)."""
    return F.nullif(F.upper(F.regexp_extract(x, r"(?i)\bSRC\d+\b", 0)), F.lit(""))


def tokens(x: Column) -> Column:
    """Word tokens of the lower-cased text (TX9)."""
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def initials(x: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """First letters of the words that are not stop words: what a conservative acronym must equal (TX10, TX11)."""
    return F.array_join(F.transform(F.filter(tokens(x), lambda t: ~t.isin(list(stop))), lambda t: F.substring(t, 1, 1)), "")


def acronym_key(x: Column) -> Column:
    """The acronym a surface form may be, else null: one short word in capitals or of at most four letters, or single
    letters with marks between them (TX10)."""
    t = F.trim(x)
    words = tokens(normalized(t))
    one = (F.size(words) == 1) & F.length(words[0]).between(2, 8) & (((F.upper(t) == t) & (F.lower(t) != t)) | (F.length(words[0]) <= 4))
    dotted = F.size(words).between(2, 8) & F.forall(words, lambda w: F.length(w) == 1) & F.regexp_like(t, F.lit(r"[^\p{L}\p{N}\s]"))
    return F.when(one, words[0]).when(dotted, F.array_join(words, ""))


def acronym_of(left: Column, right: Column) -> Column:
    """Whether ``left`` is the conservative acronym of ``right``, which needs at least two words (TX11)."""
    return F.coalesce((acronym_key(left) == initials(normalized(right))) & (F.size(tokens(normalized(right))) >= 2), F.lit(False))


def entity_type(x: Column, aliases: dict[str, str]) -> Column:
    """A closed vocabulary through an alias map, else ``unknown`` (TX12)."""
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(table[normalized(x)], F.lit("unknown"))


def claim_text(x: Column) -> Column:
    """Without citation marks, blanks before punctuation and final marks; collapsed, lower case (TX14)."""
    x = F.regexp_replace(x, r"\[E\d+\]", "")
    x = F.regexp_replace(x, r"(?U)\s+([.,;:!?])", "$1")
    return F.regexp_replace(normalized(x), "[.!?]+$", "")


def script_bucket(x: Column) -> Column:
    """The only script of a text, ``mixed`` for several, ``unknown`` for none (TX18)."""
    found = F.array_compact(F.array(*[F.when(F.regexp_like(x, F.lit(p)), F.lit(k)) for k, p in SCRIPTS.items()]))
    return F.when(F.size(found) == 1, found[0]).when(F.size(found) > 1, F.lit("mixed")).otherwise(F.lit("unknown"))


def language_label(x: Column) -> Column:
    """A language's code from an alias, else null (TX19)."""
    table = F.create_map(*[F.lit(v) for code, names in LANGUAGES.items() for name in names for v in (name, code)])
    return table[F.lower(F.trim(x))]


def language_match(a: Column, b: Column) -> Column:
    """Equal labels; null if either is unknown (TX20)."""
    return language_label(a) == language_label(b)


def script_match(a: Column, b: Column) -> Column:
    """Equal scripts that are not mixed; null if either is unknown (TX20)."""
    unknown = (a == "unknown") | (b == "unknown") | a.isNull() | b.isNull()
    return F.when(unknown, F.lit(None).cast("boolean")).otherwise((a == b) & (a != "mixed"))


def interstitial(text: Column, title: Column, markers: list[str]) -> Column:
    """A short page that carries a blocking marker (TX21)."""
    both = F.lower(F.concat_ws(" ", title, text))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(both, F.lit(m))
    return hit & (F.length(text) < 700)


def think_split(raw: Column) -> dict[str, Column]:
    """reasoning, visible text, and what kind of reasoning block there was (TX23)."""
    low = F.lower(raw)
    opened, closed = F.locate("<think>", low), F.locate("</think>", low)
    state = F.when((opened > 0) & (closed > opened), "complete").when((closed > 0) & (opened == 0), "closing_only").when(opened > 0, "truncated").otherwise("none")
    inside = F.trim(F.when(state == "complete", F.regexp_extract(raw, r"(?is)<think>(.*?)</think>", 1)).when(state == "closing_only", F.regexp_extract(raw, r"(?is)^(.*?)</think>", 1)).when(state == "truncated", F.regexp_extract(raw, r"(?is)<think>(.*)$", 1)).otherwise(F.lit("")))
    seen = F.trim(F.when(state == "complete", F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")).when(state == "closing_only", F.regexp_replace(raw, r"(?is)^.*?</think>", "")).when(state == "truncated", F.regexp_extract(raw, r"(?is)^(.*?)<think>", 1)).otherwise(raw))
    return {"thinking_state": state, "reasoning": inside, "visible": seen}


def json_object(raw: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, or null (TX25)."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def citations(x: Column) -> Column:
    """All ``[E<n>]`` marks' ids in order (TX27)."""
    return F.regexp_extract_all(x, F.lit(r"\[(E[1-9][0-9]*)\]"), F.lit(1))


def safe_abstention(x: Column) -> Column:
    """Whether a text is an approved abstention, whatever its blanks and end marks, and cites nothing (TX28); null does not."""
    tail = f"[{END_MARKS}]+$"
    approved = [re.sub(tail, "", " ".join(unicodedata.normalize("NFKC", a).split())) for a in ABSTENTIONS]
    plain = F.regexp_replace(collapse(optional_text(x)), tail, "")
    return F.coalesce(plain.isin(approved) & (F.size(citations(x)) == 0), F.lit(False))


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow (TX29)."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def score_status(x: Column) -> Column:
    """missing, invalid, nonfinite or valid, of a score kept as text (TX30)."""
    v = x.try_cast("double")
    return F.when(x.isNull() | (F.trim(x) == ""), "missing").when(v.isNull(), "invalid").when(F.isnan(v) | (F.abs(v) == float("inf")), "nonfinite").otherwise("valid")


def invalid_id(x: Column) -> Column:
    """Null, blank or a non-finite number (TX31)."""
    return x.isNull() | (F.trim(x) == "") | F.lower(F.trim(x)).isin("nan", "inf", "-inf", "infinity", "-infinity")


def document_title(path: Column, prefix: Column) -> Column:
    """The file's stem without its source prefix, underscores as blanks (TX32)."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    cut = F.when(F.startswith(stem, F.concat(prefix, F.lit("_"))), F.substr(stem, F.length(prefix) + 2)).otherwise(stem)
    return F.trim(F.translate(cut, "_", " "))


def metric_envelope(value: Column, status: Column, reason: Column) -> Column:
    """value, status, reason; a scored value that is not finite becomes ``invalid_score`` (TX34)."""
    bad = (status == "scored") & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
    return F.struct(F.when(~bad & (status == "scored"), value).alias("value"), F.when(bad, "invalid_score").otherwise(status).alias("status"), F.when(bad, "nonfinite_metric_value").otherwise(reason).alias("reason"))
