"""Text keys, coercions and corrections as Column expressions.

Everything here stays in the JVM but :func:`nfkc`, for which Spark has no built-in function; it is a
vectorised UDF that leaves ASCII rows alone.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"
CONFIDENCES = ("high", "medium", "low")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` made once, however often the body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def blank(x) -> Column:
    """Null counts as the empty string."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def or_(*xs) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(col(x).cast("string"), F.lit("")) for x in xs], F.lit(""))


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def nfkc(x, python: bool = True) -> Column:
    return _nfkc(col(x)) if python else col(x)


def stringify_cell(x) -> Column:
    """White space collapsed and trimmed; null is empty. Objects come as their JSON text already."""
    return F.trim(F.regexp_replace(blank(x), SPACE, " "))


def confidence(x, lower: bool = True) -> Column:
    """``high``, ``medium`` or ``low``; anything else is ``low``. Case matters for first-version pages."""
    c, low = col(x), F.lower(col(x))
    out = F.when(c.isin(*CONFIDENCES), c)
    return (out.when(low.isin(*CONFIDENCES), low) if lower else out).otherwise(F.lit("low"))


def rank_of(c) -> Column:
    return F.when(col(c) == "high", 3).when(col(c) == "medium", 2).otherwise(1)


def comparable(x, python: bool = False) -> Column:
    """Lower case without white space and the marks ``_ . , : ; ' " ( ) [ ] { } | \\ / -``."""
    return F.regexp_replace(F.lower(nfkc(blank(x), python)), r"""(?U)[\s_.,:;'"()\[\]{}|\\/\-]+""", "")


def canonical(x, python: bool = False) -> Column:
    """A column name: the comparable key, other runs as underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(comparable(x, python), r"[^a-z0-9一-鿿]+", "_"), "^_+|_+$", "")


def evidence_key(x, python: bool = False) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(nfkc(blank(x), python)), r"[^\p{L}\p{N}]+", "")


def compact(x) -> Column:
    return F.regexp_replace(blank(x), SPACE, "")


def candidate_key(name, label, value) -> Column:
    return F.concat_ws("|", *[F.lower(blank(v)) for v in (name, label, value)])


def null_words(x) -> Column:
    """Model values that only say there is none become empty."""
    v = F.trim(blank(x))
    return F.when(F.lower(v).isin("null", "undefined", "none", "n/a", "na"), F.lit("")).otherwise(v)


def dashes(x) -> Column:
    return F.replace(col(x), F.lit("/"), F.lit("-"))


def local_datetime(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def path_timestamp(ts) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def sheet_name(x) -> Column:
    r"""Without ``\ / ? * [ ] :``, at most 31 characters."""
    return F.substring(F.regexp_replace(col(x), r"[\\/?*\[\]:]", " "), 1, 31)


def file_base(x) -> Column:
    return F.regexp_replace(col(x), r"[^A-Za-z0-9._一-鿿-]+", "_")


def page_json_name(path, page) -> Column:
    base = F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]+$", "")
    return F.concat(F.lit("pages/"), file_base(base), F.lit("-p"), F.lpad(col(page).cast("string"), 4, "0"), F.lit(".json"))


#: Characters that scanners confuse, by format, and what they are taken for; with ``?`` they stay and are only noted (fixed values).
CONFUSED = {
    "number": {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "T": "7"},
    "date": {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5"},
    "currency": {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5", "B": "8"},
    "id_card": {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2"},
    "phone": {"O": "0", "o": "0", "l": "1", "I": "1"},
    "email": {"O": "0", "o": "0"},
    "text": {
        "S": "E?", "E": "S?", "K": "X?", "X": "K?",
        "D": "O?", "O": "D?", "C": "G?", "G": "C?",
        "B": "8?", "8": "B?",
        "0": "O?", "1": "I?", "2": "Z?", "5": "S?",
        "I": "1?", "l": "1?",
    },
}
#: Words in a format hint that choose the format, in the order of the tests (fixed values).
HINTS = [
    ("date", ("date", "yyyy", "mm-dd")),
    ("currency", ("price", "amount", "currency", "¥", "$")),
    ("id_card", ("id", "identity")),
    ("phone", ("phone", "tel")),
    ("email", ("email", "@")),
    ("number", ("number", "digit")),
    ("text", ("text", "name", "address", "company")),
]


def format_of(hint, kind=None) -> Column:
    """Which format a hint asks for, or ``kind`` says; the first test that either passes.

    Hints are read by substring, so that "width" asks for an identity number.
    """
    h = F.lower(blank(hint))
    given = F.lit("") if kind is None else blank(kind)
    out = F.lit(None).cast("string")
    for name, words in reversed(HINTS):
        out = F.when(reduce(lambda a, b: a | b, [h.contains(w) for w in words], given == name), F.lit(name)).otherwise(out)
    return out


def corrected_characters(value, hint, kind=None) -> Column:
    """``corrected`` and the notes ``corrections``: confused characters by format, white space, punctuation at the ends."""
    v, form = blank(value), format_of(hint, kind)
    dashed = F.when(form == "date", dashes(v)).otherwise(v)
    fixed, noted = dashed, F.array().cast("array<string>")
    for name, table in CONFUSED.items():
        sure = {a: b for a, b in table.items() if not b.endswith("?")}
        if sure:
            fixed = F.when(form == name, F.translate(dashed, "".join(sure), "".join(sure.values()))).otherwise(fixed)
        says = {a: f"'{a}' might be '{b[:-1]}' (uncertain)" if b.endswith("?") else f"'{a}' -> '{b}'" for a, b in table.items()}
        known = F.create_map(*[F.lit(x) for kv in says.items() for x in kv])
        each = F.array_compact(F.transform(F.split(dashed, ""), lambda c: F.try_element_at(known, c)))  # noqa: B023
        noted = F.when(form == name, each).otherwise(noted)
    bare = F.regexp_replace(fixed, r"^[\s﻿ ]+|[\s﻿ ]+$", "")
    clean = F.regexp_replace(bare, r"^[.,;:]+|[.,;:]+$", "")
    notes = F.concat(
        F.array(F.when(dashed != v, F.lit("normalized date separators"))),
        noted,
        F.array(F.when(bare != fixed, F.lit("trimmed whitespace")), F.when(clean != bare, F.lit("removed punctuation artifacts"))),
    )
    return F.struct(clean.alias("corrected"), F.array_compact(notes).alias("corrections"))


def correct_characters(value, hint, kind=None) -> Column:
    """The value of :func:`corrected_characters` without its notes."""
    return corrected_characters(value, hint, kind)["corrected"]


def response_text(text, reasoning) -> Column:
    """The answer, or the reasoning where the answer is 30 characters at most and the reasoning over 200."""
    t, r = blank(text), blank(reasoning)
    return F.when((F.length(t) <= 30) & (F.length(r) > 200), r).otherwise(t)


def ocr_context(texts, most: int = 6000) -> Column:
    joined = F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n")
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("\n...[truncated]"))).otherwise(joined)


#: What names a language in a prompt, and what is asked of one that names none (fixed values).
LANGUAGE_NAMED = "(?i)Traditional Chinese|Chinese|language"
LANGUAGE_HINT = "\nPlease answer in Traditional Chinese when field labels or source text are Chinese."


def enhance_prompt(prompt) -> Column:
    """Ask for the prompt's own script where it is Chinese and names no language."""
    p = blank(prompt)
    named = p.rlike(LANGUAGE_NAMED)
    return F.when(p.rlike("[\u4e00-\u9fff]") & ~named, F.concat(p, F.lit(LANGUAGE_HINT))).otherwise(p)


#: Words by which a prompt is classified (fixed values).
DOCUMENT_PROMPT = "(?i)提取|OCR|識別|掃描|parse|extract|document|表格|table|pdf|markdown|html|qwenvl"
HANDWRITING_PROMPT = "(?i)手寫|手写|handwrit|手書き|cursive|manuscript|手稿|筆跡|笔迹"
FIELD_PROMPT = "(?i)欄位|字段|field|extract.*(value|data|information|detail)|key.*value|structured|json|table.*extract|提取.*欄|擷取.*欄"


def is_document_prompt(x) -> Column:
    return blank(x).rlike(DOCUMENT_PROMPT)


def is_handwriting_prompt(x) -> Column:
    return blank(x).rlike(HANDWRITING_PROMPT)


def is_field_prompt(x) -> Column:
    return blank(x).rlike(FIELD_PROMPT)


def looks_like_label(x) -> Column:
    """2 to 80 characters with a Latin or Chinese letter among them."""
    v = F.trim(blank(x))
    return F.length(v).between(2, 80) & v.rlike("[A-Za-z一-鿿]")


def keyword_score(x, words: list[str]) -> Column:
    v = F.lower(blank(x))
    return reduce(lambda a, b: a + b, [v.contains(w.lower()).cast("int") for w in words], F.lit(0))


def unescape_latex(x) -> Column:
    """A table cell without LaTeX: the rewrites in their fixed order."""
    steps = [
        (r"```[a-zA-Z]*", ""),
        (r"\\\\", " "),
        (r"\\(begin|end)\{[^}]*\}", " "),
        (r"\\hline|\\cline\{[^}]*\}", " "),
        (r"\\textbf\{([^}]*)\}", "$1"),
        (r"\\hspace\{[^}]*\}", " "),
        (r"\\([#&$])", "$1"),
        (SPACE, " "),
    ]
    return F.trim(reduce(lambda v, s: F.regexp_replace(v, s[0], s[1]), steps, blank(x)))
