"""Tolerant reading of JSON that a model wrote.

The built-in parser is asked first, on the text as it is and on its outermost braces; only rows that
neither helps reach :func:`mend`, a vectorised UDF that puts in what is missing (commas, colons, values,
quotes, brackets) and leaves out what isn't JSON (comments, ellipses, trailing commas).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import blank, col, let

LOOSE = "map<string,string>"
_NUMBER = r"-?\d+(?:\.\d+)?"
_BOX = r'("bbox"\s*:\s*\{\s*)"x1"\s*:\s*(' + _NUMBER + r")\s*,\s*(" + _NUMBER + r")\s*,\s*(" + _NUMBER + r")\s*,\s*(" + _NUMBER + r")\s*\}"


def without_fence(x) -> Column:
    """The text without a fence around it; texts without one aren't searched for it by expression."""
    v = F.regexp_replace(F.trim(blank(x)), r"^```(?:json|JSON)?\s*", "")
    return F.when(col(x).contains("```"), F.trim(F.regexp_replace(v, r"\s*```$", ""))).otherwise(F.trim(blank(x)))


def name_box(x) -> Column:
    """``{"x1": a, b, c, d}`` gets the names of all four sides."""
    return F.when(col(x).contains('"bbox"'), F.regexp_replace(col(x), _BOX, r'$1"x1": $2, "y1": $3, "x2": $4, "y2": $5}')).otherwise(col(x))


def outer_braces(x) -> Column:
    return F.nullif(F.regexp_extract(col(x), r"(?s)\{.*\}", 0), F.lit(""))


#: Quotes that may open a text, with those that may close it.
_QUOTES = {'"': '"', "'": "'", "\u201c": "\u201d\u201c\"", "\u201d": "\u201d\"", "\u2018": "\u2019'", "\u2019": "\u2019'"}
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None, "nan": None}
_GAP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*|\.\.\.|\u2026)+", re.S)
_NUMERAL = re.compile(r"[-+]?(?:(?:0|[1-9]\d*)(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?(?=[\s,}\]/]|\Z)")
_BARE_NAME = re.compile(r"[^\s:,{}\[\]\"']+")
_BARE_VALUE = re.compile(r"(?:(?!\s+[\w$]+\s*:)[^,{}\[\]\n])+")
#: Characters of a quoted text that stand for themselves and can't end it.
_PLAIN = re.compile("[^\"\\\\\x00-\x1f'\u201c\u201d\u2018\u2019]+")
_DECODER = json.JSONDecoder(parse_constant=lambda _: None)
#: What may follow the quote that ends a value: the end, a bracket, a comma before something that can be an item, or an item whose comma is missing.
_AFTER = re.compile(
    r"""\s*(?:\Z|[}\]]|//|/\*|,\s*(?:["'\u201c\u2018{\[}\]\d+-]|//|/\*|\.\.\.|\u2026|\Z|[\w$]+\s*:|[^"'\n,}\]]*[,}\]])|["'\u201c\u2018][^"'\n:]*["'\u201d\u2019]\s*[:,}\]"']|[\w$]+\s*:)"""
)


def _quoted(s: str, i: int, name: bool) -> tuple[str, int]:
    """The text that opens at ``i``, and where it ends: quotes inside it are part of it unless what follows can follow a text."""
    ends, body, j = _QUOTES[s[i]], [], i + 1
    while j < len(s):
        run = _PLAIN.match(s, j)
        if run:
            body.append(run[0])
            j = run.end()
            continue
        c = s[j]
        if c in ends and (name or _AFTER.match(s, j + 1)):
            break
        if c == "\\" and j + 1 < len(s):
            if s[j + 1] in '"\\/bfnrt' or re.match(r"u[0-9a-fA-F]{4}", s[j + 1 : j + 6]):
                body.append(s[j : j + 2])
                j += 2
                continue
            if s[j + 1] in "'`":
                body.append(s[j + 1])
                j += 2
                continue
        body.append(json.dumps(c, ensure_ascii=False)[1:-1])
        j += 1
    return json.loads('"' + "".join(body) + '"'), j + 1


def _scalar(s: str, i: int, name: bool):
    """What isn't a bracket, at ``i``, and where it ends."""
    if s[i] in _QUOTES:
        return _quoted(s, i, name)
    number = _NUMERAL.match(s, i)
    if not name and number:
        text = number[0].lstrip("+")
        value = int(text) if text.lstrip("-").isdigit() and len(text) < 1000 else float(text)
        if value not in (float("inf"), float("-inf")):
            return value, number.end()
    found = (_BARE_NAME if name else _BARE_VALUE).match(s, i)
    if not found:
        return "", i + 1
    text = found[0].strip()
    return (text if name else _WORDS.get(text.lower(), text)), found.end()


def _written(value) -> str:
    """JSON text that has a UTF-8 form: halves of surrogate pairs are question marks."""
    return json.dumps(value, ensure_ascii=False).encode("utf-8", "replace").decode()


def mend_text(s: str | None) -> str | None:
    """A JSON object or array made of ``s``, or None; sound JSON keeps what it says.

    A stack holds the open containers and, for an object, the name that waits for its value. What is missing
    (commas, colons, values, quotes, closing brackets) is put in where the next piece can't stand without it;
    comments and ellipses are left out, words for true, false and null may be in any case.
    """
    start = min([i for i in ((s or "").find("{"), (s or "").find("[")) if i >= 0], default=-1)
    if start < 0:
        return None
    try:
        return _written(_DECODER.raw_decode(s, start)[0])
    except (ValueError, RecursionError):
        pass
    none = object()
    stack: list[list] = []  # container, name that waits
    i, n, root = start, len(s), None

    def put(value) -> None:
        if not stack:
            return
        top = stack[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        else:
            top[0]["" if top[1] is none else top[1]] = value
            top[1] = none

    def close() -> None:
        box_, waits = stack.pop()
        if waits is not none:
            box_[waits] = None

    while i < n:
        gap = _GAP.match(s, i)
        if gap:
            i = gap.end()
            continue
        c = s[i]
        if c in "{[":
            made = {} if c == "{" else []
            put(made)
            root = made if root is None else root
            stack.append([made, none])
            i += 1
        elif c in "}]":
            kind = dict if c == "}" else list
            i += 1
            if any(isinstance(x[0], kind) for x in stack):
                while not isinstance(stack[-1][0], kind):
                    close()
                close()
            if not stack:
                break
        elif c in ",:":
            if c == "," and stack[-1][1] is not none:
                put(None)
            i += 1
        else:
            top = stack[-1]
            name = isinstance(top[0], dict) and top[1] is none
            value, i = _scalar(s, i, name)
            if name:
                top[1] = value
            else:
                put(value)
    while stack:
        close()
    try:
        return _written(root)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def mend(x: pd.Series) -> pd.Series:
    return x.map(mend_text)


def is_object(x: Column) -> Column:
    """Whether the built-in parser takes the text for an object."""
    return F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{")


def sound_object(a: Column) -> Column:
    """The text if it is an object, else its outermost braces if these are one, else null."""
    return F.when(is_object(a), a).otherwise(let(outer_braces(a), lambda b: F.when(is_object(b), b)))


def object_text(x, repair: bool = True) -> Column:
    """The text of the object in a model's answer, or null."""
    first, sound = name_box(without_fence(x)), sound_object
    if not repair:
        return let(first, sound)
    tried = let(first, lambda a: F.struct(sound(a).alias("sound"), F.coalesce(outer_braces(a), a).alias("rest")))
    return F.coalesce(tried["sound"], mend(F.when(tried["sound"].isNull(), tried["rest"])))


def layout_object(x) -> Column:
    """The object of a layout answer: its outermost braces, once more without boxes if they can't be read; null if that fails too."""
    outer = outer_braces(name_box(without_fence(x)))
    bare = F.regexp_replace(outer, r'"bbox"\s*:\s*\{[^{}]*\}?\s*,?', "")
    bare = F.regexp_replace(bare, r",(\s*[}\]])", "$1")
    return F.when(is_object(outer), outer).when(is_object(bare), bare)


def members(x) -> Column:
    """An object's members, each as text: strings as they are, the rest as JSON."""
    return F.from_json(col(x), LOOSE)


def as_array(x) -> Column:
    """Anything to an array of texts: null is empty, an object its values, a scalar itself."""
    v = F.ltrim(col(x))
    none = F.array().cast("array<string>")
    return (
        F.when(col(x).isNull(), none)
        .when(v.startswith("["), F.coalesce(F.from_json(col(x), "array<string>"), F.array(col(x))))
        .when(v.startswith("{"), F.coalesce(F.map_values(members(x)), F.array(col(x))))
        .otherwise(F.array(col(x)))
    )


def object_or_raw(x) -> Column:
    """An object's members, or ``_raw`` with the text where there is none."""
    return F.coalesce(members(object_text(x, repair=False)), F.create_map(F.lit("_raw"), blank(x)))


def text_or_raw(x) -> Column:
    """JSON text as it is, anything else under ``raw_text``."""
    return F.when(F.try_parse_json(col(x)).isNotNull(), col(x)).otherwise(F.to_json(F.struct(blank(x).alias("raw_text"))))


def box(m: Column) -> Column:
    """``x1, y1, x2, y2`` of a box object, also given as ``x, y, w, h``; null unless the far corner is known."""
    num = lambda k: F.try_cast(m[k], "double") if hasattr(F, "try_cast") else m[k].try_cast("double")
    x1, y1 = F.coalesce(num("x1"), num("x"), F.lit(0.0)), F.coalesce(num("y1"), num("y"), F.lit(0.0))
    x2, y2 = F.coalesce(num("x2"), x1 + num("w")), F.coalesce(num("y2"), y1 + num("h"))
    return F.when(m.isNotNull() & x2.isNotNull() & y2.isNotNull(), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
