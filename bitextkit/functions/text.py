"""Text column expressions.

Everything here is a native Catalyst expression (regexp_replace, translate,
split, higher-order array functions), so it stays inside whole-stage codegen
and runs identically on a batch or a streaming DataFrame.

Whitespace: Java's ``\\s`` is ASCII-only and ``(?U)\\s`` still misses
U+001C..U+001F, so Python's notion of whitespace (``str.split()``,
``str.strip()``, ``re`` ``\\s``) is spelled out as an explicit class.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The set of characters Python treats as whitespace (str.isspace)
# on the BMP, written as a Java regex class: single Latin-1 characters are one bit
# table, and other characters meet one range before the list.
WS_CLASS = ("[\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f\\x20\\x85\\xa0"
            "[\\u1680-\\u3000&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]]")
NOT_WS = f"[^{WS_CLASS}]"
WS_RUN = WS_CLASS + "+"
ZERO_WIDTH_SPACE = "\u200b"

# ASCII punctuation as in Python's string.punctuation
# (!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~), as a Java regex class.
PUNCT_CLASS = "[" + "".join(f"\\x{c:02x}" for c in range(0x21, 0x7f) if not chr(c).isalnum()) + "]"

# The 13a tokeniser of mteval-v13a / sacrebleu, in application order.
TOK13A_PUNCT = "([" + "".join(f"\\x{c:02x}" for c in range(0x20, 0x7f) if not chr(c).isalnum() and chr(c) not in "',-.") + "])"
TOK13A_RULES = [
    (TOK13A_PUNCT, " $1 "),                 # tokenize punctuation
    ("([^0-9])([\\.,])", "$1 $2 "),          # period/comma unless preceded by a digit
    ("([\\.,])([^0-9])", " $1 $2"),          # period/comma unless followed by a digit
    ("([0-9])(-)", "$1 $2 "),                # dash when preceded by a digit
]
# Literal replacements done by 13a before the regexes.
TOK13A_LITERALS = [
    ("<skipped>", ""), ("-\n", ""), ("\n", " "),
    ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Remove leading/trailing whitespace (Python ``str.strip()``)."""
    return F.regexp_replace(_c(col), f"^{WS_RUN}|{WS_RUN}$", "")


def rstrip_ws(col) -> Column:
    return F.regexp_replace(_c(col), f"{WS_RUN}$", "")


def collapse_ws(col, repl: str = " ") -> Column:
    return F.regexp_replace(_c(col), WS_RUN, repl)


def _strip_chars(col, chars_class: str) -> Column:
    return F.regexp_replace(col, f"^{chars_class}+|{chars_class}+$", "")


def norm_text(col) -> Column:
    """P01 (corpus cleaner): null -> '', U+200B -> space, collapse whitespace,
    strip, strip all ``"`` then all ``'`` (no re-strip afterwards)."""
    x = F.coalesce(_c(col).cast("string"), F.lit(""))
    x = F.replace(x, F.lit(ZERO_WIDTH_SPACE), F.lit(" "))
    x = F.btrim(collapse_ws(x))
    return F.btrim(F.btrim(x, F.lit('"')), F.lit("'"))


def clean_text(col, quotes: str = "mixed") -> Column:
    """Strip whitespace, strip quotes, then collapse whitespace.

    ``quotes="mixed"`` strips any run of ``"`` and ``'`` together (stage-1 /
    stage-2 generators); ``quotes="sequential"`` strips ``"`` and then ``'``
    (full-clean generator).  Collapsing last may leave an edge space.
    """
    x = F.coalesce(_c(col).cast("string"), F.lit(""))
    x = strip_ws(x)
    if quotes == "mixed":
        x = _strip_chars(x, "[\"']")
    elif quotes == "sequential":
        x = _strip_chars(x, '"')
        x = _strip_chars(x, "'")
    else:
        raise ValueError(f"quotes must be 'mixed' or 'sequential', got {quotes!r}")
    return collapse_ws(x)


def normalize_for_bleu(col) -> Column:
    """Strip, lower-case, collapse whitespace, `` .`` -> ``.``, `` ,`` -> ``,``."""
    x = F.lower(strip_ws(_c(col)))
    x = collapse_ws(x)
    x = F.replace(x, F.lit(" ."), F.lit("."))
    return F.replace(x, F.lit(" ,"), F.lit(","))


def add_prompt(col, src_lang: str, tgt_lang: str) -> Column:
    """Task prefix ``translate {A} to {B}: `` + text."""
    return F.concat(F.lit(prompt_prefix(src_lang, tgt_lang)), _c(col))


def prompt_prefix(src_lang: str, tgt_lang: str) -> str:
    return f"translate {src_lang} to {tgt_lang}: "


def latin_share(col) -> Column:
    """Share of ASCII letters in the string (0 for the empty string)."""
    x = _c(col)
    latin = F.length(x) - F.length(F.regexp_replace(x, "[A-Za-z]", ""))
    return latin.cast("double") / F.greatest(F.length(x), F.lit(1)).cast("double")


def heavy_latin(col, max_share: float = 0.25) -> Column:
    """F06 predicate: non-empty and Latin share strictly above ``max_share``."""
    x = _c(col)
    return (F.length(x) > 0) & (latin_share(x) > F.lit(float(max_share)))


def has_artifact(col) -> Column:
    """Contains a brace or a run of at least four dots."""
    x = _c(col)
    return x.contains("{") | x.contains("}") | x.contains("....")


def length_ratio(src, tgt) -> Column:
    """P10: (len(src)+1) / (len(tgt)+1) in code points, as a double."""
    return (F.length(_c(src)) + 1).cast("double") / (F.length(_c(tgt)) + 1).cast("double")


def direction_of(col, src_lang: str, tgt_lang: str, rule: str = "substring") -> Column:
    """Direction of a prompt.

    ``substring``: contains ``A to B`` -> src2tgt, else contains ``B to A`` ->
    tgt2src, else NULL (first test wins).
    ``prefix``: lower-cased text contains ``translate a to b:`` -> src2tgt,
    everything else tgt2src.
    ``stored``: the column already holds a direction; NULL/empty -> ``unknown``.
    """
    x = _c(col)
    if rule == "substring":
        return (F.when(x.contains(f"{src_lang} to {tgt_lang}"), F.lit("src2tgt"))
                 .when(x.contains(f"{tgt_lang} to {src_lang}"), F.lit("tgt2src")))
    if rule == "prefix":
        key = f"translate {src_lang.lower()} to {tgt_lang.lower()}:"
        return F.when(F.lower(x).contains(key), F.lit("src2tgt")).otherwise(F.lit("tgt2src"))
    if rule == "stored":
        return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))
    raise ValueError(f"unknown direction rule {rule!r}")


def ws_tokens(col) -> Column:
    """Python ``str.split()`` as an array (no empty tokens)."""
    return F.array_remove(F.split(_c(col), WS_RUN), "")


def tokenize_13a(col) -> Column:
    """13a word tokens (array<string>) as used by corpus BLEU."""
    text = F.coalesce(_c(col), F.lit(""))
    x = rstrip_ws(text)
    for a, b in TOK13A_LITERALS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pattern, repl in TOK13A_RULES:
        x = F.regexp_replace(x, pattern, repl)
    # without a punctuation mark the rules change white space only
    return ws_tokens(F.when(text.rlike(PUNCT_CLASS), x).otherwise(text))


def chrf_chars(col) -> Column:
    """P13 (character side): the sentence with all whitespace removed."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), WS_RUN, "")


def chrf_words(col) -> Column:
    """P13 (word side): whitespace tokens with one edge punctuation mark split
    off (trailing first, else leading); single characters stay whole."""
    # one pass over the text: blanks around a mark that ends a word of several
    # characters, or that begins one which does not end with a mark
    inner = f"(?<={NOT_WS}{PUNCT_CLASS})"
    ends, rest = f"(?={WS_CLASS}|\\z)", f"(?={NOT_WS}*[^{WS_CLASS}{PUNCT_CLASS}](?:{WS_CLASS}|\\z))"
    mark = f"{PUNCT_CLASS}(?:{inner}{ends}|(?<!{NOT_WS}{PUNCT_CLASS}){rest})"
    return ws_tokens(F.regexp_replace(F.coalesce(_c(col), F.lit("")), mark, " $0 "))


# ------------------------------------------------------------ the same units of a Python string, for tasks that meet a word once

_PY_PUNCT = frozenset(string.punctuation)
_PY_HAS_PUNCT = re.compile(PUNCT_CLASS)
_PY_TOK13A_RULES = [(re.compile(p), r.replace("$", "\\")) for p, r in TOK13A_RULES]


def py_tokenize_13a(text: str) -> list[str]:
    """P12 of a string.  Without a newline the tokens of a text are those of its
    words, one after another: no rule looks beyond white space but ``-\\n``."""
    if not _PY_HAS_PUNCT.search(text):
        return text.split()
    x = text.rstrip()
    for a, b in TOK13A_LITERALS:
        x = x.replace(a, b)
    x = f" {x} "
    for pattern, repl in _PY_TOK13A_RULES:
        x = pattern.sub(repl, x)
    return x.split()


def py_chrf_chars(text: str) -> str:
    """P13 (character side) of a string."""
    return "".join(text.split())


def py_chrf_words(text: str) -> list[str]:
    """P13 (word side) of a string."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PY_PUNCT:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PY_PUNCT:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out
