"""SQL fragments (DuckDB dialect) mirroring the column expressions of
``bitextkit.functions``.  Used only to build the independent oracle queries;
the engine itself never parses SQL text.

RE2 spells code points as ``\\x{..}`` and replacement groups as ``\\1``;
``regexp_replace`` needs the ``'g'`` flag to replace every match.
"""

from __future__ import annotations

from bitextkit.plans.fixtures import LATIN_LETTERS, DEVANAGARI_MAP

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WSR = WS + "+"
PUNCT = r"[!-/:-@\[-`{-~]"
TOK13A_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]
# (search, replacement) as SQL expressions, in application order.
TOK13A_LITERALS = [
    ("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"),
    ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"),
]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def strip_ws(x: str) -> str:
    return rr(x, f"^{WSR}|{WSR}$", "")


def norm_text(x: str) -> str:
    y = f"replace(coalesce(CAST({x} AS VARCHAR), ''), chr(8203), ' ')"
    y = rr(y, WSR, " ")
    y = rr(y, "^ | $", "")
    y = rr(y, '^"+|"+$', "")
    y = rr(y, "^'+|'+$", "")
    return y


def clean_text(x: str, quotes: str = "mixed") -> str:
    y = strip_ws(f"coalesce(CAST({x} AS VARCHAR), '')")
    if quotes == "mixed":
        y = rr(y, "^[\"']+|[\"']+$", "")
    else:
        y = rr(y, '^"+|"+$', "")
        y = rr(y, "^'+|'+$", "")
    return rr(y, WSR, " ")


def normalize_for_bleu(x: str) -> str:
    y = f"lower({strip_ws(x)})"
    y = rr(y, WSR, " ")
    return f"replace(replace({y}, ' .', '.'), ' ,', ',')"


def latin_share(x: str) -> str:
    return (f"((length({x}) - length(regexp_replace({x}, '[A-Za-z]', '', 'g')))::DOUBLE"
            f" / greatest(length({x}), 1)::DOUBLE)")


def heavy_latin(x: str, max_share: float = 0.25) -> str:
    return f"(length({x}) > 0 AND {latin_share(x)} > {float(max_share)!r}::DOUBLE)"


def has_artifact(x: str) -> str:
    return f"(regexp_matches({x}, '[{{}}]') OR regexp_matches({x}, '\\.{{4,}}'))"


def length_ratio(s: str, t: str) -> str:
    return f"((length({s}) + 1)::DOUBLE / (length({t}) + 1)::DOUBLE)"


def ratio_outlier(s: str, t: str, r: float = 2.5) -> str:
    lr = length_ratio(s, t)
    return f"(NOT ({lr} <= {float(r)!r}::DOUBLE AND {lr} >= {1.0 / float(r)!r}::DOUBLE))"


def pre_fail(s: str = "src", t: str = "tgt", min_chars: int = 2) -> str:
    return (f"CASE WHEN {s} = '' OR {t} = '' THEN 'empty' "
            f"WHEN length({s}) < {min_chars} OR length({t}) < {min_chars} THEN 'too_short' "
            f"WHEN {s} = {t} THEN 'identical' END")


def post_fail(s: str = "src", t: str = "tgt", r: float = 2.5, max_latin: float = 0.25) -> str:
    return (f"CASE WHEN {ratio_outlier(s, t, r)} THEN 'length_ratio' "
            f"WHEN {has_artifact(s)} OR {has_artifact(t)} THEN 'artifact' "
            f"WHEN {heavy_latin(s, max_latin)} OR {heavy_latin(t, max_latin)} THEN 'heavy_latin' END")


def translit(x: str) -> str:
    return f"translate({x}, {q(LATIN_LETTERS)}, {q(DEVANAGARI_MAP)})"


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WSR)}), lambda t: t <> '')"


def tokenize_13a(x: str) -> str:
    y = rr(f"coalesce({x}, '')", f"{WSR}$", "")
    for a, b in TOK13A_LITERALS:
        y = f"replace({y}, {a}, {b})"
    y = f"(' ' || {y} || ' ')"
    for pattern, repl in TOK13A_RULES:
        y = rr(y, pattern, repl)
    return ws_tokens(y)


def chrf_chars(x: str) -> str:
    return rr(f"coalesce({x}, '')", WSR, "")


def chrf_words(x: str) -> str:
    w = "w"
    split = (f"CASE WHEN length({w}) = 1 THEN [{w}] "
             f"WHEN regexp_matches(right({w}, 1), {q('^' + PUNCT + '$')}) "
             f"THEN [left({w}, length({w}) - 1), right({w}, 1)] "
             f"WHEN regexp_matches(left({w}, 1), {q('^' + PUNCT + '$')}) "
             f"THEN [left({w}, 1), substring({w}, 2)] ELSE [{w}] END")
    toks = ws_tokens(f"coalesce({x}, '')")
    return f"flatten(list_transform({toks}, lambda {w}: {split}))"
