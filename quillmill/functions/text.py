"""Column functions on text: scripts, guards, LaTeX repair, small string helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code-point ranges of script families. 0x41-0x7A also covers six ASCII punctuation marks.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x007A), ("latin", 0x00C0, 0x024F), ("latin", 0x1E00, 0x1EFF),
    ("el", 0x0370, 0x03FF), ("ru", 0x0400, 0x052F), ("he", 0x0590, 0x05FF),
    ("ar", 0x0600, 0x06FF), ("ar", 0x0750, 0x077F), ("hi", 0x0900, 0x097F),
    ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("ko", 0xAC00, 0xD7AF), ("th", 0x0E00, 0x0E7F),
)
#: Characters that show a missing glyph.
TOFU = "�□▯"
#: Words that begin debug tokens, and operators that end them.
CODE_WORDS = "cfg|bbox|mask|render|train|valid|loss|acc|model"
CODE_OPERATORS = r"==|!=|<=|>=|->|::|=>|&&|\|\||\+=|-=|\*=|/="
_CHAIN = r"(?:[_:.]{1,2}[A-Za-z0-9]+)+"
#: A word may begin here; spelled out, as engines differ in what their word boundaries take for a letter.
_BEGIN = r"(?<![\p{L}\p{N}_])"
CODE_TOKEN = rf"{_BEGIN}(?:(?:{CODE_WORDS}|seed|dpi){_CHAIN}(?:{CODE_OPERATORS})?|[A-Za-z]+{_CHAIN}(?:{CODE_OPERATORS})|(?:{CODE_WORDS})(?:{CODE_OPERATORS}))"
#: Shapes, operators and words that don't belong in a line of running text.
SHAPES = "□▯▢■▪▫◻◼�●○◆◇◾◽◦"
MATH_SIGNS = "∑∏∂∇∞≈≠≤≥±÷×∪∩↔←→"
NOISE_WORDS = "DATA|MODEL|TEMPOR|DOLOR|INCIDIDUNT|ACCURACY|VALID|TRAIN|LOSS"
NOISE_SIGNS = "{}[]<>|%$#@&*~^"
#: Lines of these characters only can be unfit for one of the words alone.
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ſ.,;'\"()?! -]*$"
#: Beginnings of LaTeX expressions that lack their backslash.
LATEX_BEGINNINGS = ("sum_", "sum{", "int_", "int{", "sqrt", "frac", "alpha", "beta", "gamma", "theta", "lambda", "mu", "sigma")
#: LaTeX commands that reach files, the shell or other packages; so do document boundaries.
LATEX_DENIED = ("write18", "input", "include", "openout", "read", "write", "catcode", "csname", "newread", "newwrite", "usepackage", "documentclass")


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def script_family(char: Column) -> Column:
    """The script family of a character; null outside all ranges."""
    cp = F.ascii(char)
    return reduce(lambda acc, r: acc.when(cp.between(r[1], r[2]), r[0]), SCRIPT_RANGES[1:], F.when(cp.between(*SCRIPT_RANGES[0][1:]), SCRIPT_RANGES[0][0]))


def script_counts(c: Column) -> Column:
    """An array of family, n (characters) and first (place of its first, from 0) of the script families that a text has.

    Texts without a character from U+0250 on, nearly all of most corpora, are tested for one family only.
    """
    text = F.coalesce(c, F.lit(""))
    names = list(dict.fromkeys(f for f, _, _ in SCRIPT_RANGES))
    high = text.rlike("[^\\x{0}-\\x{24F}]")

    def counted(name: str) -> Column:
        chars = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for f, a, b in SCRIPT_RANGES if f == name)
        n = F.length(F.regexp_replace(text, f"[^{chars}]+", ""))
        return F.struct(F.lit(name).alias("family"), n.cast("long").alias("n"), (F.regexp_instr(text, F.lit(f"[{chars}]")) - 1).alias("first"))

    every = F.when(high, F.array(*map(counted, names))).otherwise(F.array(counted(names[0])))
    return F.filter(every, lambda x: x["n"] > 0)


def has_tofu(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{TOFU}]"), F.lit(False))


def code_tokens(c: Column) -> Column:
    """Number of debug-like tokens. A full stop alone, the one sign that running text has, counts only inside a word."""
    maybe = c.rlike(r"[_:=<>&|!]|\.[A-Za-z0-9.]")
    return F.when(maybe, F.regexp_count(c, F.lit(CODE_TOKEN))).otherwise(F.lit(0))


def is_noisy(c: Column) -> Column:
    """Whether a line is unfit for recognition: blank, shapes, symbols, code, digits inside words, or over 3 % signs."""
    text = F.coalesce(c, F.lit(""))
    length = F.length(text)
    visible = F.length(F.translate(text, " \t\n\r\x0b\f", ""))
    signs = length - F.length(F.translate(text, MATH_SIGNS + NOISE_SIGNS, ""))
    upper = F.upper(text)
    words = reduce(lambda a, b: a | b, (F.contains(upper, F.lit(w)) for w in NOISE_WORDS.split("|")))
    unusual = (
        text.rlike(f"[{SHAPES}]")
        | text.rlike(r"[\p{So}\p{Co}\p{Cc}\p{Cs}]")
        | text.rlike(r"__|::|==|!=|\+=|-=|[<>{}\[\]|]")
        | text.rlike(r"[A-Za-zÀ-ſ]{2,}\d+[A-Za-zÀ-ſ0-9]+")
        | text.rlike(f"[{MATH_SIGNS}]{{2,}}")
        | text.rlike(r"(?<![\p{L}\p{N}_])[A-Za-zÀ-ſА-Яа-я]+[0-9]+[A-Za-zÀ-ſА-Яа-я0-9]*(?![\p{L}\p{N}_])")
        | F.coalesce(F.try_divide(signs, visible) > 0.03, F.lit(False))
    )
    return ~text.rlike(r"\S") | words | (~text.rlike(_PLAIN) & unusual)


def latex_normalise(c: Column) -> Column:
    """Puts back the backslash that a known beginning lacks."""
    text = strip(F.coalesce(c, F.lit("")))
    known = reduce(lambda a, b: a | b, [text.startswith(p) for p in LATEX_BEGINNINGS])
    return F.when(known, F.concat(F.lit("\\"), text)).otherwise(text)


def latex_denied(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)\\(?:" + "|".join(LATEX_DENIED) + r")\b|(?i)\\(?:begin|end)\s*\{\s*document\s*\}"), F.lit(False))


def latex_sanitise(c: Column) -> Column:
    """One line; null if empty or if it has a denied command."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when((text == "") | latex_denied(text), F.lit(None)).otherwise(F.regexp_replace(text, r"\r\n|\n|\r", " "))


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def safe_name(c: Column) -> Column:
    """A file name: every character but ASCII letters, digits, ``-_.`` becomes ``_``."""
    return F.regexp_replace(strip(c), r"[^A-Za-z0-9\-_.]", "_")


def fit_words(c: Column, width: Column, per_char: int = 10, least: int = 4) -> Column:
    """The longest beginning of whole words that fits a pixel width; empty under ``least`` characters."""
    words = F.split(strip(c), r"\s+")
    add = lambda acc, w: F.when(acc["full"], acc).otherwise(
        F.when(
            F.length(F.concat_ws(" ", F.nullif(acc["text"], F.lit("")), w)) * per_char <= width,
            F.struct(F.concat_ws(" ", F.nullif(acc["text"], F.lit("")), w).alias("text"), F.lit(False).alias("full")),
        ).otherwise(F.struct(acc["text"].alias("text"), F.lit(True).alias("full")))
    )
    kept = F.aggregate(words, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), add, lambda acc: acc["text"])
    return F.when(F.length(kept) >= least, kept).otherwise(F.lit(""))
