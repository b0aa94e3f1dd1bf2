"""Text clean-up as Spark column expressions.

Each public function takes a string ``Column`` and returns a ``Column``; nulls stay null. The
regular expressions find the same matches as their textbook forms but are written so that the
JVM matcher runs in linear time and constant stack on hostile input (a megabyte of spaces, a
host name of ten thousand labels): possessive runs anchored by a look-behind instead of a run
retried from each of its characters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv

# \s of a Unicode-aware matcher plus the four separators the JVM leaves out.
_SPACE = r"\s\x1c-\x1f"
_LOCAL = "a-zA-Z0-9._%+-"

# fixed patterns -----------------------------------------------------------------
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}"
URL = (
    r"(?U)(?:https?://|www\.|ftp\.)"
    r"((?!\.)(?:(?!\.\.)[a-zA-Z0-9.-])*\.[a-zA-Z]{2,63})"
    rf"(?::[0-9]+)?(?:[/?#][^{_SPACE}()]*)?"
)
TABLE_BORDER = rf"(?U)(?:(?<![{_SPACE}])|\G)[{_SPACE}]*+\+-+(?:\+-+)?\+[{_SPACE}]*"
ESCAPED_BAR = r"\\ *\|"
EMPTY_ROW = r"\n\|[ |]*\|\n"
REPEATED = r'([,!?;:\-><#*+=|"])\1+'
SPACES = r" {2,}"
NEWLINES = r"\n{2,}"
BLANK_LINE = r" *\n +\n"


def _literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def strip(c: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(fv.WHITESPACE))


def _rewrite(c: Column, pattern: str, replacement: str, *signs: str) -> Column:
    """Regular expression replacement, tried only on values that hold one of ``signs``.

    Most values need few rewrites, and a substring test costs a fraction of an expression that
    finds nothing. Test and rewrite both read the value, so it is bound to a name, as the element
    of a one-element array: written out twice, the value's own expression would double with every
    rewrite of a chain wherever the optimiser inlines it.
    """

    def changed(v: Column) -> Column:
        present = F.contains(v, F.lit(signs[0]))
        for sign in signs[1:]:
            present = present | F.contains(v, F.lit(sign))
        return F.when(present, F.regexp_replace(v, pattern, replacement)).otherwise(v)

    return F.get(F.transform(F.array(c), changed), F.lit(0))


def mask_emails(c: Column, mask: str | None = fv.EMAIL_MASK) -> Column:
    """Replace e-mail addresses by ``mask`` (taken literally); a falsy mask changes nothing."""
    return _rewrite(c, EMAIL, _literal_replacement(mask), "@") if mask else c


def mask_urls(c: Column, mask: str | None = fv.URL_MASK) -> Column:
    """Reduce links to their host followed by ``mask``; a falsy mask changes nothing."""
    if not mask:
        return c
    return _rewrite(c, URL, "$1 " + _literal_replacement(mask), "://", "www.", "ftp.")


def tables_to_text(c: Column) -> Column:
    """Remove drawn table borders, escaped bars and empty table rows."""
    c = _rewrite(c, TABLE_BORDER, "\n", "+-")
    c = _rewrite(c, ESCAPED_BAR, " |", "\\")
    return _rewrite(c, EMPTY_ROW, "\n", "\n|")


def cut_section(c: Column, header: str | None) -> Column:
    """Keep what precedes the first ``header``, stripped; a falsy header changes nothing."""
    return strip(F.substring_index(c, header, 1)) if header else c


def collapse_punctuation(c: Column) -> Column:
    """Collapse runs of one repeated punctuation mark, then strip."""
    return strip(F.regexp_replace(c, REPEATED, "$1"))


def squeeze_whitespace(c: Column) -> Column:
    """Collapse runs of spaces and of newlines, drop blank lines, strip. Tabs are kept."""
    c = _rewrite(c, SPACES, " ", "  ")
    c = _rewrite(c, NEWLINES, "\n", "\n\n")
    return strip(_rewrite(c, BLANK_LINE, "\n", "\n "))


def symbol_to_word(c: Column, symbol: str | None, word: str | None) -> Column:
    """Replace every literal ``symbol`` by ``word``; a missing one changes nothing."""
    if not symbol or word is None:
        return c
    return F.replace(c, F.lit(symbol), F.lit(word))


def second_segment(c: Column) -> Column:
    """Second ``;``-separated part, stripped; null when there is none."""
    return strip(F.get(F.split(c, ";"), F.lit(1)))


def clean_question(c: Column) -> Column:
    """Strip, remove the first matching question opening, strip again."""
    openings = "|".join(fv.QUESTION_OPENINGS)
    return strip(F.regexp_replace(strip(c), f"(?i)^(?:{openings})", ""))


def keyword_tokens(c: Column) -> Column:
    """Lower-cased white-space separated tokens, none of them empty."""
    parts = F.split(F.lower(c), rf"(?U)[{_SPACE}]+")
    return F.array_remove(parts, F.lit(""))


def split_list(c: Column) -> Column:
    """Comma separated text to an array of stripped items; null gives an empty array."""
    items = F.transform(F.split(c, ","), strip)
    return F.coalesce(items, F.array().cast("array<string>"))


# --- the normalisation chain ------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """A named stage of the chain."""

    name: str
    apply: Callable[[Column], Column]


@dataclass(frozen=True)
class LanguageConfig:
    """What the chain needs to know about one language."""

    section_header: str | None = None
    symbol_words: Sequence[tuple[str | None, str | None]] = field(default_factory=tuple)


DEFAULT_LANGUAGES = {
    lang: LanguageConfig(fv.SECTION_HEADER[lang], tuple(fv.SYMBOL_WORDS[lang]))
    for lang in fv.SECTION_HEADER
}


def chain(config: LanguageConfig) -> list[Step]:
    """Steps of the normalisation chain, in order.

    Sections, links, addresses, symbols, tables, punctuation, white space. The order matters:
    links go before addresses because a link's host may follow an ``@``.
    """
    header = config.section_header
    sections = [Step("cut_section", lambda c: cut_section(c, header))] if header else []
    symbols = [
        Step(f"symbol_{symbol}", lambda c, s=symbol, w=word: symbol_to_word(c, s, w))
        for symbol, word in config.symbol_words
    ]
    return [
        *sections,
        Step("mask_urls", mask_urls),
        Step("mask_emails", mask_emails),
        *symbols,
        Step("tables_to_text", tables_to_text),
        Step("collapse_punctuation", collapse_punctuation),
        Step("squeeze_whitespace", squeeze_whitespace),
    ]


def normalize(c: Column, config: LanguageConfig) -> Column:
    """The whole chain as one expression."""
    for step in chain(config):
        c = step.apply(c)
    return c
