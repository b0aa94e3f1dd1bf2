"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Every kind has a pattern (leftmost, non-overlapping matches), a validator and a score. Words near a
match, in the ``CONTEXT_CHARS`` characters of the text before it and as many behind it, raise its score;
a span stands if its score reaches ``MIN_SCORE``. The four base kinds stand once their validator agrees.
Added kinds: bank account numbers, confirmed by their remainder modulo 97, and secrets, hexadecimal
strings that need a word such as "token" near them; so all of a short list of secrets share the word in
front of the first.

All patterns are written so that a hostile text takes linear time and constant stack: possessive
where giving back cannot help, and anchored where a run begins, or where the last match ended.
They match what the plain patterns match.

Spans are (start, kind, end, score) with offsets in code points, end exclusive, ordered by start,
then kind as listed. Null and empty texts have none. Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import unused

MIN_SCORE = 0.5
CONTEXT_CHARS = 256  # on each side of a match
NEIGHBOURS = 8  # matches on each side that can lie within; of secrets, the shortest fill it
CONTEXT_BONUS = 0.3
BLOCK = 64
MAX_PART = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[1-9])?+(?:\.|$)){4}$"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _always(hit: Column) -> Column:
    return F.lit(True)


def _ip(hit: Column) -> Column:
    return hit.rlike(MAX_PART)


def _card(hit: Column) -> Column:
    return F.call_function("luhn_check", _digits(hit))


def _phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(10, 15)


def _iban(hit: Column) -> Column:
    """The number modulo 97 is 1, its first four characters moved to the end, A as 10, B as 11, ..."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        digit = code < 65
        return F.when(digit, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.length(plain).between(15, 34) & (rest == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needed: str  # a text without a match of this has none of the kind
    valid: Callable[[Column], Column]
    score: float
    context: str  # words, lower case


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        _always,
        0.7,
        "mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "[0-9]",
        _ip,
        0.6,
        "ip|host|server|address",
    ),
    Kind(
        "card",
        # whole runs of digits with single separators; a run of another length is no match
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
        "[0-9]",
        _card,
        0.6,
        "card|visa|credit|payment",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", _phone, 0.6, "phone|tel|call|mobile|fax"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
        "[0-9]",
        _iban,
        0.6,
        "iban|account|konto|compte|cuenta",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{32,64}+(?![A-Za-z0-9_])",
        "[0-9]",
        _always,
        0.3,
        "token|secret|password|api.?key|bearer",
    ),
)
BASE = ("email", "ip", "card", "phone")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _ends(sizes: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` with a function that gives where part ``i`` of consecutive parts begins.

    Sums within blocks and of blocks, so that many parts do not take the square of their number.
    """
    count = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
    sums = F.transform(
        F.sequence(F.lit(0), count), lambda b: _sum(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    )

    def before(i: Column, bases: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        inside = F.slice(sizes, block * BLOCK + 1, i - block * BLOCK)
        return F.element_at(bases, block + 1) + _sum(inside)

    return _bound(
        sums,
        lambda blocks: _bound(
            F.transform(blocks, lambda _, b: _sum(F.slice(blocks, F.lit(1), b))),
            lambda bases: body(lambda i: before(i, bases)),
        ),
    )


def _spans(kind: Kind, order: int, gaps: Column, hits: Column) -> Column:
    """The confirmed spans of one kind; ``gaps`` is what stands between the hits."""

    def near(i: Column) -> Column:
        """Whether a context word stands around match ``i``: the text there is put together from the
        matches and what is between them, so that no place in a long text is looked up."""
        before = [part for d in range(NEIGHBOURS, 0, -1) for part in (F.get(hits, i - d), F.get(gaps, i - d + 1))]
        behind = [part for d in range(NEIGHBOURS) for part in (F.get(gaps, i + d + 1), F.get(hits, i + d + 1))]
        size = F.lit(CONTEXT_CHARS)
        left = F.right(F.concat_ws("", *[F.right(x, size) for x in before]), size)
        right = F.left(F.concat_ws("", *[F.left(x, size) for x in behind]), size)
        return F.lower(left).rlike(kind.context) | F.lower(right).rlike(kind.context)

    def span(hit: Column, i: Column, start: Column) -> Column:
        start = start + F.length(F.get(gaps, i))
        return F.struct(
            start.alias("start"),
            F.lit(order).alias("order"),
            (start + F.length(hit)).alias("end"),
            F.lit(kind.name).alias("kind"),
            (kind.score + F.when(near(i), CONTEXT_BONUS).otherwise(0.0)).alias("score"),
        )

    sizes = F.transform(hits, lambda h, i: F.length(h) + F.length(F.element_at(gaps, i + 1)))
    spans = _bound(
        sizes,
        lambda of: _ends(
            of,
            lambda begin: F.transform(
                hits,
                lambda h, i: F.when(kind.valid(h), span(h, i, begin(i))),
            ),
        ),
    )
    standing = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    return F.when(F.size(hits) > 0, standing).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.array().cast(
        "array<struct<start:int,order:int,end:int,kind:string,score:double>>"
    )


def find_spans(df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """``df`` with the array column ``to`` of (start, order, end, kind, score), last. A column of that
    name that ``df`` has already stays, and ours gets underscores."""
    whole = F.coalesce(F.col(text), F.lit(""))
    names = unused(df, to, *[f"__{part}{i}" for i in range(len(KINDS)) for part in ("hits", "gaps")])
    found, columns = df, names[1:]
    for kind, name in zip(KINDS, columns[::2]):
        hits = F.when(
            whole.rlike(kind.needed), F.regexp_extract_all(whole, F.lit(kind.pattern), F.lit(0))
        ).otherwise(F.array().cast("array<string>"))
        found = found.withColumn(name, hits)
    for kind, name, own in zip(KINDS, columns[1::2], columns[::2]):
        found = found.withColumn(name, F.when(F.size(own) > 0, F.split(whole, kind.pattern, -1)))
    spans = [
        _spans(k, i, F.col(gaps), F.col(hits))
        for i, (k, hits, gaps) in enumerate(zip(KINDS, columns[::2], columns[1::2]))
    ]
    return found.withColumn(names[0], F.sort_array(F.concat(*spans))).drop(*columns)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
