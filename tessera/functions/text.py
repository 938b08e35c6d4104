"""Column builders: tokens, content words, overlap, numbers, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that define the results.
TOKEN = r"[a-z]+(?:'[a-z]+)?|\d[\d,]*(?:\.\d+)?%?"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
PERIOD = r"(?:19|20)\d{2}"
STOPWORDS = (
    "a an and are as at be been by did for from had has have how in into is it its much of on or record recorded "
    "report reported that the to was were what which with year"
).split()
COMPANY_NOISE = "the inc co corp corporation company group ltd plc".split()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text) -> Column:
    """Words and numbers in lower case; a comma-grouped number without % is followed by its plain form."""
    def parts(x):
        return F.when(x.contains(",") & ~x.endswith("%"), F.array(x, F.replace(x, F.lit(","), F.lit("")))).otherwise(F.array(x))

    return F.flatten(F.transform(found(F.lower(_col(text)), TOKEN), parts))


def approx_tokens(text) -> Column:
    """A quarter of the characters, half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.length(_col(text)) / F.lit(4.0)).cast("int"))


def content_words(text) -> Column:
    words = F.filter(found(F.lower(_col(text)), "[a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOPWORDS)))


def lexical_overlap(query, passage) -> Column:
    q = content_words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_words(passage))) / F.size(q)).otherwise(0.0)


def normalise_number(text) -> Column:
    """The first number in canonical form, negative if the text has both parentheses; null if there is none."""
    text = _col(text)
    value = F.replace(F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), NUMBER, 0), F.lit(","), F.lit(""))
    value = F.when(text.contains("(") & text.contains(")") & ~value.startswith("-"), F.concat(F.lit("-"), value)).otherwise(value)
    plain = F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")
    return F.when(F.regexp_replace(value, "-", "") == "", None).when(value.contains("."), plain).otherwise(value)


def contains_value(answer, expected) -> Column:
    """Whether any number of the answer equals the expected one (negated, where the answer has both parentheses)."""
    clean = F.replace(_col(answer), F.lit(" "), F.lit(""))
    target = normalise_number(expected)
    both = clean.contains("(") & clean.contains(")")

    def plain(x):
        x = F.replace(x, F.lit(","), F.lit(""))
        return F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x)

    numbers = F.transform(found(clean, NUMBER), plain)
    hit = F.exists(numbers, lambda x: (x == target) | (both & (F.concat(F.lit("-"), x) == target)))
    return F.coalesce(hit, F.lit(False))


def span_overlap(a, b, c, d) -> Column:
    return F.greatest(F.lit(0), F.least(_col(b), _col(d)) - F.greatest(_col(a), _col(c)))


def span_coverage(a, b, c, d) -> Column:
    """Share of [c, d) that [a, b) covers; 0 if [c, d) is empty."""
    n = _col(d) - _col(c)
    return F.when(n > 0, span_overlap(a, b, c, d) / n).otherwise(0.0)


def blocks_overlapping(blocks, start, end) -> Column:
    """Those of an array of blocks that share a character with [start, end)."""
    return F.filter(_col(blocks), lambda b: (b["start"] < _col(end)) & (b["end"] > _col(start)) & (b["end"] > b["start"]) & (_col(end) > _col(start)))


def section_path_at(blocks, offset) -> Column:
    """Section path of the first block that holds the offset; empty outside all blocks."""
    held = F.filter(_col(blocks), lambda b: (b["start"] <= _col(offset)) & (_col(offset) < b["end"]))
    return F.coalesce(F.get(held, F.lit(0))["section_path"], F.array().cast("array<string>"))


def company_tokens(name) -> Column:
    words = F.filter(found(F.lower(_col(name)), "[a-z]+"), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, COMPANY_NOISE)))


def rewrite_problem(rewritten, company, period) -> Column:
    """Why a paraphrase is refused, or null. Without a distinctive company token nothing more is checked."""
    text, wanted = _col(rewritten), company_tokens(company)
    years = lambda c: found(_col(c), PERIOD)
    return (
        F.when(text.isNull() | (F.length(text) < 15), "empty or too short")
        .when(F.length(text) > 400, "not a single question")
        .when(F.size(wanted) == 0, None)
        .when(~F.arrays_overlap(wanted, company_tokens(text)), "dropped the company name")
        .when((F.size(years(period)) > 0) & ~F.arrays_overlap(years(period), years(text)), "dropped the fiscal period")
    )


def verdict(text) -> Column:
    """'OK', 'REJECT' or null, from a judge's reply."""
    m = F.upper(F.regexp_extract(_col(text), r"(?i)VERDICT:\s*(OK|REJECT)\b", 1))
    return F.when(m != "", m)


def citations(answer) -> Column:
    """Distinct bracketed numbers in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(answer), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def refused(answer) -> Column:
    return F.lower(_col(answer)).contains("not in context")


def l2_normalize(vector) -> Column:
    """To unit length; a zero vector stays zero."""
    v = F.transform(_col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
