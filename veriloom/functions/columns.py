"""Column expressions: vectors, ids, text, config strings, dates. All run inside Spark's own engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: str | Column, digits: int = 9) -> Column:
    """Doubles as both engines agree on them; negative zero becomes zero."""
    return F.round(col(x).cast("double"), digits) + F.lit(0.0)


# vectors


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where a side has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


# ids


def content_uuid(*parts: str | Column) -> Column:
    """UUID form of the MD5 of the parts joined by '-', nulls empty: equal content, equal id."""
    key = F.md5(F.concat_ws("-", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)))
    return F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def node_digest(*parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256)


# text


def word_count(text: str | Column) -> Column:
    """Runs of what isn't white space, Unicode white space included."""
    return F.regexp_count(col(text), F.lit(r"(?U)\S+")).cast("long")


def token_count(text: str | Column) -> Column:
    """Approximate tokens: words and single other marks."""
    return F.regexp_count(col(text), F.lit(r"(?U)\w+|[^\w\s]")).cast("long")


def words(text: str | Column) -> Column:
    """Distinct lower-case words of letters and digits, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1))


def all_words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def title_case(text: str | Column) -> Column:
    return F.initcap(F.replace(col(text), F.lit("_"), F.lit(" ")))


def between_markers(text: str | Column, start: str, end: str) -> Column:
    """What stands between the first start marker and the next end marker, trimmed; empty if either is missing."""
    t = col(text)
    after = F.locate(start, t) + len(start)
    rest = F.substr(t, after)
    stop = F.instr(rest, end)
    return F.when((F.locate(start, t) > 0) & (stop > 0), F.trim(F.substr(rest, F.lit(1), stop - 1))).otherwise(F.lit(""))


def text_match(text: str | Column, query: str | Column) -> Column:
    """Every word of the query begins some word of the text."""
    have = words(text)
    return F.forall(words(query), lambda q: F.exists(have, lambda w: F.startswith(w, q)))


def char_span(parent: str | Column, child: str | Column) -> tuple[Column, Column]:
    """First place of the child in the parent, zero-based, and its end; null where it isn't there."""
    at = F.position(col(child), col(parent))
    start = F.when(at > 0, at - 1)
    return start.cast("long"), (start + F.length(col(child))).cast("long")


def sentences(text: str | Column) -> Column:
    """Sentences with the white space after them: cut after . ! ? and white space."""
    marked = F.regexp_replace(col(text), r"([.!?])(\s+)", "$1$2\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.length(F.trim(s)) > 0)


# config strings


def config_string(fields: dict[str, str | Column]) -> Column:
    """k=v,k=v with spaces of values as underscores; null values are left out."""
    return F.concat_ws(",", *(F.when(col(v).isNotNull(), F.concat(F.lit(f"{k}="), F.replace(col(v).cast("string"), F.lit(" "), F.lit("_")))) for k, v in fields.items()))


def config_map(text: str | Column) -> Column:
    """The inverse, where every underscore of a value is a space."""
    return F.transform_values(F.str_to_map(col(text), F.lit(","), F.lit("=")), lambda k, v: F.replace(v, F.lit("_"), F.lit(" ")))


def rater_name(config: str | Column, skip: int = 3) -> Column:
    parts = F.split(col(config), ",")
    return F.array_join(F.slice(parts, F.lit(skip + 1), F.greatest(F.size(parts) - skip, F.lit(0))), ",")


# labels

SUPPORTED, NOT_SUPPORTED, NOT_ADDRESSED = "Supported", "Not Supported", "Not Addressed"
NEITHER = "Not Supported or Addressed"
VERDICTS = (SUPPORTED, NOT_SUPPORTED, NOT_ADDRESSED)


def binarized(verdict: str | Column) -> Column:
    v = col(verdict)
    return F.when(v.isNull(), None).when(v == SUPPORTED, v).otherwise(F.lit(NEITHER))


def valid_verdict(verdict: str | Column) -> Column:
    """The title-cased label if it is one of the three, else null."""
    v = F.initcap(F.trim(col(verdict)))
    return F.when(v.isin(*VERDICTS), v)


def text_and_reference(text: str | Column, reference: str | Column) -> Column:
    """What a verdict was given on; null texts count as empty."""
    return F.concat(F.lit("Text: "), F.coalesce(col(text), F.lit("")), F.lit("\nReference: \n"), F.coalesce(col(reference), F.lit("")))


def verdict_report(verdict: str | Column, reason: str | Column, text: str | Column, reference: str | Column, chain: str | Column | None = None, final: str | Column | None = None) -> Column:
    """A verdict told in lines; the reasoning's lines only where there is one. Nulls count as empty."""
    told = [F.concat(F.lit("Verdict: "), F.coalesce(col(verdict), F.lit(""))), F.concat(F.lit("Reason: "), F.coalesce(col(reason), F.lit(""))), text_and_reference(text, reference)]
    for name, c in (("Reasoning Chain", chain), ("Reasoning Final Answer", final)):
        if c is not None:
            told.append(F.when(F.length(col(c)) > 0, F.concat(F.lit(f"{name}: "), col(c))))
    return F.concat_ws("\n", *told)


def yes_no(flag: str | Column) -> Column:
    return F.when(col(flag), "Yes").when(~col(flag), "No")


def ordinal(value: str | Column, order: list[str]) -> Column:
    """Place of a category for sorting; unknown ones are null."""
    at = F.array_position(F.array(*map(F.lit, order)), col(value))
    return F.when(at > 0, at)


# dates


def age_years(birth: str | Column, at: str | Column) -> Column:
    """Whole years of 365 days; above 89 all are 90."""
    years = F.datediff(F.to_date(col(at)), F.to_date(col(birth))) / F.lit(365.0)
    return F.when(years > 89, F.lit(90)).otherwise(years.cast("int"))


def whole_days(start: str | Column, end: str | Column) -> Column:
    return F.floor((F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))) / 86400).cast("long")


def day_window(at: str | Column, start: str | Column, end: str | Column) -> Column:
    """From the first moment of the start's day to the last second of the end's."""
    first, last = F.date_trunc("day", col(start)), F.date_trunc("day", col(end)) + F.expr("INTERVAL 86399 SECONDS")
    return col(at).between(first, last)


def prefix_buckets(value: str | Column, rules: list[tuple[str, str]]) -> Column:
    """First rule whose prefix fits; else the value itself."""
    v = col(value)
    return reduce(lambda w, r: w.when(v.startswith(r[0]), r[1]), rules[1:], F.when(v.startswith(rules[0][0]), rules[0][1])).otherwise(v)


def display(value: str | Column, low: str | Column, high: str | Column, percent: bool = False) -> Column:
    """0.81 (0.78-0.84) or 12.3% (10.0-14.5%); without bounds the value alone."""
    v, a, b = col(value), col(low), col(high)
    plain, full = ("%.1f%%", "%.1f%% (%.1f-%.1f%%)") if percent else ("%.2f", "%.2f (%.2f-%.2f)")
    k = 100 if percent else 1
    return F.when(a.isNull() | b.isNull(), F.format_string(plain, v * k)).otherwise(F.format_string(full, v * k, a * k, b * k))


EXPERIMENT = ("author_type", "proposition_type", "fact_type")


def experiment_group(name: str | Column, order: tuple[str, ...] = ("author", "proposition", "fact")) -> Column:
    """Author, kind of proposition and kind of fact that a run's name tells of, as a struct; null where it doesn't."""
    t = F.lower(col(name))
    found = {"author": ("llm", "human"), "proposition": ("claim", "sentence"), "fact": ("claim", "sentence")}
    pick = lambda field, kinds: reduce(lambda w, k: w.when(F.regexp_like(t, F.lit(rf"(^|[,_/ ]){field}[a-z_]*[=_]{k}")), k), kinds[1:], F.when(F.regexp_like(t, F.lit(rf"(^|[,_/ ]){field}[a-z_]*[=_]{kinds[0]}")), kinds[0]))
    return F.struct(*(pick(f, found[f]).alias(f) for f in order))


def any_columns(test, *columns: str) -> Column:
    """Whether a test holds for any of the columns."""
    return reduce(lambda a, b: a | b, (test(c) for c in columns))
