"""Column expressions over texts whose results agree with Python's string rules, code point by code point."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONCEPT_GROUPS, EVIDENCE_TITLES, ROLE_MARKERS, STOPWORDS, TITLE_RULES

#: Characters that Python's regular expressions and strip() take as white space; Java's \s has other ones.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: Line starts and ends are those of "\n" alone (d), on every line (m).
HEADING = rf"(?dm)^(#{{1,6}}){WS}+(.+?){WS}*$"
#: White space with two line breaks parts paragraphs; white space between a stop and a capital parts sentences.
PARAGRAPH = rf"{WS}*\n{WS}*\n{WS}*"
SENTENCE = rf"""(?<=[.!?]){WS}+(?=[A-Z0-9"'])"""
NUMBER = rf"(?i)(?<!{WORD})(?:[$€£]?\p{{Nd}}[\p{{Nd}},.]*(?:%|{WS}*(?:USD|EUR|GBP))?)(?!{WORD})"
QUOTATION = r'[“"]([^”"]{2,})[”"]'
CITATION = rf"(?:\[[^\]]+\]|\([^)]*(?<!{WORD})(?:19|20)\p{{Nd}}{{2}}[^)]*\))"
TERM = rf"(?<!{WORD})[A-Z][A-Za-z]+(?:{WS}+[A-Z][A-Za-z]+){{1,4}}(?!{WORD})"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def normalise(text: Column) -> Column:
    """Lower case, anything but letters, digits, white space and %$€£- to a space, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x85\p{{Z}}%$€£-]", " "), rf"{WS}+", " "))


def tokens(normalised: Column) -> Column:
    """Distinct words of a normalised text, sorted; none for an empty one."""
    return F.when(normalised == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.split(normalised, " "))))


def content(token_set: Column) -> Column:
    return F.filter(F.array_except(token_set, F.array(*map(F.lit, STOPWORDS))), lambda t: F.length(t) > 2)


def _concept_map() -> Column:
    pairs = [F.lit(x) for i, group in enumerate(CONCEPT_GROUPS) for word in group.split() for x in (word, f"c{i}")]
    return F.create_map(*pairs)


def concepts(content_set: Column) -> Column:
    """Content words with the words of a synonym group replaced by the group's name."""
    known = _concept_map()
    some = F.arrays_overlap(content_set, F.array(*[F.lit(word) for group in CONCEPT_GROUPS for word in group.split()]))
    named = F.array_sort(F.array_distinct(F.transform(content_set, lambda t: F.coalesce(F.try_element_at(known, t), t))))
    return F.when(some, named).otherwise(content_set)  # the set is sorted already


def concept_display(concept: Column) -> Column:
    shown = F.create_map(*[F.lit(x) for i, group in enumerate(CONCEPT_GROUPS) for x in (f"c{i}", min(group.split()))])
    return F.coalesce(F.try_element_at(shown, concept), concept)


def _any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def discourse_role(text: Column) -> Column:
    low = F.lower(text)
    rules = F.coalesce(*(F.when(_any(low, words), F.lit(role)) for role, words in ROLE_MARKERS))
    return F.coalesce(rules, F.lit("claim"))


def local_function(title: Column, role: Column) -> Column:
    low = F.lower(title)
    by_title = [F.when(_any(low, words), F.lit(name)) for name, words in TITLE_RULES]
    evidence = F.when((role == "evidence") | _any(low, EVIDENCE_TITLES), F.lit("evidentiary"))
    return F.coalesce(*by_title, evidence, F.when(role == "definition", F.lit("definitory")), F.lit("context"))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def quotations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTATION), F.lit(1))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))


def defined_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def title_case(text: Column) -> Column:
    """A capital after every character that is no letter, small letters after letters."""
    chars = F.split(text, "")
    before = F.concat(F.array(F.lit(" ")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))))
    return F.array_join(F.zip_with(chars, before, lambda c, b: F.when(F.regexp_like(b, F.lit(r"\p{L}")), F.lower(c)).otherwise(F.upper(c))), "")


def round4(x: Column) -> Column:
    """Python's round(x, 4) for a double x >= 0: the exact binary value decides, ties go to even.

    x times a power of two is an integer without error, so the comparison with the middle of two neighbours is exact.
    The one-element array binds x to a name, so that its expression is evaluated once and the plan stays small.
    """

    return round_to(x, 4)


def round_to(x: Column, places: int) -> Column:
    """Python's round to so many places, at most four."""
    return bound(x, lambda v: _round(v, 10**places))


def _round(v: Column, ten: int = 10_000) -> Column:
    floor = F.floor(v * float(ten)).cast("bigint")

    def by(scale: int) -> Column:
        twice = (v * float(scale)).cast("bigint").cast("decimal(20,0)") * F.lit(2 * ten).cast("decimal(6,0)")
        middle = (2 * floor + 1).cast("decimal(15,0)") * F.lit(Decimal(scale)).cast("decimal(22,0)")
        return (floor + F.when(twice > middle, 1).when(twice < middle, 0).otherwise(floor % 2)) / float(ten)

    exact = F.when(v < 0.0009765625, by(2**72)).when(v <= 1.0, by(2**62)).when(v < 2000.0, by(2**52)).otherwise(by(2**42))
    # below 2000 the product is off by less than 1e-8, so only what lies that near to a middle needs the decimals
    part = v * float(ten) - floor
    return F.when((v < 2000.0) & (F.abs(part - 0.5) > 0.000001), (floor + (part > 0.5).cast("bigint")) / float(ten)).otherwise(exact)


def rounded(col: str, name: str | None = None) -> Column:
    """round4 of a named column."""
    return round4(F.col(col)).alias(name or col)


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once: a lambda would work out a column expression for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame) -> DataFrame:
    """df with its columns worked out once a row: a filter or a reader above a projection may take its expressions along
    and work them out again for each use, but not those of a generator."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def running(lengths: Column) -> Column:
    """Sum of the elements before each one. Sums of 64 elements carry the rest, so no array is built up step by step."""
    none = F.array().cast("array<int>")
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n)

    def bases(own: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / 64).cast("int")), lambda c: total(F.slice(own, c * 64 + 1, 64)))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(sums, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def sums(v: Column) -> Column:
        return F.transform(v["own"], lambda _, i: F.get(v["bases"], F.floor(i / 64).cast("int")) + total(F.slice(v["own"], i - i % 64 + 1, i % 64)))

    return bound(lengths, lambda own: F.when(F.size(own) == 0, none).otherwise(bound(F.struct(own.alias("own"), bases(own).alias("bases")), sums)))


def context_window(text: Column, start: Column, end: Column, reach: int = 300) -> Column:
    """The code points around a span, cut at the text's ends."""
    first = F.greatest(start - reach, F.lit(0))
    return F.substring(text, first + 1, F.least(end + reach, F.length(text)) - first)


def splice(text: Column, edits: Column) -> Column:
    """Apply non-overlapping edits (s, e, txt) from the last to the first."""
    late = F.reverse(F.array_sort(edits))
    return F.aggregate(late, text, lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["s"]), e["txt"], F.substring(acc, e["e"] + 1, F.length(acc))))


def outside_kept(text: Column, revised: Column, edits: Column) -> Column:
    """Whether revised has everything between the sorted edits (s, e, txt) of text, and their texts, and nothing else."""
    state = lambda at, to, same: F.struct(at.alias("at"), to.alias("to"), same.alias("same"))

    def step(acc: Column, e: Column) -> Column:
        gap = e["s"] - acc["at"]
        kept = F.substring(text, acc["at"] + 1, gap) == F.substring(revised, acc["to"] + 1, gap)
        placed = F.substring(revised, acc["to"] + gap + 1, F.length(e["txt"])) == e["txt"]
        return state(e["e"], acc["to"] + gap + F.length(e["txt"]), acc["same"] & (gap >= 0) & kept & placed)

    rest = lambda acc: acc["same"] & (F.substring(text, acc["at"] + 1, F.length(text)) == F.substring(revised, acc["to"] + 1, F.length(revised)))
    return F.aggregate(edits, state(F.lit(0), F.lit(0), F.lit(True)), step, rest)


def percent(x: Column) -> Column:
    """A share as Python's .1% shows it: the exact binary value decides, ties go to even."""
    return F.format_string("%.1f%%", round_to(x * 100, 1))


def two_places(x: Column) -> Column:
    """A number as Python's .2f shows it."""
    return F.format_string("%.2f", round_to(x, 2))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\t-\r\x1c-\x20\x85\p{Z}]+")), F.lit(0))


def canonical_hash(text: Column) -> Column:
    return F.sha2(F.concat(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))), F.lit("\n")), 256)
