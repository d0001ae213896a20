"""Tokens, snippets and wording tests as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word runs, the ideograph range, universal words, number words,
# counted nouns, machine paths, fact ids, source references.
WORD_RUN = "[A-Za-z0-9_]+"
HAN_RUN = "[\\x{4e00}-\\x{9fff}]+"
UNIVERSAL_ASCII = ("all", "every", "none", "only", "never", "both")
UNIVERSAL_HAN = ("全部", "所有", "唯一", "从不", "必须", "总是", "一定", "都", "均", "各方案", "各个", "各自", "两者", "全体", "无一例外")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
COUNTED_NOUNS = "solutions?|approaches?|entities|methods?|adopters?|方案|家"
MACHINE_PATH = "repo://|writeup://|paper://|experiment://|sources/(repos|writeups|papers)/|registry/"
FACT_ID = "^(F)-([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)-([0-9]+)$"
SOURCE_REF = "(?:repo|writeup|paper|experiment)://[^\\s)`]+|(?:repo|writeup|paper|experiment):[^\\s)`]+"
REPO_REF = "repo://([^@/]+)@([^/]+)(?:/([^#:`]+))?(?:::[^#`]+)?(?:#L.*)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def han_tokens(text: Column | str) -> Column:
    """Of each ideograph run, its characters and then its adjacent pairs."""
    runs = F.regexp_extract_all(_col(text), F.lit(HAN_RUN), F.lit(0))

    def parts(run: Column) -> Column:
        n = F.length(run)
        single = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(run, k, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.substring(run, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(single, pairs)

    return F.flatten(F.transform(runs, parts))


def tokens(text: Column | str) -> Column:
    """Lower-cased ASCII word runs, then ideograph tokens.  Runs are taken before
    lowering, so letters outside ASCII split words as they are written."""
    words = F.transform(F.regexp_extract_all(_col(text), F.lit(WORD_RUN), F.lit(0)), F.lower)
    return F.concat(words, han_tokens(text))


def snippet(text: Column | str, terms: Column, width: int = 180, lead: int = 60) -> Column:
    """Stripped lines joined by spaces, cut around the first hit of any term."""
    # A lambda of one argument: F.trim itself takes a second one, as which transform gives it the line's number.
    lines = F.filter(F.transform(F.split(_col(text), "\n"), lambda line: F.regexp_replace(line, "^\\p{Zs}+|\\p{Zs}+$", "")), lambda line: line != "")
    flat = F.array_join(lines, " ")
    places = F.filter(F.transform(terms, lambda t: F.call_function("locate", F.lower(t), F.lower(flat))), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1)) - 1
    start = F.greatest(F.lit(0), first - lead)
    body = F.substring(flat, start + 1, F.lit(width))
    before = F.when(start > 0, "...").otherwise("")
    after = F.when(start + width < F.length(flat), "...").otherwise("")
    return F.concat(before, body, after)


def universal_wording(text: Column | str) -> Column:
    """Whether a text generalises: an ASCII word on its own or an ideograph phrase."""
    ascii_ = _col(text).rlike("(?i)\\b(?:" + "|".join(UNIVERSAL_ASCII) + ")\\b")
    return ascii_ | _col(text).rlike("|".join(UNIVERSAL_HAN))


def stated_counts(text: Column | str) -> Column:
    """Numbers, as digits or words, in front of a counted noun."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit("\\b([0-9]+|" + "|".join(NUMBER_WORDS) + ")\\s+(?:" + COUNTED_NOUNS + ")\\b"), F.lit(1))
    words = F.array(*(F.lit(w) for w in NUMBER_WORDS))
    return F.transform(found, lambda t: F.when(t.rlike("^[0-9]+$"), t.try_cast("long")).otherwise(F.array_position(words, t)))


def machine_path(text: Column | str) -> Column:
    """Whether a text holds a path of a store instead of a reference id."""
    return _col(text).rlike(MACHINE_PATH)


def fact_entity(fact_id: Column | str) -> Column:
    """The entity named in a fact id; null for ids of another form."""
    return F.nullif(F.regexp_extract(_col(fact_id), FACT_ID, 2), F.lit(""))


def source_refs(text: Column | str) -> Column:
    """Distinct references written in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_col(text), F.lit(SOURCE_REF), F.lit(0)), source_ref)))


def source_ref(text: Column | str) -> Column:
    """A source reference without quotes and trailing punctuation."""
    bare = F.regexp_replace(F.trim(_col(text)), "^[\"'`]+", "")
    return F.regexp_replace(bare, "[\"'`。，；,.;:)\\]}]+$", "")


def safe_id(text: Column | str) -> Column:
    return _col(text).rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,119}$") & ~F.contains(_col(text), F.lit(".."))


def free_column(name: str, *taken: list[str]) -> str:
    """``name`` with as many underscores behind it as keep it apart from the ``taken`` ones, whatever their case."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name
