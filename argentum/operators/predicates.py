"""A query plan's filters as columns, which Spark pushes towards the scan."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from argentum.plans.query_parser import QueryPlan


#: Seconds of the years 1 to 9999.
MIN_SECONDS, MAX_SECONDS = -62135596800, 253402300799
#: Unicode's white space (fixed values).
ALL_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def extension_of(path: Column) -> Column:
    """What follows the last dot, in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def has_extension(path: Column, allowed: list[str]) -> Column:
    """Exact and without case; a name without an extension has none of them."""
    return extension_of(path).isin([x.lower() for x in allowed])


def has_faces(groups: Column) -> Column:
    return F.coalesce(F.size(groups) > 0, F.lit(False))


def _lowered(people: Column) -> Column:
    return F.transform(F.coalesce(people, F.array().cast("array<string>")), F.lower)


def has_all_people(people: Column, names: list[str]) -> Column:
    wanted = F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>")
    return F.size(F.array_except(wanted, _lowered(people))) == 0


def has_no_people(people: Column, names: list[str]) -> Column:
    return ~F.arrays_overlap(_lowered(people), F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>"))


def date_key(captured_at: Column, modified_at: Column) -> Column:
    """Capture time, else the modification time's epoch seconds as UTC text, else null.

    The text is UTC whatever the session's time zone is.
    """
    seconds = modified_at.try_cast("bigint")
    return F.coalesce(captured_at, utc_text(F.when(seconds.between(MIN_SECONDS, MAX_SECONDS), seconds)))


def utc_text(seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of epoch seconds, from the day's number and what is left of the day."""
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.when(seconds.isNotNull(), F.concat_ws(" ", F.date_from_unix_date(day.cast("int")).cast("string"), clock))


def in_dates(key: Column, first: str | None, last: str | None) -> Column:
    """Whether a key lies between the bounds that are given; the key is computed once for both."""

    def within(k: Column) -> Column:
        return reduce(and_, [k >= first] * bool(first) + [k <= last] * bool(last), F.lit(True))

    return F.coalesce(F.exists(F.array(key), within), F.lit(False))


def plan_filter(plan: QueryPlan) -> Column:
    """The conjunction of a plan's filters over a table of images."""
    tests = []
    if plan.extensions:
        tests.append(has_extension(F.col("filename"), plan.extensions))
    if plan.face != "any":
        faces = has_faces(F.col("face_group_ids"))
        tests.append(faces if plan.face == "required" else ~faces)
    if plan.people_include:
        tests.append(has_all_people(F.col("people"), plan.people_include))
    if plan.people_exclude:
        tests.append(has_no_people(F.col("people"), plan.people_exclude))
    if plan.date_from or plan.date_to:
        tests.append(in_dates(date_key(F.col("captured_at"), F.col("modified_at")), plan.date_from, plan.date_to))
    return reduce(and_, tests, F.lit(True))


def haystack() -> Column:
    """What terms are looked for in: file name, text and people, in lower case."""
    return F.lower(F.concat_ws(" ", "filename", F.coalesce("ocr_text", F.lit("")), F.array_join("people", " ")))


def compact(hay: Column) -> Column:
    """hay without blanks, letter by letter, which is faster than a pattern."""
    return F.translate(hay, ALL_BLANKS, "")


def has_term(hay: Column, term: str, packed: Column | None = None) -> Column:
    """As it stands, or with all blanks of both left out; ``packed``: the haystack so, where it is at hand.

    Without it the second test is a pattern with blanks allowed between any two letters.
    """
    term = term.lower()
    bare = "".join(term.split())
    if packed is not None:
        return hay.contains(term) | packed.contains(bare)
    letters = ["\\" + c if c.isascii() and not c.isalnum() else c for c in bare]
    return hay.contains(term) | hay.rlike(f"{BLANKS[:-1]}*".join(letters))


def has_any_term(hay: Column, terms: list[str], packed: Column | None = None) -> Column:
    return reduce(or_, [has_term(hay, t, packed) for t in terms], F.lit(False))


def matched_share(hay: Column, terms: list[str], packed: Column | None = None) -> Column:
    """The share of terms that the haystack has; 0 without terms."""
    if not terms:
        return F.lit(0.0)
    return reduce(add, [F.when(has_term(hay, t, packed), 1.0).otherwise(0.0) for t in terms]) / len(terms)
