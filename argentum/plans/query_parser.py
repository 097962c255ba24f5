"""From a free-text photo query to a typed plan, by fixed rules.

One short string is parsed on the driver; the plan then becomes DataFrame columns.
"""

from __future__ import annotations

import calendar
import datetime
import re
from dataclasses import dataclass, field

# Fixed values of the query language.
EXTENSIONS = ["jpg", "jpeg", "png", "webp", "gif", "bmp"]
STOP_WORDS = ["的", "和", "與", "在", "有", "一張", "一些", "照片", "相片", "圖片", "影像", "找", "找出", "請", "幫我", "顯示", "列出", "相關", "最", "看", "只", "其中", "裡", "中", "張"]
LIMIT_MARKS = ["最多", "前", "取"]
SUMMERS = {"去年夏天": -1, "今年夏天": 0}
YEARS = {"前年": -2, "去年": -1, "今年": 0, "明年": 1}
DATE_WORDS = ["去年夏天", "今年夏天", "前年", "去年", "今年", "明年", "夏天", "年", "月", "日"]
NO_FACE = ["不要有人", "沒有人的", "沒有臉", "無人臉", "無人物", "不要人"]
FACE = ["有人臉", "有人", "人物", "人像", "合照"]
PERSON_NEGATION = ["不要", "不含", "排除", "沒有", "無"]
TERM_NEGATION = ["不要", "不含", "排除", "沒有"]
SPLITTERS = "的和與在有"
PUNCTUATION = "、，,。.！!?？"


@dataclass
class QueryPlan:
    date_from: str | None = None
    date_to: str | None = None
    extensions: list[str] = field(default_factory=list)
    face: str = "any"  # any, required or forbidden
    people_include: list[str] = field(default_factory=list)
    people_exclude: list[str] = field(default_factory=list)
    must: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    must_not: list[str] = field(default_factory=list)
    limit: int | None = None

    @property
    def semantic_query(self) -> str:
        return " ".join(self.should)


def date_bounds(year: int, month: int | None, day: int | None) -> tuple[str, str] | None:
    """First and last second of a month or day; without a month January counts."""
    month = month or 1
    if not (1900 <= year <= 2200 and 1 <= month <= 12):
        return None
    last = calendar.monthrange(year, month)[1]
    if day is not None and not 1 <= day <= last:
        return None
    return f"{year:04}-{month:02}-{day or 1:02} 00:00:00", f"{year:04}-{month:02}-{day or last:02} 23:59:59"


def _number_before(text: str, at: int) -> int | None:
    found = re.search(r"[0-9]+$", text[:at])
    value = int(found[0]) if found else None
    return value if value is not None and value < 2**31 else None


def parse_dates(query: str, year: int) -> tuple[str, str] | None:
    for phrase, shift in SUMMERS.items():
        if phrase in query:
            return f"{year + shift:04}-06-01 00:00:00", f"{year + shift:04}-08-31 23:59:59"
    for phrase, shift in YEARS.items():
        if phrase in query:
            return date_bounds(year + shift, None, None)
    at = query.find("年")
    named = _number_before(query, at) if at >= 0 else None
    if named is None:
        return None
    m = query.find("月")
    d = query.find("日")
    return date_bounds(named, _number_before(query, m) if m >= 0 else None, _number_before(query, d) if d >= 0 else None)


def tokenize(text: str) -> list[str]:
    """Words between blanks and punctuation, cut again at particles; stop words go, repeats stay."""
    parts = re.split(rf"[\s{re.escape(PUNCTUATION)}{SPLITTERS}]+", text)
    return [p for p in parts if p and p not in STOP_WORDS]


def _take_negated(text: str) -> tuple[list[str], str]:
    out = []
    for mark in TERM_NEGATION:
        while (at := text.find(mark)) >= 0:
            rest = text[at + len(mark) :]
            word = re.match(rf"[^\s{SPLITTERS}或、，,。]*", rest)[0]
            taken = word if word not in STOP_WORDS else ""  # a stop word stays where it is
            out += [taken] if taken else []
            text = text[:at] + " " + rest[len(taken) :]
    return out, text


def parse_limit(query: str) -> int | None:
    """The number behind the first marker that has one; larger ones than an unsigned long are none."""
    for mark in LIMIT_MARKS:
        found = re.match(r"\s*([0-9]+)", query.partition(mark)[2])
        if found and 0 < int(found[1]) < 2**64:
            return int(found[1])
    return None


def _take_people(query: str, rest: str, known_people: list[str], plan: QueryPlan) -> str:
    """Known people in the query, in either case; they leave rest, a negation before them doesn't."""
    for person in sorted({p.strip() for p in known_people if p.strip()}):
        name = person.lower()
        if name not in query:
            continue
        if any(mark + name in query for mark in PERSON_NEGATION):
            plan.people_exclude.append(person)
        else:
            plan.people_include.append(person)
            plan.face = "required" if plan.face == "any" else plan.face
        rest = rest.replace(name, " ")
    return rest


def parse(query: str, known_people: list[str] = (), now_year: int | None = None) -> QueryPlan:
    """The plan of a query, in either case; a blank query has an empty plan.  ``now_year`` defaults to the UTC year."""
    year = now_year or datetime.datetime.now(datetime.UTC).year
    query = query.strip().lower()
    plan = QueryPlan(limit=parse_limit(query))
    if dates := parse_dates(query, year):
        plan.date_from, plan.date_to = dates
    # date words go before limit markers, and all digits with them
    rest = query
    for word in DATE_WORDS:
        rest = rest.replace(word, " ")
    rest = re.sub("[0-9]", " ", rest)
    for mark in LIMIT_MARKS:
        rest = re.sub(re.escape(mark) + r"\s*", " ", rest, count=1)

    if any(w in query for w in NO_FACE):
        plan.face = "forbidden"
        for w in NO_FACE:
            rest = rest.replace(w, " ")
    elif w := next((w for w in FACE if w in query), None):
        plan.face = "required"
        rest = rest.replace(w, " ")
    rest = _take_people(query, rest, known_people, plan)
    for extension in EXTENSIONS:
        if extension in query:
            plan.extensions.append(extension)
            rest = rest.replace(extension, " ")
    plan.must_not, rest = _take_negated(rest)
    plan.should = [t for t in tokenize(rest) if t not in PERSON_NEGATION]
    return plan
