import pytest
from hypothesis import given
from hypothesis import strategies as st

from argentum.plans.query_parser import QueryPlan, parse

Y = 2025
SUMMER = dict(date_from="2024-06-01 00:00:00", date_to="2024-08-31 23:59:59")
CASES = [
    ("去年夏天在海邊的小明照片", ["小明"], dict(SUMMER, people_include=["小明"], face="required", should=["海邊"])),
    ("沒有人的 jpg 照片 最多 20 張", [], dict(face="forbidden", extensions=["jpg"], limit=20)),
    ("沒有人", [], dict(face="required", should=["沒"])),
    ("不要小明", ["小明"], dict(people_exclude=["小明"])),
    ("2024年7月 海邊", [], dict(date_from="2024-07-01 00:00:00", date_to="2024-07-31 23:59:59", should=["海邊"])),
    ("2024 年 7 月", [], {}),
    ("去年", [], dict(date_from="2024-01-01 00:00:00", date_to="2024-01-31 23:59:59")),
    ("今年7月", [], dict(date_from="2025-01-01 00:00:00", date_to="2025-01-31 23:59:59")),
    ("2024年2月30日", [], {}),
    ("不含 dog", [], dict(should=["dog"])),
    ("不要狗和貓", [], dict(must_not=["狗"], should=["貓"])),
    ("不要狗", [], dict(must_not=["狗"])),
    ("沒有狗", [], dict(must_not=["狗"])),
    ("海邊 最多 120 張", [], dict(limit=120, should=["海邊"])),
    ("前10張 貓", [], dict(limit=10, should=["貓"])),
    ("生日蛋糕", [], dict(should=["生", "蛋糕"])),
    ("photo.jpg", [], dict(extensions=["jpg"], should=["photo"])),
    ("dog, cat dog", [], dict(should=["dog", "cat", "dog"])),
    ("合照 人像", [], dict(face="required", should=["合照"])),
    ("", [], {}),
    ("  TONY 照片", ["Tony"], dict(people_include=["Tony"], face="required")),
    ("不要TONY DOG.JPG", ["Tony", "Ann"], dict(people_exclude=["Tony"], extensions=["jpg"], should=["dog"])),
    ("前年 取5張 貓", [], dict(date_from="2023-01-01 00:00:00", date_to="2023-01-31 23:59:59", limit=5, should=["貓"])),
    ("前年前10張 貓", [], dict(date_from="2023-01-01 00:00:00", date_to="2023-01-31 23:59:59", should=["貓"])),
    ("無 貓", [], dict(should=["貓"])),
    ("無小明 貓", ["小明"], dict(people_exclude=["小明"], should=["貓"])),
    ("貓 最多 99999999999999999999", [], dict(should=["貓"])),
    ("貓 最多 99999999999 張", [], dict(should=["貓"], limit=99999999999)),
]


@pytest.mark.parametrize("query,people,expected", CASES)
def test_plans(query, people, expected):
    assert parse(query, people, Y) == QueryPlan(**expected)


@given(st.text(alphabet="最多前取年月日不要沒有人的狗貓 0123456789.jpg,，"))
def test_any_text_has_a_plan(query):
    plan = parse(query, ["狗"], Y)
    assert plan.limit is None or plan.limit > 0
    assert all(t and t.strip() == t for t in plan.should + plan.must_not)


def test_stop_words_behind_a_negation_stay():
    plan = parse("不要照片或貓")
    assert plan.must_not == [] and plan.should == ["照片或貓"]
    assert parse("不要狗或貓").must_not == ["狗"] and parse("不要 貓").should == ["貓"]
