"""Field merges, logs and canonical JSON against the fixtures' cases and the laws of merging."""

import json
import random

import pytest

from mergeloom.functions.canonical import Uncanonical, canonical, canonical_text, number
from mergeloom.operators import records


def fields(spark, doc):
    rows = [("r", k, canonical(v)) for k, v in doc.items()]
    return spark.createDataFrame(rows, "record_id string, field string, value string")


def merge(spark, base, ours, theirs, policy=None):
    out = records.merge_fields(*[fields(spark, d) for d in (base, ours, theirs)], policy).collect()
    doc = {r.field: json.loads(r.resolved) for r in out if r.resolved is not None}
    return doc, sorted(r.field for r in out if r.conflict), sorted(r.field for r in out if r.changed)


P = records.Policy
#: base, ours, theirs, policy, document, conflicts, changed
CASES = [
    ({"colour": "red", "size": 4, "ok": True}, {"colour": "blue", "size": 4, "ok": True}, {"colour": "red", "size": 9, "ok": True}, None, {"colour": "blue", "size": 9, "ok": True}, [], ["colour", "size"]),
    ({"size": 4}, {"size": 5}, {"size": 6}, None, {"size": 5}, ["size"], ["size"]),
    ({"size": 4}, {"size": 8}, {"size": 8}, None, {"size": 8}, [], ["size"]),
    ({"left": 1, "right": 2, "both": 3}, {"right": 2}, {"left": 1}, None, {}, [], ["both", "left", "right"]),
    ({"n": 1}, {}, {"n": 2}, None, {}, ["n"], ["n"]),
    ({"n": 1}, {"n": 2}, {}, None, {"n": 2}, ["n"], ["n"]),
    ({}, {"who": ["kim", "ada"]}, {"who": ["ada", "bo"]}, None, {"who": ["ada", "bo", "kim"]}, [], ["who"]),
    ({"who": ["kim", "ada"]}, {"who": ["kim"]}, {"who": ["kim", "ada", "bo"]}, None, {"who": ["bo", "kim"]}, [], ["who"]),
    ({"steps": ["mix"]}, {"steps": ["mix", "rest"]}, {"steps": ["mix", "bake", "cool"]}, P({"steps": "sequence"}), {"steps": ["mix", "rest", "bake", "cool"]}, [], ["steps"]),
    ({"steps": ["mix", "rest"]}, {"steps": ["rest", "eat"]}, {"steps": ["mix", "rest", "eat"]}, P({"steps": "sequence"}), {"steps": ["rest", "eat"]}, [], ["steps"]),
    ({"n": 1}, {"n": 20}, {"n": 3}, P(fallback="set"), {"n": [20, 3]}, [], ["n"]),
    ({"n": 1}, {"n": 20}, {"n": 3}, P({"n": "scalar"}, fallback="set"), {"n": 20}, ["n"], ["n"]),
    ({"seen": "2019-03-01T10:00:00Z"}, {"seen": "2019-03-01T14:30:00+02:00"}, {"seen": "2019-03-01T12:00:00Z"}, P({"seen": "timestamp"}), {"seen": "2019-03-01T14:30:00+02:00"}, [], ["seen"]),
    ({"seen": "2019-03-01T10:00:00Z"}, {"seen": "2019-03-01T11:00:00Z"}, {"seen": "2019-03-01T15:00:00+04:00"}, P({"seen": "timestamp"}), {"seen": "2019-03-01T15:00:00+04:00"}, [], ["seen"]),
    ({}, {"seen": "soon"}, {"seen": "2019-03-01T10:00:00Z"}, P({"seen": "timestamp"}), {"seen": "soon"}, ["seen"], ["seen"]),
    ({"seen": 0}, {"seen": 7}, {"seen": 8}, P({"seen": "timestamp"}), {"seen": 7}, ["seen"], ["seen"]),
    ({"a": 1}, {"a": None}, {"a": 1}, None, {"a": None}, [], ["a"]),
    ({"a": 1}, {"a": None}, {"a": [2]}, None, {"a": [2, None]}, [], ["a"]),
    ({}, {"s": [1]}, {"s": ["1", [2, {"k": "a,]"}]]}, None, {"s": ["1", 1, [2, {"k": "a,]"}]]}, [], ["s"]),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_field_merge(spark, case):
    base, ours, theirs, policy, doc, conflicts, changed = case
    assert merge(spark, base, ours, theirs, policy) == (doc, conflicts, changed)


def test_laws(spark):
    r = random.Random(1)
    docs = [{f: r.choice([1, "x", ["a", r.randint(0, 3)], None]) for f in "abcd" if r.random() < 0.7} for _ in range(3)]
    b, o, t = docs
    assert merge(spark, b, o, o)[0] == o
    assert merge(spark, b, o, b)[0] == o
    assert merge(spark, b, b, t)[0] == t


def log(spark, *lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "pos int, line string")


def merged_log(spark, *sides):
    return [r.line for r in records.merge_log(*[log(spark, *s) for s in sides]).orderBy("seq").collect()]


def test_log_union(spark):
    assert merged_log(spark, ["one", "two"], ["two", "six"], ["nine"]) == ["one", "two", "six", "nine"]
    assert sorted(merged_log(spark, ["up"], ["up", "beep", "beep"], ["up", "", "down"])) == ["beep", "beep", "down", "up"]
    got = merged_log(spark, ["no time yet"], ['{"at":"b"}', "after b"], ["no time yet", '{"at":"a"}'])
    assert got == ["no time yet", '{"at":"a"}', '{"at":"b"}', "after b"]


def test_log_lines_lose_all_kinds_of_space(spark):
    assert merged_log(spark, ["a\r", "\t", "\tb"], ["a", "b"], ["c\u00a0", "\ufeff", "\u2003c", "\x0b"]) == ["a", "b", "c", "c"]


def test_hot_logs_are_worked_on_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 3)
    r = random.Random(7)
    lines = ["x", "x", "x", "y", '{"at":"2"}', '{"at":"1"}', '{"at":3}', "z"]
    sides = {k: [[r.choice(lines) for _ in range(r.randint(0, 25))] for _ in range(3)] for k in (1, 2)}
    frames = [spark.createDataFrame([(k, i, x) for k, s in sides.items() for i, x in enumerate(s[j])], "k int, pos int, line string") for j in range(3)]
    got = records.merge_log(*frames, ["k"]).orderBy("k", "seq").collect()
    for k, s in sides.items():
        assert [x.line for x in got if x.k == k] == brute_log(*s) and [x.seq for x in got if x.k == k] == list(range(1, 1 + sum(x.k == k for x in got)))


def test_documents_are_json_whatever_the_names(spark):
    names = ['a"]:b', "back\\slash", "tab\there", "\x01\x1f", "é😀", "", '"']
    rows = [("r", n, str(i)) for i, n in enumerate(names)]
    one = spark.createDataFrame(rows, "record_id string, field string, value string")
    row = records.merged_records(records.merge_fields(one.limit(0), one, one.limit(0))).first()
    assert json.loads(row.document) == {n: i for i, n in enumerate(names)}
    assert row.document == canonical({n: i for i, n in enumerate(names)}) and row.clean


def brute_log(*sides):
    arrivals = [x.strip() for s in sides for x in s if x.strip()]
    kept, out, at = {}, [], ""
    for i, x in enumerate(arrivals):
        if kept.get(x, 0) >= max([s.strip() for s in side].count(x) for side in sides):
            continue
        kept[x] = kept.get(x, 0) + 1
        if x.startswith("{") and isinstance(json.loads(x)["at"], str):
            at = json.loads(x)["at"]
        out.append((at, i, x))
    return [x for _, _, x in sorted(out)]


def test_log_union_random(spark):
    r = random.Random(2)
    lines = ["a", "b", "c", '{"at":"1"}', '{"at":"3"}', '{"at":"2"}', " "]
    for _ in range(6):
        sides = [[r.choice(lines) for _ in range(r.randint(0, 6))] for _ in range(3)]
        assert merged_log(spark, *sides) == brute_log(*sides)


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (1e2, "100"), (1e-7, "1e-7"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (0.1, "0.1"), (1e-6, "0.000001"), (-2.5, "-2.5"), (1.5e300, "1.5e+300"), (12345678901234567890, "12345678901234567000"), (-0.0, "0"), (5e-324, "5e-324")])
def test_numbers(x, text):
    assert number(float(x)) == text


def test_canonical():
    assert canonical({"\U0001f600": 1, "￮": 2}) == '{"￮":2,"\U0001f600":1}'
    assert canonical_text('{"b": 1, "a": [null, "é", 1e400]}') is None
    assert canonical_text('{"b":1,"b":2}') == '{"b":2}'
    deep = 1
    for _ in range(33):
        deep = [deep]
    with pytest.raises(Uncanonical):
        canonical(deep)
