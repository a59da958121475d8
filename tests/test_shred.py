import json
from datetime import datetime

import pytest

from quadloom.operators import shred as S

RAW = "record_no long, rec_type string, origin string, record_fields string, loaded_at timestamp"


def brute(text):
    """Paths of nested records, by plain recursion."""
    out = []

    def no(x):
        raise ValueError(x)

    def walk(record, path):
        props = record["properties"]
        for p, prop in enumerate(props if isinstance(props, list) else [props]):
            if not isinstance(prop, dict):
                continue
            for name, value in prop.items():
                if name.replace("_", "").lower() != "propertyvalue":
                    continue
                for v, one in enumerate(value if isinstance(value, list) else [value]):
                    if isinstance(one, str) and one.lstrip().startswith("{"):
                        try:
                            one = json.loads(one, parse_constant=no)
                        except ValueError:
                            continue
                    if isinstance(one, dict) and "properties" in one:
                        here = f"{path}/{p}.{v}".lstrip("/")
                        out.append((path, here))
                        walk(one, here)

    try:
        root = json.loads(text, parse_constant=no)
    except (ValueError, TypeError):
        return []
    if isinstance(root, dict) and "properties" in root:
        walk(root, "")
    return out


def rec(*props, **more):
    return {"properties": [{"propertyURI": u, "propertyValue": v} for u, v in props], **more}


TEXTS = [
    json.dumps(rec(("a", 1), ("b", [None, rec(("c", rec())), "x", rec()]), id="http://r")),
    json.dumps({"id": {"identifier": "i"}, "properties": {"property_uri": "a", "property_value": rec()}}),
    json.dumps(rec(("a", json.dumps(rec(("b", [rec(), json.dumps(rec())])))), ("t", "{draft}"), ("u", '{"note": 6}'))),
    json.dumps(rec(("a", {"label": "x", "language": "en", "inner": rec()}))),
    json.dumps({"properties": [None, 5, {"propertyUri": "a", "propertyValue": {"properties": None}}]}),
    json.dumps({"properties": []}),
    json.dumps({"other": rec()}),
    json.dumps([rec(("a", rec()))]),
    '{"properties": [{"propertyURI": "a", "propertyValue": NaN}]}',
    '{"properties": [{"propertyURI"',
    "",
    "null",
    None,
    json.dumps(rec(("big", "z" * 200_000), ("n", rec()))),
    json.dumps(rec(("d", rec(("d", rec(("d", rec(("d", rec()))))))))),
]


def rows(texts):
    return [(i, "resource", None, t, datetime(2024, 1, 1)) for i, t in enumerate(texts)]


def test_nested_records(spark):
    got = sorted(tuple(r) for r in S.nested_records(spark.createDataFrame(rows(TEXTS), RAW)).collect())
    assert got == sorted((i, *x) for i, t in enumerate(TEXTS) for x in brute(t))


def test_deliveries(spark):
    good, other = json.dumps(rec(("a", rec()))), json.dumps(rec(("a", [1, rec()])))
    data = [(1, None, None, good, datetime(2024, 1, 1)), (1, None, None, "{bad", datetime(2024, 1, 3)), (1, None, None, good, datetime(2024, 1, 1))]
    data += [(2, None, None, good, datetime(2024, 1, 1)), (2, None, None, other, datetime(2024, 1, 2)), (3, None, None, good, None), (None, None, None, good, None)]
    got = sorted(tuple(r) for r in S.nested_records(spark.createDataFrame(data * 4, RAW).selectExpr("*", "1 as node", "2 as path")).collect())
    assert got == [(1, "", "0.0"), (2, "", "0.1"), (3, "", "0.0")]


def test_tables(spark):
    nodes = S.adjacency(spark.createDataFrame(rows(TEXTS), RAW))
    records = {(r.record_no, r.node_path): r for r in S.record_table(nodes).collect()}
    assert records[0, ""].id == "http://r" and records[1, ""].id == "i" and records[0, ""].parent_path is None
    assert records[0, "1.1/0.0"].parent_path == "1.1" and records[0, "1.1/0.0"].parent_record == records[0, "1.1"].node
    props = S.property_table(nodes).where("record_no = 0").collect()
    root = [p for p in props if p.record == records[0, ""].node]
    assert sorted((p.property, p.value) for p in root) == [(0, 0), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert {p.property_uri for p in root} == {"a", "b"}
    assert {p.child_record for p in root if p.child_record} == {records[0, "1.1"].node, records[0, "1.3"].node}
    assert [p.scalar for p in root if p.property == 0] == ["1"]
    label = S.property_table(nodes).where("record_no = 3 and value_label is not null").collect()
    assert [(p.value_label, p.value_language) for p in label] == [("x", "en")]


def test_every_value_has_one_row(spark, data):
    raw = spark.read.parquet(f"{data}/raw_records.parquet")
    nodes = S.adjacency(raw)
    got = sorted(tuple(r) for r in S.record_table(nodes).where("parent_record is not null").select("record_no", "parent_path", "node_path").collect())
    best = {}
    for r in raw.collect():
        if S.is_record_text(r.record_fields):
            best[r.record_no] = max(best.get(r.record_no, (datetime.min, "")), (r.loaded_at, r.record_fields))
    assert got == sorted((no, *x) for no, (_, t) in best.items() for x in brute(t))
    values = S.property_table(nodes)
    assert values.count() == values.select("record_no", "record", "property", "value", "kind", "scalar", "child_record", "property_uri").count()
    assert values.groupBy("record_no", "record", "property", "value").count().where("count > 1").count() == 0


def scalars(text):
    """All scalars of a JSON text that are not null, as text; JSON text of a record counts as the record."""
    out, stack = [], [(S.parse(text), False)]
    while stack:
        x, held = stack.pop()
        if isinstance(x, dict):
            for name, y in x.items():
                is_value = held and S._role(name) == "propertyvalue"
                for one in y if isinstance(y, list) else [y]:
                    one = S._as_record(one) if is_value else one
                    record = isinstance(one, dict) and (name == "properties" or "properties" in one)
                    stack.append((one, record))
        elif isinstance(x, list):
            stack.extend((y, False) for y in x)
        elif x is not None:
            out.append(str(x).lower() if isinstance(x, bool) else str(x))
    return sorted(out)


NESTED = [
    json.dumps(rec(("a", {"subject": {"identifier": "s1"}, "predicate": {"identifier": "p1"}, "object": {"label": "o", "language": "en"}, "odd": [1, [True, {"deep": "x"}]]}))),
    json.dumps(rec(("a", [[1, 2], [3]]), ("b", {"id": {"identifier": {"v": 4}}}), id={"identifier": "i", "scheme": "k"}, created=7)),
    json.dumps({"properties": [5, {"propertyURI": "u", "property_uri": "w", "weight": 0.5, "propertyValue": {"p": {}, "q": None}}]}),
]


def test_nested_members(spark):
    nodes = S.adjacency(spark.createDataFrame(rows(NESTED), RAW))
    members = {(r.record_no, r.node): r for r in S.member_table(nodes).collect()}
    value = S.property_table(nodes).where("record_no = 0").collect()[0]
    below = {(members[0, r.parent].label, r.label): r.scalar for r in members.values() if r.record_no == 0 and (0, r.parent) in members and members[0, r.parent].parent == value.value_node}
    assert below["subject", "identifier"] == "s1" and below["predicate", "identifier"] == "p1" and below["object", "language"] == "en"
    assert any(r.label == "weight" and r.scalar == "0.5" and r.value is None for r in members.values())


@pytest.mark.parametrize("given", [True, False])
def test_every_scalar_is_in_the_tables(spark, data, given):
    raw = spark.read.parquet(f"{data}/raw_records.parquet") if given else spark.createDataFrame(rows(NESTED + TEXTS), RAW)
    nodes = S.adjacency(raw)
    got = {}
    for t in (S.property_table(nodes), S.member_table(nodes)):
        for r in t.where("scalar is not null").select("record_no", "scalar").collect():
            got.setdefault(r.record_no, []).append(r.scalar)
    want = {r.record_no: scalars(r.record_fields) for r in S.current_deliveries(raw).collect()}
    assert {no: sorted(x) for no, x in got.items()} == {no: x for no, x in want.items() if x}


def test_empty(spark):
    assert S.nested_records(spark.createDataFrame([], RAW)).count() == 0


def test_deep_texts_are_no_crash(spark):
    deep = "[" * 200_000
    assert S.nested_records(spark.createDataFrame(rows([deep, '{"a":' * 100_000]), RAW)).count() == 0


@pytest.mark.parametrize("text", ["1", '"x"', "true", "[]"])
def test_no_object(text):
    assert not S.is_record_text(text)
