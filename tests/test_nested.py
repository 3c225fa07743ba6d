from __future__ import annotations

from pyspark.sql import types as T

from tallyshelf.operators import nested

TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_folding_keeps_every_turn(spark):
    rows = [(1, 0, "user", "a b"), (1, 1, "bot", None), (1, 1, "bot", None), (1, 5, "bot", "c"), (2, 3, None, ""), (1, 12, "user", "d")]
    turns = spark.createDataFrame([*rows, (None, 1, "user", "x"), (3, None, "user", "x")], TURNS)
    folded = nested.fold_turns(turns, 10)
    assert {(r.conv_id, r.block): [(t.turn, t.copies) for t in r.turns] for r in folded.collect()} == {
        (1, 0): [(0, 1), (1, 2), (5, 1)], (1, 1): [(12, 1)], (2, 0): [(3, 1)]}
    order = lambda row: tuple((value is not None, value) for value in row)
    assert sorted(map(tuple, nested.unfold_turns(folded).collect()), key=order) == sorted(rows, key=order)


def test_facts_of_a_block(spark):
    rows = [(1, 0, "user", " a  b\n"), (1, 1, "bot", None), (1, 5, "bot", "c"), (1, 6, None, "d e"), (1, 7, None, "f")]
    (row,) = nested.block_facts(nested.fold_turns(spark.createDataFrame(rows, TURNS))).collect()
    assert (row.n_turns, row.words_by_role, row.same_role, row.left_out) == (5, "bot:1,user:2", 2, 3)


def test_single_and_no_turns(spark):
    (row,) = nested.block_facts(nested.fold_turns(spark.createDataFrame([(1, 7, "user", "")], TURNS))).collect()
    assert (row.n_turns, row.words_by_role, row.same_role, row.left_out) == (1, "user:0", 0, 0)
    assert nested.block_facts(nested.fold_turns(spark.createDataFrame([], TURNS))).count() == 0


TEXTS = {
    1: '{"a": 1, "b": "x"}', 2: '{"a": "one", "b": "x"}', 3: '{"a": 1', 4: None, 5: "", 6: "[1, 2]", 7: '{"a": null}', 8: '{"a": 2, "c d": {"e": 1}}',
    9: "{}", 10: '{"a": 1.5}', 11: '"text"', 12: '{"a": 1, "b": {"deep": [1]}}', 13: "null",
}


def _texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id int, payload string")


def test_no_payload_is_lost(spark):
    schema = T.StructType().add("a", T.LongType()).add("b", T.StringType())
    read = {r.id: r for r in nested.read_payloads(_texts(spark), "payload", schema).collect()}
    assert {i: r.state for i, r in read.items()} == {
        1: "fits", 2: "misfit", 3: "broken", 4: "missing", 5: "broken", 6: "broken", 7: "fits", 8: "surplus", 9: "fits", 10: "misfit",
        11: "broken", 12: "fits", 13: "broken"}
    assert read[2].payload.a is None and read[2].payload.b == "x"
    assert read[12].payload.b == '{"deep":[1]}'
    assert all(r.raw == (None if r.state == "fits" else TEXTS[i]) for i, r in read.items())
    assert all(r.payload is None for r in read.values() if r.state in ("broken", "missing"))


def test_schema_learned_from_a_sample_and_what_misses_it(spark):
    rows = spark.createDataFrame([(1, '{"n": 1, "x": 2.5, "list": [1]}'), (2, '{"n": 3}'), (3, "broken")], "id int, payload string")
    schema = nested.learned_schema(rows, "payload")
    assert {f.name: f.dataType.simpleString() for f in schema.fields} == {"n": "bigint", "x": "double", "list": "array<bigint>"}
    more = rows.unionByName(spark.createDataFrame([(4, '{"n": "many"}'), (5, '{"new": 1}'), (6, '{"x": 12345.678}')], rows.schema))
    states = nested.payload_states(nested.read_payloads(more, "payload", schema))
    assert {r.state: r.row_count for r in states.collect()} == {"fits": 3, "misfit": 1, "surplus": 1, "broken": 1}


def test_fields_of_several_types_are_text(spark):
    rows = spark.createDataFrame([('{"n": 1, "v": null}',), ('{"n": "a"}',)], "payload string")
    schema = nested.learned_schema(rows, "payload")
    assert {f.name: f.dataType.simpleString() for f in schema.fields} == {"n": "string", "v": "string"}
    assert {r.state for r in nested.read_payloads(rows, "payload", schema).collect()} == {"fits"}


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(None,), ("[1]",)], "payload string")
    schema = nested.learned_schema(rows, "payload")
    assert schema.names == []
    assert sorted(r.state for r in nested.read_payloads(rows, "payload", schema).collect()) == ["broken", "missing"]
