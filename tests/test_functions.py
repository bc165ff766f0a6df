from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialframe.functions import fingerprints as fp
from trialframe.functions import logs, objective, text
from trialframe.functions.clock import beat_seconds, expires_at


def column(spark, values, kind, expression):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    rows = df.select("i", expression(F.col("v")).alias("r")).collect()
    return [row.r for row in sorted(rows, key=lambda row: row.i)]


def canonical(value: str) -> str:
    return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"))


CONFIGS = [
    '{"b": 1, "a": 2}', '{"x": 1.0}', '{"x": 1}', '{"x": 1e-5}', '{"x": 1E5}',
    '{"k": "é"}', '{"é": 1, "z": 2, "a": 3}', '{"a": {"d": [1, 2, {"y": null, "x": true}]}}',
    '{"a": "q\\"\\n\\u0041"}', '{"n": 12345678901234567890123}', '{"n": -0}',
    '{"n": -0.0}', "[3, 1]", "7", '"text"', '{"a": 1, "a": 2}', '{"p": "a/b"}',
    '{ "s" : "1.5" }', '{"v": NaN}', '{"t": "tab\\there"}', "{}", '{"a": []}',
    '{"10": 1, "9": 2, "B": 0, "a": 1}', '{"d": "x1.5y"}', "\n{\"a\": 1}\n",
]


def test_canonical_json_equals_python(spark):
    got = column(spark, CONFIGS, "string", fp.canonical_json)
    assert got == [canonical(c) for c in CONFIGS]


def test_canonical_json_of_junk_is_null(spark):
    assert column(spark, ["{", "", None, "nope"], "string", fp.canonical_json) == [None] * 4


def test_jvm_route_is_null_or_exact(spark):
    got = column(spark, CONFIGS, "string", fp.canonical_json_jvm)
    for config, result in zip(CONFIGS, got):
        assert result is None or result == canonical(config)
    assert got[0] == '{"a":2,"b":1}'


_JSON = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(max_size=5)
    | st.floats(allow_nan=False, allow_infinity=False),
    lambda inner: st.lists(inner, max_size=3)
    | st.dictionaries(st.text(max_size=4), inner, max_size=3),
    max_leaves=8,
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), _JSON, max_size=4), min_size=1, max_size=60))
def test_canonical_json_property(spark, values):
    raw = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, v in enumerate(values)]
    raw = [r for r in raw if r.isprintable() or "\n" in r]
    raw = [r.encode("utf-8", "ignore").decode() for r in raw]
    raw = [r for r in raw if "\x00" not in r]
    if raw:
        assert column(spark, raw, "string", fp.canonical_json) == [canonical(r) for r in raw]


@pytest.mark.parametrize("project", ["p1", "café", 'quo"te', "line\n"])
def test_config_fingerprint_equals_hash_of_payload(spark, project):
    def expected(config):
        payload = {"config": json.loads(config), "objective": "maximize", "project": project}
        body = json.dumps(payload, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(body.encode()).hexdigest()[:16]

    got = column(
        spark, CONFIGS, "string",
        lambda c: fp.config_fingerprint(c, F.lit("maximize"), F.lit(project)),
    )
    assert got == [expected(c) for c in CONFIGS]


def test_jvm_fingerprint_refuses_delicate_configs(spark):
    one = lambda c: fp.config_fingerprint_jvm(c, F.lit("minimize"), F.lit("p"))
    full = lambda c: fp.config_fingerprint(c, F.lit("minimize"), F.lit("p"))
    plain = ['{"a": 1}', None]
    assert column(spark, plain, "string", one) == column(spark, plain, "string", full)
    with pytest.raises(PySparkException, match="config_fingerprint"):
        column(spark, ['{"a": 0.5}'], "string", one)


def test_diff_fingerprint_and_blank_diffs(spark):
    diffs = ["+é\n", "", " \n\t", "  ", "\x1c", None]
    got = column(spark, diffs[:1], "string", fp.text_fingerprint)
    assert got == [hashlib.sha256(diffs[0].encode()).hexdigest()[:16]]
    blank = [d is not None and bool(d.strip()) for d in diffs]
    assert column(spark, diffs, "string", fp.has_changes) == blank


LOGS = {
    "metric_value: 0.5\nmetric_value: 0.7\n": 0.5,
    "x\nmetric_value:   12\n": 12.0,
    "metric_value: -0.5": None,
    "metric_value: 1e-5": 1.0,
    "metric_value: 1.2.3": None,
    " metric_value: 1": None,
    "a\rmetric_value: 3\nmetric_value: 4": 4.0,
    "metric_value: 5": 5.0,
    "metric_value:\n6": 6.0,
    "metric_value: .5": 0.5,
    "metric_value: 5.": 5.0,
    "metric_value: .": None,
    "nothing": None,
}


def test_log_metric_rules(spark):
    assert column(spark, list(LOGS), "string", logs.log_metric) == list(LOGS.values())


def test_log_metric_with_other_patterns(spark):
    pattern = r"^loss=(?P<loss>\S+)"
    texts = ["loss=-1.5e-3", "loss=1_000", "loss=abc", "loss=1.0f", "loss=inf", "loss=1__0"]
    got = column(spark, texts, "string", lambda c: logs.log_metric(c, pattern))
    assert got == [-0.0015, 1000.0, None, None, float("inf"), None]


FLOATS = [
    0.0, 1.0, -1.5, 0.1, 0.001, 0.0001, 0.00012345, 1e-5, 1.5e-7, 1e7, 12345678.9,
    1e15, 1234567890123456.0, 1e16, 1.5e20, 1e100, 1e-100, 123456.789, 2.5e-9,
    9999999.999, 0.00099999, float("inf"), float("-inf"), -1e-5, -1e22, None,
]


def test_float_text_equals_python(spark):
    assert column(spark, FLOATS, "double", text.float_text) == [repr(f) for f in FLOATS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=200))
def test_float_text_property(spark, values):
    # Both spellings must name the same double.
    assert [float(t) for t in column(spark, values, "double", text.float_text)] == values


def test_names_and_messages(spark):
    one = spark.range(1)
    name = text.result_file_name(F.lit("0123456789abcdef"), F.lit("00000000000f"))
    fp_, run = text.key_from_file_name(name)
    bad, _ = text.key_from_file_name(F.lit("snapshot.json"))
    row = one.select(
        name.alias("name"), fp_.alias("fp"), run.alias("run"), bad.alias("bad"),
        text.new_run_id().alias("id"),
        text.keep_message(
            F.lit("a"), F.lit("b"), F.lit("loss"), F.lit(0.5), F.lit("why")
        ).alias("kept"),
        text.error_text(F.lit("ValueError"), F.lit("x")).alias("error"),
        text.audit_line(
            F.lit("a"), F.lit("b"), F.lit("f"), F.lit("r"), F.lit("loss"),
            F.lit(None).cast("double"), F.lit("failed"),
        ).alias("audit"),
    ).first()
    assert row.name == "0123456789abcdef__00000000000f.json"
    assert (row.fp, row.run, row.bad) == ("0123456789abcdef", "00000000000f", None)
    assert len(row.id) == 12 and int(row.id, 16) >= 0
    assert row.kept == "agent a [b]: loss=0.500000 keep — why"
    assert row.error == "ValueError: x"
    assert row.audit == "agent a [b]: f__r loss=None status=failed"


def test_better_is_strict_and_checks_the_objective(spark):
    df = spark.createDataFrame(
        [("minimize", 1.0, 2.0), ("minimize", 1.0, 1.0), ("maximize", 2.0, 1.0),
         ("maximize", 1.0, 1.0)], "o string, l double, r double")
    pick = objective.better(F.col("o"), F.col("l"), F.col("r"))
    assert [r[0] for r in df.select(pick).collect()] == [True, False, True, False]
    for bad in ("best", None):
        with pytest.raises(PySparkException, match="Unsupported objective"):
            df.select(objective.better(F.lit(bad).cast("string"), F.col("l"), F.col("r"))).collect()
        with pytest.raises(PySparkException, match="Unsupported objective"):
            df.select(objective.cost(F.lit(bad).cast("string"), F.col("l"))).collect()


def test_cost_drops_nan_and_turns_maximize(spark):
    values = [1.5, float("nan"), None, 0.0]
    got = column(spark, values, "double", lambda c: objective.cost(F.lit("maximize"), c))
    assert got == [-1.5, None, None, 0.0]


def test_lease_clock(spark):
    row = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS t").select(
        expires_at(F.col("t"), F.lit(90)).alias("a"),
        expires_at(F.col("t"), F.lit(0.5)).alias("b"),
        beat_seconds(F.lit(300)).alias("c"), beat_seconds(F.lit(5)).alias("d"),
    ).first()
    assert str(row.a) == "2024-01-01 00:01:30"
    assert str(row.b) == "2024-01-01 00:00:00.500000"
    assert (row.c, row.d) == (120.0, 10.0)


def test_text_after_a_value_and_deep_nesting_are_no_json(spark):
    from trialframe.functions.fingerprints import canonical_json, config_fingerprint
    from trialframe.sources.readers import is_object

    texts = ['{"a":1}x', '{"a":1} {"b":2}', '{"a":1}', ' {"a" : "x  y" , "b":[1, 2]} ', "[" * 100_000, '{"a":1,"a":2}', "-0", '{"a":1}\n']
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = df.select(
        canonical_json(F.col("c")), is_object(F.col("c")), config_fingerprint(F.col("c"), F.lit("o"), F.lit("p")).isNotNull()
    ).collect()
    want = [None, None, '{"a":1}', '{"a":"x  y","b":[1,2]}', None, '{"a":2}', "0", '{"a":1}']
    assert [r[0] for r in got] == want
    assert [r[1] for r in got] == [bool(w) and w[0] == "{" for w in want]
    assert [r[2] for r in got] == [w is not None for w in want]
