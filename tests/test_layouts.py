"""Literal event frames for the places where the layouts differ."""

import datetime as dt

import pytest

from abspark.operators.exposures import conversions, label_exposures
from abspark.plans.analyze import analyze_one, analyze_specs, skip_reasons
from abspark.sources.layouts import layout_for
from abspark.spec import (
    BOTH,
    EXCLUDE,
    FIRST,
    LAST,
    POLICIES,
    TOOL_FLAT,
    TOOL_NESTED,
    TOOL_ONE_BAG,
    TOOL_TWO_BAG,
    USER_ID_ONLY,
    USER_ID_OR_DEVICE_ID,
    ExperimentSpec,
    FilterSpec,
)

DAY = dt.date(2024, 1, 1)
VALUE = "struct<string_value:string,int_value:bigint,float_value:double,double_value:double>"
PARAMS = f"array<struct<key:string,value:{VALUE}>>"
NESTED = f"""table_suffix string, event_timestamp bigint, event_name string,
    user_pseudo_id string, user_id string, event_params {PARAMS}, user_properties {PARAMS},
    items array<struct<item_id:string,item_category:string>>,
    device struct<category:string>, score double"""
FLAT = """event_date date, time struct<event_timestamp:bigint>, event_name string,
    user_pseudo_id string, user_id string,
    event_params struct<ga_session_id:bigint,variant:string,value:double,tier:string>"""
TWO_BAG = """event_time timestamp, event_type string, device_id string, user_id string,
    session_id bigint, event_properties string, user_properties string, platform string"""
ONE_BAG = """time timestamp, event_name string, distinct_id string, user_id string,
    properties string, platform string"""


def p(key, **value):
    slots = ("string_value", "int_value", "float_value", "double_value")
    return (key, tuple(value.get(s) for s in slots))


def spec(**changes):
    base = dict(
        id="1", variant="A", date_start=DAY, date_end=DAY, conversion_event="buy",
        exp_variant_string="^A$", experiment_event_name="see",
        experiment_variant_parameter="variant", experiment_event_value_parameter="value",
    )
    return ExperimentSpec(**{**base, **changes})


def at(second):
    return dt.datetime(2024, 1, 1, 0, 0, second)


def nested(spark, rows):
    """rows: (second, name, device, user, params, properties, items, category, score)"""
    out = []
    for r in rows:
        second, name, device, user, params, props, items, category, score = (
            list(r) + [None] * 9
        )[:9]
        micros = int(dt.datetime(2024, 1, 1, 0, 0, second, tzinfo=dt.UTC).timestamp() * 1e6)
        out.append(("20240101", micros, name, device, user, params or [], props or [],
                    items, (category,), score))
    return spark.createDataFrame(out, NESTED)


def flat(spark, rows):
    """rows: (second, name, device, user, session, variant, value, tier)"""
    out = []
    for r in rows:
        second, name, device, user, session, variant, value, tier = (list(r) + [None] * 8)[:8]
        micros = int(dt.datetime(2024, 1, 1, 0, 0, second, tzinfo=dt.UTC).timestamp() * 1e6)
        out.append((DAY, (micros,), name, device, user, (session, variant, value, tier)))
    return spark.createDataFrame(out, FLAT)


def two_bag(spark, rows):
    """rows: (second, type, device, user, session, event bag, user bag, platform)"""
    out = [tuple([at(r[0]), *(list(r[1:]) + [None] * 7)[:7]]) for r in rows]
    return spark.createDataFrame(out, TWO_BAG)


def one_bag(spark, rows):
    """rows: (second, name, distinct id, user, bag, platform)"""
    out = [tuple([at(r[0]), *(list(r[1:]) + [None] * 5)[:5]]) for r in rows]
    return spark.createDataFrame(out, ONE_BAG)


def numbers(df, tool, s):
    """(users, conversions, value, squares) of one row, by both plans."""
    layout = layout_for(tool, df.schema)
    shared = analyze_specs(df, layout, [s]).first()
    single = analyze_one(df, layout, s).first()
    names = ("user_count", "conversion_count", "total_conversion_value",
             "total_conversion_sq_value")
    assert tuple(shared[n] for n in names) == tuple(single[n] for n in names)
    return tuple(shared[n] for n in names)


# Events of the same story in every layout: (second, event, unit, variant text, value)
def story(spark, tool, rows):
    if tool == TOOL_NESTED:
        return nested(spark, [
            (t, e, u, None, [p("variant", string_value=v), p("value", double_value=x)])
            for t, e, u, v, x in rows
        ])
    if tool == TOOL_FLAT:
        return flat(spark, [(t, e, u, None, 1, v, x) for t, e, u, v, x in rows])

    def bag(v, x):
        cells = [f'"variant":"{v}"'] if v is not None else []
        cells += [f'"value":{x}'] if x is not None else []
        return "{" + ",".join(cells) + "}"

    if tool == TOOL_TWO_BAG:
        return two_bag(spark, [(t, e, u, None, 1, bag(v, x), "{}") for t, e, u, v, x in rows])
    return one_bag(spark, [(t, e, u, None, bag(v, x)) for t, e, u, v, x in rows])


TOOLS = [TOOL_NESTED, TOOL_FLAT, TOOL_TWO_BAG, TOOL_ONE_BAG]


@pytest.mark.parametrize("tool", TOOLS)
def test_conversion_at_the_exposure_time(spark, tool):
    rows = [(5, "see", "u", "A", None), (5, "buy", "u", None, 2.0)]
    df = story(spark, tool, rows)
    strict = tool in (TOOL_TWO_BAG, TOOL_ONE_BAG)
    for policy in POLICIES:
        counted = numbers(df, tool, spec(user_overlap=policy))[1]
        assert counted == (None if strict and policy != LAST else 1), policy


@pytest.mark.parametrize("tool", TOOLS)
def test_first_conversion_of_the_window_decides_in_once_mode(spark, tool):
    rows = [
        (1, "buy", "u", None, 1.0), (5, "see", "u", "A", None), (9, "buy", "u", None, 2.0),
        (5, "see", "w", "A", None), (8, "buy", "w", None, 3.0), (9, "buy", "w", None, 4.0),
    ]
    df = story(spark, tool, rows)
    assert numbers(df, tool, spec()) == (2, 1, 7.0, 49.0)
    assert numbers(df, tool, spec(conversion_count_all=True)) == (2, 3, 9.0, 29.0)


@pytest.mark.parametrize("tool", TOOLS)
@pytest.mark.parametrize("count_all", [False, True])
def test_policies_on_units_that_saw_several_variants(spark, tool, count_all):
    rows = [
        (1, "see", "ab", "A", None), (3, "see", "ab", "B", None), (4, "buy", "ab", None, 1.0),
        (1, "see", "ba", "B", None), (3, "see", "ba", "A", None), (2, "buy", "ba", None, 2.0),
        (1, "see", "aa", "A", None), (2, "see", "aa", "A", None), (3, "buy", "aa", None, 4.0),
        (1, "see", "ac", "A", None), (2, "see", "ac", "C", None), (3, "buy", "ac", None, 8.0),
        (9, "see", "late", "A", None), (1, "buy", "late", None, 16.0),
    ]
    df = story(spark, tool, rows)
    expected = {  # users and value sum for A
        FIRST: (4, 13.0),  # ab, aa, ac, late
        LAST: (3, 4.0),  # ba (converted before), aa, late
        EXCLUDE: (2, 4.0),  # aa, late: a third label C rules ac out as well
        BOTH: (5, 13.0),
    }
    for policy, (users, value) in expected.items():
        got = numbers(df, tool, spec(user_overlap=policy, conversion_count_all=count_all))
        assert (got[0], got[2]) == (users, value), policy


@pytest.mark.parametrize("tool", TOOLS)
def test_ties_go_to_the_smaller_text(spark, tool):
    rows = [(1, "see", "u", "B", None), (1, "see", "u", "A", None)]
    df = story(spark, tool, rows)
    for policy in (FIRST, LAST):
        assert numbers(df, tool, spec(user_overlap=policy))[0] == 1
        b = spec(user_overlap=policy, exp_variant_string="^B$")
        assert numbers(df, tool, b)[0] == 0


@pytest.mark.parametrize("tool", TOOLS)
def test_trimming_of_the_variant_text(spark, tool):
    df = story(spark, tool, [(1, "see", "u", " A ", None), (1, "see", "v", "  ", None)])
    assert numbers(df, tool, spec())[0] == 1
    # Credit Both reads the raw text, except on the flattened layout
    assert numbers(df, tool, spec(user_overlap=BOTH))[0] == (1 if tool == TOOL_FLAT else 0)
    anything = spec(user_overlap=BOTH, exp_variant_string="^ *$")
    assert numbers(df, tool, anything)[0] == (0 if tool == TOOL_FLAT else 1)


@pytest.mark.parametrize("tool", TOOLS)
def test_nobody_exposed_and_value_missing(spark, tool):
    df = story(spark, tool, [(1, "see", "u", "A", None), (2, "buy", "u", None, None)])
    assert numbers(df, tool, spec(exp_variant_string="^Z$")) == (0, None, None, None)
    assert numbers(df, tool, spec()) == (1, 1, None, None)


def test_null_session_is_one_unit_or_none(spark):
    rows = [
        (1, "see", "d", None, [p("variant", string_value="A")]),
        (2, "see", "e", None, [p("variant", string_value="A")]),
        (3, "buy", "d", None, []),
        (4, "see", "f", None, [p("variant", string_value="A"), p("ga_session_id", int_value=7)]),
        (5, "buy", "f", None, [p("ga_session_id", int_value=7)]),
    ]
    df = nested(spark, rows)
    users = {}
    for policy in POLICIES:
        got = numbers(df, TOOL_NESTED, spec(scope="Session", user_overlap=policy))
        users[policy] = got[0]
        assert got[1] == 1  # the NULL session's conversion never matches
    assert users == {FIRST: 2, BOTH: 2, LAST: 1, EXCLUDE: 1}


def test_session_key_has_no_separator_and_one_bag_falls_back(spark):
    df = one_bag(spark, [
        (1, "see", "d", None, '{"variant":"A","session_id":"12"}'),
        (1, "see", "d1", None, '{"variant":"A","$session_id":"2"}'),
        (1, "see", "d", None, '{"variant":"A"}'),
    ])
    layout = layout_for(TOOL_ONE_BAG, df.schema)
    keys = label_exposures(df, layout, spec(scope="Session")).collect()
    assert sorted(r.key for r in keys) == ["d12", "d12"]


def test_blank_ids(spark):
    blank = [(1, "see", "", "", "A", None)]
    n = nested(spark, [(1, "see", "", "", [p("variant", string_value="A")])])
    t = two_bag(spark, [(1, "see", "", "", 1, '{"variant":"A"}', "{}")])
    o = one_bag(spark, [(1, "see", "", "", '{"variant":"A"}')])
    assert blank
    assert numbers(n, TOOL_NESTED, spec())[0] == 1  # kept on the nested layout only
    assert numbers(t, TOOL_TWO_BAG, spec())[0] == 0
    assert numbers(o, TOOL_ONE_BAG, spec())[0] == 0
    only = spec(identity_source=USER_ID_ONLY)
    assert numbers(n, TOOL_NESTED, only)[0] == 0
    assert numbers(t, TOOL_TWO_BAG, only)[0] == 0
    assert numbers(o, TOOL_ONE_BAG, only)[0] == 1  # blanks are not nulled here


def test_user_or_device_uses_the_device_for_blank_users(spark):
    either = spec(identity_source=USER_ID_OR_DEVICE_ID)
    df = two_bag(spark, [
        (1, "see", "d", "", 1, '{"variant":"A"}', "{}"),
        (2, "see", "d", "u", 1, '{"variant":"A"}', "{}"),
        (3, "see", "d", "u", 1, '{"variant":"A"}', "{}"),
    ])
    assert numbers(df, TOOL_TWO_BAG, either)[0] == 2


def test_flat_scan_ignores_the_identity_predicate(spark):
    df = flat(spark, [(1, "see", None, None, 1, "A", None), (2, "see", None, None, 1, "A", None)])
    assert numbers(df, TOOL_FLAT, spec())[0] == 1  # the NULL device is one unit
    assert numbers(df, TOOL_FLAT, spec(identity_source=USER_ID_ONLY))[0] == 0


def test_integer_event_parameter_is_no_variant(spark):
    df = nested(spark, [
        (1, "see", "u", None, [p("variant", int_value=1)]),
        (1, "see", "v", None, [], [p("variant", int_value=1)]),
        (1, "see", "w", None, [], [p("variant", double_value=1.0)]),
    ])
    assert numbers(df, TOOL_NESTED, spec(exp_variant_string="^1$"))[0] == 2


def test_property_experiment_takes_any_event(spark):
    df = nested(spark, [
        (1, "open", "u", None, [], [p("firebase_exp_3", string_value="A")]),
        (1, "open", "v", None, [], [p("firebase_exp_4", string_value="A")]),
    ])
    by_property = spec(
        experiment_event_name="firebase_exp_3", experiment_variant_parameter=None
    )
    assert numbers(df, TOOL_NESTED, by_property)[0] == 1
    assert skip_reasons(layout_for(TOOL_NESTED, df.schema), by_property) == []


@pytest.mark.parametrize(
    "tool, scope, kept_when_missing",
    [
        (TOOL_NESTED, "Event", False), (TOOL_NESTED, "User", False),
        (TOOL_NESTED, "Column", True), (TOOL_FLAT, "Event", False),
        (TOOL_TWO_BAG, "Event", True), (TOOL_TWO_BAG, "User", True),
        (TOOL_TWO_BAG, "Column", True), (TOOL_ONE_BAG, "Event", True),
        (TOOL_ONE_BAG, "User", True), (TOOL_ONE_BAG, "Column", True),
    ],
)
def test_missing_property_under_exclude(spark, tool, scope, kept_when_missing):
    df = story(spark, tool, [(1, "see", "u", "A", None)])
    field = {"Event": "tier", "User": "tier", "Column": "platform"}[scope]
    if tool == TOOL_NESTED and scope == "Column":
        field = "device.category"
    f = FilterSpec("Exclude", "Both", scope, field, "gold")
    assert numbers(df, tool, spec(filters=(f,)))[0] == int(kept_when_missing)


def test_flat_user_filter_has_no_effect(spark):
    df = flat(spark, [(1, "see", "u", None, 1, "A", None, "gold")])
    f = FilterSpec("Include", "Both", "User", "tier", "silver")
    assert numbers(df, TOOL_FLAT, spec(filters=(f,)))[0] == 1


def test_items_filter_with_empty_and_absent_arrays(spark):
    see = [p("variant", string_value="A")]
    df = nested(spark, [
        (1, "see", "full", None, see, [], [("1", "shoes"), ("2", None)]),
        (1, "see", "empty", None, see, [], []),
        (1, "see", "absent", None, see, [], None),
    ])

    def users(kind, pattern):
        f = FilterSpec(kind, "Both", "Column", "items . item_category", pattern)
        return numbers(df, TOOL_NESTED, spec(filters=(f,)))[0]

    assert users("Include", "shoe") == 1
    assert users("Exclude", "shoe") == 2
    assert users("Include", "^$") == 1  # a missing field reads as blank


def test_float_text_in_filters(spark):
    see = [p("variant", string_value="A"), p("x", double_value=1.0)]
    df = nested(spark, [(1, "see", "u", None, see, [], None, None, 25.0)])
    on_param = FilterSpec("Include", "Both", "Event", "x", "^1$")
    on_column = FilterSpec("Include", "Both", "Column", "score", "^25$")
    assert numbers(df, TOOL_NESTED, spec(filters=(on_param, on_column)))[0] == 1


def test_json_object_at_the_variant_path(spark):
    df = two_bag(spark, [
        (1, "see", "u", None, 1, '{"variant":{"a":1}}', '{"variant":"A"}'),
        (1, "see", "v", None, 1, '{"variant":"{A}"}', "{}"),
    ])
    assert numbers(df, TOOL_TWO_BAG, spec())[0] == 1  # falls through to the user bag
    assert numbers(df, TOOL_TWO_BAG, spec(exp_variant_string="^[{]A[}]$"))[0] == 1


def test_bad_number_text(spark):
    df = one_bag(spark, [
        (1, "see", "u", None, '{"variant":"A"}'), (2, "buy", "u", None, '{"value":"1.0d"}'),
        (1, "see", "v", None, '{"variant":"A"}'), (2, "buy", "v", None, '{"value":"2.5"}'),
    ])
    assert numbers(df, TOOL_ONE_BAG, spec()) == (2, 2, 2.5, 6.25)


def test_same_json_path_on_both_sides(spark):
    """A lookup needed on exposure and conversion events is read on both."""
    df = one_bag(spark, [
        (1, "see", "d1", None, '{"variant":"A","user_id":"u"}'),
        (2, "buy", "d2", None, '{"value":3,"user_id":"u"}'),
    ])
    assert numbers(df, TOOL_ONE_BAG, spec(identity_source=USER_ID_ONLY)) == (1, 1, 3.0, 9.0)


def test_quotes_in_patterns_and_keys(spark):
    df = one_bag(spark, [(1, "see", "u", None, '{"variant":"it\'s A","a\'b":"x"}')])
    f = FilterSpec("Include", "Both", "Event", "a'b", "^x$")
    s = spec(exp_variant_string="^it's A$", filters=(f,))
    assert numbers(df, TOOL_ONE_BAG, s)[0] == 1


def test_conversions_carry_the_unit_count(spark):
    df = story(spark, TOOL_ONE_BAG, [(1, "buy", "u", None, 2.0), (2, "buy", "u", None, 3.0)])
    layout = layout_for(TOOL_ONE_BAG, df.schema)
    once = conversions(df, layout, spec()).collect()
    assert [(r.key, r.conv_value, r.conv_sq_value, r.conv_count) for r in once] == [
        ("u", 5.0, 25.0, 1)
    ]


def test_rows_that_cannot_run(spark):
    df = story(spark, TOOL_NESTED, [(1, "see", "u", "A", None)])
    layout = layout_for(TOOL_NESTED, df.schema)
    bad = [
        spec(id="2", user_overlap="Whatever"),
        spec(id="3", exp_variant_string=None),
        spec(id="4", filters=(FilterSpec("Include", "Both", "Event", "x", None),)),
        spec(id="5", experiment_variant_parameter=None),
    ]
    assert all(skip_reasons(layout, s) for s in bad)
    assert [r.id for r in analyze_specs(df, layout, [spec(), *bad]).collect()] == ["1"]
    assert analyze_specs(df, layout, bad).count() == 0
