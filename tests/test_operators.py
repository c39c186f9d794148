"""Operators on small tables of their own."""

import random
import string

import pytest
from pyspark.sql import functions as F

from emberlens import queries
from emberlens.case import evidence, redaction, report
from emberlens.functions import predicates as P
from emberlens.functions.normalise import rfc3339
from emberlens.functions.templates import template
from emberlens.operators import catalog, compare, correlate, explore, findings, metrics, patterns, stacks, traces

SECOND = explore.SECOND
MINUTE = 60 * SECOND
COLUMNS = "record_id string, dataset_id string, event_time long, severity_number int, severity_text string, display_message string, operation string, outcome string, request_id string, message_id string, resource_id string, source_id string, record_number long, attributes_json string, trace_id string, span_id string"


def log(i, **kw):
    row = dict.fromkeys(c.split()[0] for c in COLUMNS.split(", "))
    return row | {"record_id": f"r{i:03d}", "dataset_id": "a", "display_message": "m", "record_number": i, "source_id": "s", "resource_id": "x", "attributes_json": "{}"} | kw


def table(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)


def ids(df):
    return sorted(r["record_id"] for r in df.collect())


@pytest.fixture(scope="module")
def some(spark):
    rows = [log(i, event_time=None if i % 9 == 0 else (i // 3) * SECOND, severity_number=[17, None, 13, 9][i % 4], severity_text=["ERROR", "warn", "Warn", None][i % 4], display_message=["Café-crème brûlée", "one two three", "Über alles", "tail"][i % 4], attributes_json=['{"n":{"t":"int","v":5},"a.b":{"t":"str","v":"x"}}', '{"n":{"t":"str","v":"5x"},"e":{"t":"empty"}}', "{}", '{"m":{"t":"map","v":{"k":{"t":"double","v":1.5}}}}'][i % 4]) for i in range(40)]
    return table(spark, rows).cache()


def test_leaves_are_two_valued(some):
    every = some.count()
    for p in (P.severity("=", "ERROR"), P.severity(">=", "WARN"), P.attribute_compare(("n",), ">", 3), P.attribute_exists("e"), P.phrase("two three"), P.wildcard(F.col("display_message"), "t?il"), P.compare(F.col("event_time"), "<", 5 * SECOND), P.attribute_compare(("m", "k"), "=", 1.5)):
        assert some.where(p).count() + some.where(~p).count() == every
    assert some.where(P.severity("=", "WARN")).count() == 20  # by number, and by text where there is none
    assert some.where(P.attribute_exists("e")).count() == 0 and some.where(P.attribute_compare(("a.b",), "=", "x")).count() == 10
    assert some.where(P.severity_exists()).count() == 40 and some.where(P.phrase("")).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, some, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    some.write.parquet(f"file://{tmp_path}/logs")
    logs = spark.read.parquet(f"file://{tmp_path}/logs")
    where = P.severity_number(">=", 13) & P.compare(P.field("operation"), "=", "pay") & ~P.compare(P.field("outcome"), "=", "x")
    text = plan(explore.counts(logs, where, explore.absolute(0, 5)))
    for part in ("GreaterThanOrEqual(severity_number,13)", "EqualNullSafe(operation,pay)", "Not(EqualNullSafe(outcome,x))"):
        assert part in text, text
    assert "display_message" not in text.split("ReadSchema")[1]
    text = plan(explore.scoped(logs, where, explore.absolute(0, 5)).select("record_id"))
    assert "GreaterThanOrEqual(event_time,0)" in text and "LessThan(event_time,5)" in text
    text = plan(explore.facets(logs, {"a": F.col("operation"), "b": F.col("outcome")}))
    assert "WindowGroupLimit" in text and text.count("FileScan") <= 2
    assert "WindowGroupLimit" in plan(correlate.members(correlate.with_key(logs), 256))


@pytest.mark.parametrize("text, n", [("café", 10), ("CRÈME", 10), ("creme", 0), ("über", 10), ("one three", 0), ("One   TWO", 10), ("tai", 0), ("crème-brûlée", 10)])
def test_phrases(some, text, n):
    assert some.where(P.phrase(text)).count() == n


def test_wildcards_and_regexes(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("a\nb",), ("a*b",), ("A.B",), ("ab\n",)], "v string")
    hits = lambda p: sorted(r["v"] for r in df.where(p).collect())
    assert hits(P.wildcard(F.col("v"), "a.b")) == ["a.b"] and hits(P.wildcard(F.col("v"), r"a\*b")) == ["a*b"] and hits(P.wildcard(F.col("v"), "ab")) == []
    assert hits(P.regex(F.col("v"), r"a\.b", True)) == ["A.B", "a.b"]
    for bad in (r"(?=x)", r"(?<!x)y", r"(a)\1"):
        with pytest.raises(ValueError):
            P.regex(F.col("v"), bad)


def test_what_is_refused(spark):
    for f in (lambda: P.field("nope"), lambda: P.severity_number("=", 25), lambda: P.attribute_compare(("a",), "<", "x"), lambda: explore.facets(None, {str(i): None for i in range(9)}), lambda: metrics.rollup(None, "m", 0), lambda: correlate.with_key(None, "span_id")):
        with pytest.raises(ValueError):
            f()


def test_pages_meet_without_gaps(some):
    want = [r["record_id"] for r in some.orderBy(*explore.canonical_order()).collect()]
    seen, cursor = [], None
    while True:
        rows = explore.page(some, limit=7, cursor=cursor).collect()
        seen += [r["record_id"] for r in rows[:7]]
        if len(rows) <= 7:
            break
        cursor = explore.cursor_of(rows[6])
    assert seen == want
    back, cursor = [want[-1]], explore.cursor_of(some.where(F.col("record_id") == want[-1]).first())
    while rows := explore.page(some, limit=7, cursor=cursor, backward=True).collect()[:7]:
        back += [r["record_id"] for r in rows]
        cursor = explore.cursor_of(rows[-1])
    assert back == want[::-1]


def test_operators_agree(some):
    where, window = P.severity(">=", "INFO"), explore.absolute(2 * SECOND, 11 * SECOND)
    n = explore.counts(some, where, window).first()
    assert n["matching"] == explore.scoped(some, where, window).count() == sum(r["n"] for r in explore.histogram(some, where, window).collect())
    assert n["matching"] == sum(r["n"] for r in explore.facets(some, {"s": explore.severity_value()}, where, window).collect())
    assert n["omitted_untimestamped"] == some.where(where).where("event_time is null").count()
    facet = explore.facets(some, {"text": F.col("severity_text")}, most=1).first()
    assert (facet["value"], facet["n"], facet["missing"], facet["truncated"]) == ("ERROR", 10, 10, True)
    empty = some.where("false")
    assert explore.relative_to_latest(empty, 5).empty_anchor and explore.histogram(empty).count() == 0


def test_estimated_distinct_values_are_close(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id") % 5_000).alias("v"), F.col("id").alias("event_time"))
    rough, exact = (explore.summary(rows, F.col("v"), exact_to=n).first() for n in (10, 10_000))
    assert (exact["distinct"], exact["exact"], exact["present"], exact["missing"]) == (5_000, True, 20_000, 0)
    assert not rough["exact"] and abs(rough["distinct"] - 5_000) < 750


def test_dimensions(some):
    names = some.sparkSession.createDataFrame([("x", "checkout")], "resource_id string, name string")
    found = explore.with_dimension(some, names, "resource_id")
    assert found.where("resource.name = 'checkout'").count() == 40 == found.count()
    assert explore.with_dimension(some, names.limit(0), "resource_id").where("resource is null").count() == 40


def test_widths():
    assert [explore.bin_width(s * SECOND, 60) * 1000 // SECOND for s in (1, 10, 61, 120, 3600, 86_400 * 3)] == [25, 250, 5_000, 5_000, 300_000, 10_800_000]
    assert explore.bin_width(10**19, 60) == 10**19 // 60 + 1


@pytest.mark.parametrize(
    "message, want",
    [
        ("GET /api/users/42 took 15ms", "GET <path> took <dur>"), ("at 2024-01-02T03:04:05Z id=7", "at <ts> id=7"), ("(12.5) [0xFF], 10.0.0.1:80;", "(<num>) [<hex>], <ip>:<port>;"),
        ("'a b' 'ab' \"x\"", "'a b' <q> <q>"), ("user 550e8400-e29b-41d4-a716-446655440000!", "user <uuid>!"), ("4bf92f3577b34da6 4kB 4KB 1.5GiB", "<id> 4kB <size> <size>"),
        ("deadbeef1 deadbeef", "<hex> deadbeef"), ("http://x/y C:\\tmp\\a  10:11:12,5 ::1 -5 +1.5 µs 3µs", "<url> <path> <ts> <ip> <num> <num> µs <dur>"), ("", ""), ("...", "..."), ("plain Words", "plain Words"),
    ],
)
def test_templates(spark, message, want):
    assert spark.createDataFrame([(message,)], "m string").select(template(F.col("m"))).first()[0] == want


def test_template_bounds(spark):
    rows = [("x " * 600,), ("é" * 5000,), ("é" * 4096,)]
    a, b, c = (r[0] for r in spark.createDataFrame(rows, "m string").select(template(F.col("m"))).collect())
    assert a == " ".join(["x"] * 512 + ["<truncated>"]) and b == "é" * 4096 + " <truncated>" and c == "é" * 4096
    assert spark.createDataFrame([("7 8ms",)], "m string").select(template(F.col("m"), ("duration",))).first()[0] == "7 <dur>"


STACKS = {
    "java": "com.acme.PayException: no\n\tat com.acme.Cart.pay(Cart.java:12)\n\tat com.acme.Main.main(Main.kt:3)\nCaused by: java.io.IOException: x\n\t... 3 more",
    "dotnet": "System.NullReferenceException: x\n   at Acme.Cart.Pay(Int32 a) in C:\\src\\Cart.cs:line 12\n ---> System.IO.IOException: y",
    "python": 'Traceback (most recent call last):\n  File "/srv/app/pay.py", line 3, in pay\n    boom()\nValueError: x',
    "go": "panic: runtime error: index out of range\n\ngoroutine 1 [running]:\nmain.pay(0x1)\n\t/src/pay.go:12 +0x45",
    "node": "TypeError: x\n    at pay (/srv/pay.js:1:2)\n    at async /srv/x.js:3:4",
}


@pytest.mark.parametrize("form", STACKS)
def test_stacks(form):
    got = stacks.parse(STACKS[form])
    assert got[0] == form and got[1] == "parsed" and got[3]
    moved = STACKS[form].replace("12", "99")
    assert stacks.parse(moved)[6] == got[6] != stacks.parse(STACKS[form].replace("pay", "buy").replace("Pay", "Buy"))[6]


def test_stack_qualities():
    assert stacks.parse("java.lang.Error")[1] == "partial" and stacks.parse("hello there")[1] == "malformed" and stacks.parse(None)[0] == "none"
    many = "a.B: x\n" + "\tat a.B.c(B.java:1)\n" * 200
    assert stacks.parse(many)[5] and len(stacks.parse(many)[3]) == 128
    assert stacks.parse(STACKS["java"])[4] == ["java.io.IOException"]


FAMILIES = {"steady": (20, 20), "spike": (10, 40), "calmed": (40, 10), "fresh": (0, 12), "old": (12, 0), "rare": (2, 3)}


def test_comparison_classes(spark):
    hour = 3600 * SECOND
    rows = [log(0, operation=k, event_time=w * hour + i) for k, pair in FAMILIES.items() for w, n in enumerate(pair) for i in range(n)] + [log(i, operation="steady") for i in range(4)]
    df = table(spark, rows)
    got = {r["key"]: (r["classification"], r["rate_change_bp"]) for r in compare.compare(df, F.col("operation"), (0, hour), (hour, 2 * hour)).collect()}
    assert got == {"steady": ("unchanged", "0"), "spike": ("increased", "30000"), "calmed": ("decreased", "-7500"), "fresh": ("new", "undefined"), "old": ("disappeared", "-10000"), "rare": ("insufficient", "5000")}
    left = compare.left_out(df, F.col("operation"), (0, hour), (hour, 2 * hour)).first()
    assert (left["accepted_baseline"], left["accepted_suspect"], left["undated"]) == (84, 85, 4)


def test_retries(spark):
    spec = [("k1", None, None, "pay", "failure"), ("k1", None, None, "pay", None), ("k2", 1, None, "pay", None), ("k2", 2, None, "pay", None), ("k3", 1, None, "pay", None), ("k3", 1, None, "pay", None), ("k4", None, None, "a", None), ("k4", None, None, "b", None), ("k5", None, None, "a", None), ("k5", None, None, "a", None), ("k6", None, None, None, "failure"), ("k6", 1, None, None, None)]
    rows = [log(i, request_id=k, operation=op, outcome=out, event_time=i * SECOND, attributes_json="{}" if a is None else f'{{"attempt":{{"t":"int","v":{a}}}}}') for i, (k, a, _, op, out) in enumerate(spec)]
    found = correlate.retries(correlate.members(correlate.with_key(table(spark, rows))), P.attribute("attempt").try_cast("bigint"))
    assert {r["key"]: r["strength"] for r in found.collect()} == {"k1": "corroborated", "k2": "documented", "k5": "indicative", "k6": "documented"}


def test_gaps_skews_and_duplicates(spark):
    rows = [
        log(1, request_id="k", event_time=0), log(2, request_id="k", event_time=10 * MINUTE, display_message="z"), log(3, request_id="k", event_time=9 * MINUTE, message_id="a", operation="o", display_message="d"),
        log(4, request_id="k", event_time=11 * MINUTE, message_id="a", display_message="d"), log(5, request_id="k", event_time=12 * MINUTE, message_id="b", display_message="d"), log(5, request_id="j", event_time=0), log(5, request_id="j", event_time=1),
    ]
    m = correlate.members(correlate.with_key(table(spark, rows)))
    assert [(r["from_id"], r["to_id"], r["strength"]) for r in correlate.gaps(m).collect()] == [("r001", "r003", "corroborated")]
    assert [(r["from_id"], r["to_id"], r["delta"]) for r in correlate.clock_skews(m).where("key = 'k'").collect()] == [("r002", "r003", -MINUTE)]
    assert [(r["from_id"], r["to_id"], r["strength"]) for r in correlate.duplicates(m).collect()] == [("r003", "r004", "documented")]


def test_groups_cap_and_keys(spark):
    rows = [log(i, request_id=" ID-A " if i < 5 else "", trace_id="a" * 32 if i % 2 else "zz", span_id="b" * 16 if i == 1 else None, event_time=i if i else None) for i in range(8)]
    df = table(spark, rows)
    keyed = correlate.with_key(df, trim=True, prefix="ID-", fold=True)
    g = correlate.groups(keyed, most_in_group=3).first()
    assert (g["key"], g["size"], g["undated"], g["kept"], g["truncated"]) == ("a", 5, 1, 3, 1) and keyed.first()["key_steps"] == "trim,strip_prefix,case_fold"
    assert ids(correlate.members(keyed, 3)) == ["r002", "r003", "r004"]
    assert {r["rejection"]: r["n"] for r in correlate.rejections(correlate.with_key(df, "trace_span")).collect()} == {"incomplete_pair": 7}
    assert {r["rejection"]: r["n"] for r in correlate.rejections(correlate.with_key(df, "trace_id")).collect()} == {"not_canonical": 4}
    near = correlate.neighbourhood(df, 4, "r004", 2, {"resource_id": "x"})
    assert [r["record_id"] for r in near.collect()] == ["r003", "r005", "r002", "r006"]


def test_correlation_without_bounds_and_what_bounds_drop(spark):
    rows = [log(i, request_id=f"k{i % 3}", event_time=i) for i in range(900)] + [log(900 + i, request_id="u") for i in range(2)]
    keyed = correlate.with_key(table(spark, rows))
    assert correlate.members(keyed, None).count() == 900 and correlate.edges(correlate.members(keyed, None), None).count() == 897
    assert {(r["kept"], r["truncated"]) for r in correlate.groups(keyed, None, None).collect()} == {(300, 0), (0, 0)}
    assert tuple(correlate.dropped(keyed, None, None, None).first()) == (0, 0, 0)
    assert tuple(correlate.dropped(keyed, 1).first()) == (3, 3 * 44, 897 - correlate.edges(correlate.members(keyed, 256), 32).count())
    assert correlate.edges(correlate.members(keyed)).count() == 897 and correlate.groups(keyed).count() == 4


def test_slices_of_a_key_meet(spark, monkeypatch):
    rng = random.Random(8)
    rows = [log(i, request_id=rng.choice("aab"), operation=rng.choice(["x", "y"]), event_time=rng.choice([None, rng.randrange(-500, 500)]), display_message=rng.choice("pq"), source_id=rng.choice("st")) for i in range(300)]
    m = correlate.members(correlate.with_key(table(spark, rows)))
    every = lambda: [sorted(map(str, of(m).collect())) for of in (correlate.edges, correlate.retries, correlate.duplicates, lambda x: correlate.gaps(x, 3), lambda x: correlate.clock_skews(x, 3))]
    by_key = {}
    for r in sorted((r for r in rows if r["event_time"] is not None), key=lambda r: (r["event_time"], r["record_id"])):
        by_key.setdefault(r["request_id"], []).append(r)
    want = sorted((a["record_id"], b["record_id"]) for of in by_key.values() for a, b in zip(of, of[1:]))
    wide = every()
    assert sorted((r["from_id"], r["to_id"]) for r in correlate.edges(m).collect()) == want
    for width in (1, 37):
        plain = correlate._pairs
        monkeypatch.setattr(correlate, "_pairs", lambda rows, by, order, take, old=None, w=width: plain(rows, by, order, take, w))
        assert every() == wide
        monkeypatch.undo()


@pytest.mark.parametrize("hot", [0, 150, 10**6])
def test_rows_of_keys_are_shuffled_once(spark, monkeypatch, hot):
    """Hot keys are cut into slices, all others are one task's; with none that is hot the rows are shuffled once."""
    monkeypatch.setattr(correlate, "HOT_KEY", hot)
    monkeypatch.setattr(correlate, "SLICE", 7)
    rng = random.Random(5)
    rows = [log(i, request_id=rng.choice(["a", "a", "a", "b", "c"]), event_time=rng.randrange(-500, 500)) for i in range(400)]
    found = correlate.edges(correlate.members(correlate.with_key(table(spark, rows))))
    by_key = {}
    for r in sorted(rows, key=lambda r: (r["event_time"], r["record_id"])):
        by_key.setdefault(r["request_id"], []).append(r)
    want = sorted((k, a["record_id"], b["record_id"], b["event_time"] - a["event_time"]) for k, of in by_key.items() for a, b in zip(of, of[1:]))
    execution = found._jdf.queryExecution()
    got = sorted(tuple(r.apply(i) for i in range(4)) for r in execution.executedPlan().executeCollectPublic())
    assert got == want
    ran = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in ran.splitlines() if "Exchange hashpartitioning" in line]
    assert hot < 10**6 or len(shuffles) == 1, ran


def test_what_signals_rest_on(spark):
    rows = [log(1, request_id="k", event_time=0, operation="o", outcome="failed", provenance_json='{"flags":["timezone_assumed"]}'), log(2, request_id="k", event_time=10 * MINUTE, operation="o", provenance_json='{"flags":[]}')]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS + ", provenance_json string")
    found = {r["kind"]: r for r in correlate.signals(correlate.members(correlate.with_key(df))).collect()}
    assert (found["retry"]["strength"], found["retry"]["matched"], found["retry"]["missing"], found["retry"]["lead"]) == ("corroborated", ["operation", "outcome"], ["attempt"], True)
    assert (found["gap"]["strength"], found["gap"]["missing"], found["gap"]["tolerance"]) == ("indicative", ["earlier_timestamp_observed"], correlate.GAP)
    assert "attempt" in found["retry"]["reason"] and found["retry"]["signal_id"] != found["gap"]["signal_id"]
    assert [r["quality"] for r in df.select("record_id", correlate.time_quality(df).alias("quality")).orderBy("record_id").collect()] == ["inferred", "observed"]


def test_times_and_types_of_literals(some):
    assert P.instant("2024-05-01T10:00:00.5+02:00") == 1714550400 * SECOND + SECOND // 2 and P.instant("1970-01-02") == 86_400 * SECOND and P.instant("1969-12-31T23:59:59.999999999Z") == -1
    assert some.where(P.time_compare("<", "1970-01-01T00:00:05Z")).count() == some.where("event_time < 5000000000").count()
    assert some.where(P.attribute_typed(("m", "k"), "=", "1.5", "double")).count() == 10 and some.where(P.attribute_typed(("n",), "=", "5x", "int,str")).count() == 10
    for f in (lambda: P.instant("noon"), lambda: P.attribute_typed(("n",), "<", "5", "int,str"), lambda: P.attribute_typed(("n",), "=", "x", "int"), lambda: P.attribute("it's"), lambda: P.attribute("a\\b")):
        with pytest.raises(ValueError):
            f()
    assert P.quoted('a"b\\') == '"a\\"b\\\\"'
    with pytest.raises(ValueError):
        explore.datasets(some, ["a", "none"])
    assert explore.datasets(some, ["a"]).count() == 40


def test_findings(spark):
    rows = spark.createDataFrame([("a", 0, 60, 60, 17, "new", "undefined"), ("b", 10, 40, 50, 21, "increased", "30000"), ("c", 6, 0, 6, None, "disappeared", "-10000"), ("d", 1, 1, 2, 9, "unchanged", "0")], "key string, baseline long, suspect long, combined long, ceiling int, classification string, rate_change_bp string")
    got = {(r["rule"], r["severity"], r["magnitude"]) for r in findings.from_comparison(rows).collect()}
    assert got == {("new-high-severity-pattern", "high", "large"), ("increased-error-pattern", "high", "large"), ("disappeared-pattern", "informational", "small")}
    assert [r['rule'] for r in findings.ordered(findings.from_comparison(rows)).collect()][-1] == 'disappeared-pattern'
    c = findings.concentrated(rows, "key").first()
    assert c["measured"] == 10000 and c["magnitude"] == "large"


def test_trace_annotations(spark):
    spans = [("1", "t", "a", None, 10, 20), ("2", "t", "b", "a", 12, 15), ("3", "t", "c", "gone", 12, 15), ("4", "t", "d", "a", 12, None), ("5", "t", "b", "a", 13, 15), ("6", "t", "e", "a", 5, 8), ("7", "u", "x", "a", 1, 2)]
    df = spark.createDataFrame([(*s, None) for s in spans], "record_id string, trace_id string, span_id string, parent_span_id string, start_time long, end_time long, links_json string")
    flags = ("duplicate_span_id", "missing_end", "clock_skew_before_parent", "orphan_parent", "root")
    got = {r["record_id"]: {f for f in flags if r[f]} for r in traces.nodes(df).collect()}
    assert got == {"1": {"root"}, "2": {"duplicate_span_id"}, "3": {"orphan_parent"}, "4": {"missing_end"}, "5": {"duplicate_span_id"}, "6": {"clock_skew_before_parent"}, "7": {"orphan_parent"}}
    # each child row has an edge of its own, the two spans "b" too
    assert traces.trace(df, "t").count() == 6 and traces.parent_edges(df).count() == 4 and traces.trace(df, "t", 2).first()["truncated"]
    assert [tuple(r) for r in traces.unresolved(df).collect()] == [("t", "gone", "c"), ("u", "a", "x")]
    assert {r["trace_id"]: r["missing_root"] for r in traces.integrity(df).collect()} == {"t": False, "u": True}
    late = spark.createDataFrame([("1", "t", "p", None, 10, 40, None), ("2", "t", "p", None, 30, 40, None), ("3", "t", "c", "p", 20, 25, None)], df.schema)
    assert traces.nodes(late).where("clock_skew_before_parent").first()["record_id"] == "3"  # the later of two parents counts


def test_rollup(spark):
    points = [("m", "gauge", None, t * SECOND, None, float(v)) for t, v in ((1, 10), (30, 20), (70, 50))] + [("m", "sum", "delta", t * SECOND, v, None) for t, v in ((10, 4), (50, 6), (80, 5))] + [("m", "sum", "cumulative", 20 * SECOND, 1000, None)]
    df = spark.createDataFrame(points, "metric_name string, metric_type string, temporality string, time long, value_int long, value_double double")
    got = sorted((r["metric_type"], r["bucket"] // SECOND, r["points"], r["total"], r["mean"]) for r in metrics.rollup(df, "m", MINUTE).collect())
    assert got == [("gauge", 0, 2, 30.0, 15.0), ("gauge", 60, 1, 50.0, 50.0), ("sum", 0, 2, 10.0, 5.0), ("sum", 60, 1, 5.0, 5.0)]


def test_catalog(some):
    got = {r["path"]: (r["types"], r["present"], r["distinct"]) for r in catalog.field_catalog(some).collect()}
    assert got == {"n": ("int,str", 20, 2), "a.b": ("str", 10, 1), "e": ("empty", 0, 0), "m.k": ("double", 10, 1)}
    assert catalog.merged(catalog.field_catalog(some)).where("path = 'n'").first()["types"] == "int,str"
    rough = {r["path"]: (r["types"], r["present"], r["distinct"], r["exact"]) for r in catalog.field_catalog(some, exact_to=1).collect()}
    assert rough == {p: (*x, p != "n") for p, x in got.items()}
    few = catalog.bounded(catalog.field_catalog(some), 2).collect()
    assert {(r["path"], r["cut"]) for r in few} == {("n", 2), ("a.b", 2)} and next(r for r in few if r["path"] == "n")["examples"] == ["5", "5x"]
    twice = some.sparkSession.createDataFrame([("d", '{"a.b":{"t":"int","v":1},"a":{"t":"map","v":{"b":{"t":"int","v":2}}}}')], "dataset_id string, attributes_json string")
    assert catalog.merged(catalog.field_catalog(twice)).first()["ambiguous"]


def test_pattern_fold(spark):
    rows = [log(i, display_message=f"job {i} done in {i}ms", event_time=None if i < 3 else i * SECOND) for i in range(33)] + [log(100 + i, display_message=f"disk {i}%", event_time=i * MINUTE) for i in range(20)]
    got = patterns.run(patterns.with_template(table(spark, rows))).collect()
    assert (got[0]["template"], got[0]["n"], got[0]["undated"], got[0]["latest_record"]) == ("job <num> done in <dur>", 33, 3, "r032") and len(got) == 21
    assert got[0]["peak_bucket"] == 0 and got[0]["peak_n"] == 30
    assert patterns.drill(table(spark, rows), got[0]["pattern_id"]).count() == 33


def test_comparisons_keep_all_keys(spark):
    n = 10_500
    logs = spark.range(n * 6).select((F.col("id") % 2).alias("event_time"), (F.col("id") % n).cast("string").alias("request_id"), F.lit(17).alias("severity_number"))
    rows = compare.compare(logs, F.col("request_id"), (0, 1), (1, 2))
    counts = rows.agg(F.count("*"), F.sum("baseline"), F.sum("suspect")).first()
    assert tuple(counts) == (n, n * 3, n * 3)
    best = rows.orderBy(F.desc("combined"), "key").limit(20).agg(F.sum("baseline"), F.sum("suspect")).first()
    assert tuple(compare.remainder(rows, 20).first()) == (counts[0], counts[0] - 20, counts[1] - best[0], counts[2] - best[1])
    assert findings.from_comparison(rows).count() == n
    assert tuple(compare.remainder(rows, 20_000).first())[1:] == (0, 0, 0) and tuple(compare.remainder(rows.limit(0)).first()) == (0, 0, 0, 0)


def test_patterns_of_whole_texts_have_no_cap(spark):
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    texts = [f"same first line\n{'word ' * 3000}{w} {i}" for i, w in enumerate(words)] + ["common 7"] * 3 + ["(1" + "." * 200_000 + "x"]
    rows = spark.createDataFrame([(f"r{i:03}", None, t.split("\n")[0], t, "x") for i, t in enumerate(texts)], "record_id string, event_time long, display_message string, body string, resource_id string")
    whole = patterns.with_template(rows, F.col("body"), bounded=False)
    got = patterns.run(whole).collect()
    assert len(got) == 62 and (got[0]["template"], got[0]["n"]) == ("common <num>", 3)
    assert {r["template"] for r in got[1:]} >= {f"same first line {'word ' * 3000}{w} <num>" for w in words}
    kept = patterns.run(whole, 2).collect()
    assert [(r["example"], r["cut"]) for r in kept] == [("r060", 60), ("r063", 60)] and patterns.run(whole, 99).first()["cut"] == 0


def test_pattern_queries_are_whole(spark, tmp_path):
    texts = ["first\n" + "x " * 9000 + "end", "first\n" + "x " * 9000 + "other"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert {r["template"] for r in queries.pattern_documents(spark, f"file://{tmp_path}").collect()} == {t.replace("\n", " ") for t in texts}


def test_export_bounds(some):
    lines = explore.jsonl_rows(some)
    whole, cut = explore.export(lines, [F.col("record_id")])
    assert whole.count() == 40 and not cut
    part, cut = explore.export(lines, [F.col("record_id")], most_rows=7)
    assert part.count() == 7 and cut
    one = lines.orderBy("record_id").first()["line"]
    part, cut = explore.export(lines, [F.col("record_id")], most_bytes=len(one.encode()) + 1)
    assert part.count() == 1 and cut


def test_formula_guard(spark):
    df = table(spark, [log(1, display_message="=1+1"), log(2, display_message="ok")])
    assert sorted(r["message"] for r in explore.csv_rows(df).collect()) == ["'=1+1", "ok"]
    assert explore.csv_rows(df).columns == list(explore.CSV_COLUMNS)


@pytest.mark.parametrize("nanos, text", [(0, "1970-01-01T00:00:00Z"), (1_700_000_000_120_000_000, "2023-11-14T22:13:20.120Z"), (1_700_000_000_000_000_001, "2023-11-14T22:13:20.000000001Z"), (-1_000, "1969-12-31T23:59:59.999999Z"), (None, None)])
def test_instants_as_text(spark, nanos, text):
    assert spark.createDataFrame([(nanos,)], "n long").select(rfc3339(F.col("n"))).first()[0] == text


def test_queryable_names(spark):
    rows = [log(i, attributes_json=f'{{{name}:{{"t":"int","v":1}}}}') for i, name in enumerate(('"a-b.c@d"', '"a b"', '"x$"', '"é"', '"q?"'))]
    got = {r["path"]: r["queryable"] for r in catalog.field_catalog(table(spark, rows)).collect()}
    assert got == {"a-b.c@d": True, "a b": False, "x$": False, "é": True, "q?": False}


def test_case(spark, some):
    a = evidence.pin_selection(some, "e1", ["r001", "r002"], "two")
    b = evidence.pin_query(some, "e2", P.severity("=", "ERROR"), explore.absolute(0, 9 * SECOND))
    lost = spark.createDataFrame([("e3", "event", "a", None, ["gone"], 1, None, None, "")], evidence.PINS)
    pins = evidence.with_revisions(a.unionByName(b), some).unionByName(lost)
    states = {r["evidence_id"]: r["state"] for r in evidence.verify(pins, some).collect()}
    assert states == {"e1": "verified", "e2": "verified", "e3": "broken"}
    drift = spark.createDataFrame([("e2", 99)], "evidence_id string, n long")
    assert {r["evidence_id"]: r["state"] for r in evidence.verify(pins, some, drift).collect()}["e2"] == "query_drift"
    fewer = some.where("record_id <> 'r001'")
    assert {r["evidence_id"]: r["state"] for r in evidence.verify(pins, fewer).collect()}["e1"] == "partially_resolved"
    markers = spark.createDataFrame([("m1", 0, None, "start"), ("m0", None, None, "note")], "id string, at long, until long, title string")
    line = evidence.timeline(pins, some, markers)
    assert [r["id"] for r in line.orderBy("place").collect()] == ["m1", "e1", "e2", "e3", "m0"] or [r["id"] for r in line.orderBy("place").collect()][-2:] == ["e3", "m0"]
    verified = evidence.verify(pins, some)
    text = report.markdown("A | case", line, verified)
    assert text.startswith("# A \\| case") and "undated: the marker has no time" in text and "<h1>A | case</h1>" in report.web("A | case", line, verified)
    data = report.bundle("A", pins, line, verified, report.subset(pins, some))
    assert data == report.bundle("A", pins, line, verified, report.subset(pins, some)) and "data/logs.jsonl" in report.open_bundle(data)
    with pytest.raises(ValueError):
        report.open_bundle(data.replace(b"report.md", b"report.mx"))


def test_redaction(spark):
    df = spark.createDataFrame([("u1", "call 555 and 555", "/var/log/a.log", "x" * 20, 5)], "user string, msg string, path string, long_text string, n int")
    p = redaction.Profile((("replace_exact", "555", "<n>"), ("pseudonymize", "user", "p"), ("mask", "n")), path_policy="basename", most_chars=16)
    row = redaction.redact(df, p).first()
    assert row["msg"].startswith("call <n> and <n>") and row["path"] == "a.log" and row["user"].startswith("p-") and row["n"] == "[masked]" and row["long_text"].startswith("x" * 16 + " …") and row["redactions"] == 6
    assert redaction.redact(df, redaction.Profile(allow=("msg",))).columns == ["msg", "redactions"]
    for bad in ((("nope",),), (("replace_exact", "", "x"),)):
        with pytest.raises(ValueError):
            redaction.Profile(bad)


def test_random_texts_never_fail(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(string.printable + "éß😀") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    assert df.select(template(F.col("m")).alias("t")).where("t is not null").count() == 300
    for t in texts[:60]:
        df.where(P.phrase(t, F.col("m")) | P.wildcard(F.col("m"), t)).limit(1).collect()
        stacks.parse(t)
