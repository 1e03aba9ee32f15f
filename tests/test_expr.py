import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasq.functions import expr as E


def values(spark, column, **rows):
    names = list(rows)
    df = spark.createDataFrame(list(zip(*rows.values())), ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize(
    ("call", "serve", "match"),
    [
        ("GET /a/1", "GET /a/{id}", True), ("GET /a/{x}", "GET /a/b", True), ("GET /a", "POST /a", False), ("ANY /a", "POST /a", True), ("GET /a/b", "GET /a", False),
        ("GET <dynamic>", "GET /a", False), ("GET /", "GET /", False), ("GET /a?x=1", "GET /a?y", True), ("GET /a/b/c", "GET /a/**", True), ("GET /a", "GET /a/**", False), ("GET /a/**", "GET /a/b", True),
    ],
)
def test_paths_match(spark, call, serve, match):
    assert values(spark, E.paths_match(F.col("a"), F.col("b")), a=[call], b=[serve]) == [match]


def test_names_and_paths(spark):
    assert values(spark, E.alias(F.col("a")), a=[" Orders.Svc.. ", "\tx\n"]) == ["orders.svc", "x"]
    assert values(spark, E.kebab(F.col("a")), a=["orderItemApi"]) == ["order-item-api"]
    assert values(spark, E.observed(F.col("a")), a=[" Order-Svc_1.x"]) == ["ordersvc1x"]
    assert values(spark, E.rest_path(F.col("a")), a=["http://h:1//a//b?x#y", "a/b", "lb://svc"]) == ["/a/b", "/a/b", "/"]
    assert values(spark, E.join_paths(F.col("a"), F.col("b")), a=["/a/", ""], b=["b/c", "/"]) == ["/a/b/c", "/"]
    assert values(spark, E.strip_prefix(F.col("a"), F.lit(1)), a=["/a/b/c", "/a"]) == ["/b/c", "/"]
    assert values(spark, E.plural(F.col("a")), a=["city", "day", "box", "order"]) == ["cities", "days", "boxes", "orders"]
    assert values(spark, E.topic_name(F.col("a")), a=["orderCreated", "order-created", "HTTPCall"]) == ["ORDER_CREATED", "ORDER_CREATED", "HTTP_CALL"]
    assert values(spark, E.placeholder_key(F.col("a")), a=["${a.b:c}", "#{'${x}'}", "plain"]) == ["a.b", "x", None]
    assert values(spark, E.resolved(F.lit(None).cast("string"), F.col("a")), a=["${a:c}", "${a}"]) == ["c", None]
    assert values(spark, E.target_hint(F.col("a")), a=["x http://svc-a/y lb://b", "lb://b", "none"]) == ["svc-a", "b", None]


def test_units_and_ids(spark):
    assert values(spark, E.millicores(F.col("a")), a=["250m", "0.5", "x"]) == [250, 500, None]
    assert values(spark, E.memory_bytes(F.col("a")), a=["1Ki", "1K", "5", "1.5G", "x"]) == [1024, 1000, 5, 1_500_000_000, None]
    assert values(spark, E.duration_seconds(F.col("a")), a=["15m", "7d", "0h", "1w"]) == [900, 604_800, None, None]
    assert E.parse_duration("1h") == 3600
    for bad in ("0h", "one-hour", "1w", "01h"):
        with pytest.raises(ValueError, match="duration"):
            E.parse_duration(bad)
    want = hashlib.sha256(b"serve|GET /a|f.java|3:5").hexdigest()[:16]
    assert values(spark, E.endpoint_id(F.lit("serve"), F.lit("GET /a"), F.col("a"), F.lit(3), F.lit(5)), a=["f.java"]) == [want]
    none = F.lit(None).cast("int")
    assert values(spark, E.endpoint_id(F.lit("serve"), F.lit("GET /a"), F.col("a"), none, none), a=["f.java"]) == [hashlib.sha256(b"serve|GET /a|f.java").hexdigest()[:16]]


def test_classifiers(spark):
    assert values(spark, E.error_category(F.col("a")), a=["ReadTimeout", "Connection refused", "403 Forbidden", "", "boom", "Throttled"]) == ["timeout", "connection", "authorization", None, "failure", "throttling"]
    assert values(spark, E.span_label(F.col("a"), F.col("b"), F.col("c")), a=["get", None, "get"], b=["/x/{id}", None, "/x y"], c=[None, "orders.v1", None]) == ["GET /x/{id}", "orders.v1", None]
    assert values(spark, E.severity_rank(F.col("a")), a=["INFO", "ERROR", "x"]) == [0, 2, -1]
    assert values(spark, E.is_test_source(F.col("a")), a=["a/src/test/x", "src/integrationTest/y", "src/main/test/z"]) == [True, True, False]
    assert values(spark, E.word_tokens(F.col("a")), a=["Été, a_b 1!"]) == [["été", "a_b", "1"]]


@given(st.text(alphabet="ab/.", max_size=8))
def test_glob(text):
    assert bool(re.match(E.glob_regex("a*b?"), text)) == bool(re.match(r"(?s)^a.*b.$", text))
    assert re.match(E.glob_regex("*.[ab]"), "x/y.a") and not re.match(E.glob_regex("*.[!ab]"), "x.a")
