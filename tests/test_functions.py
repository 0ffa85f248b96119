"""Scalar helpers against known outputs of the browser-side functions."""

from pyspark.sql import functions as F

from mercato.functions.columns import camel, format_price, render_tags, role_at_least, uri_component
from mercato.functions.rules import issues


def test_format_price(spark):
    df = spark.createDataFrame([(4905,), (0,), (5,), (123456,)], "c int")
    assert [r[0] for r in df.select(format_price("c")).collect()] == ["$49.05", "$0.00", "$0.05", "$1234.56"]


def test_uri_component_matches_encode_uri_component(spark):
    df = spark.createDataFrame([("a b!~*()'x/é?&=",), ("brand-style-guide",)], "s string")
    got = [r[0] for r in df.select(uri_component("s")).collect()]
    assert got == ["a%20b!~*()'x%2F%C3%A9%3F%26%3D", "brand-style-guide"]


def test_render_tags_null_is_empty(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,), ([],)], "t array<string>")
    got = [r[0] for r in df.select(render_tags("t")).collect()]
    assert got == ['<span class="tag">a</span><span class="tag">b</span>', "", ""]


def test_role_weights(spark):
    df = spark.createDataFrame([("customer",), ("editor",), ("admin",), ("ghost",), (None,)], "role string")
    got = [r[0] for r in df.select(role_at_least("role", "editor")).collect()]
    assert got == [False, True, True, False, False]


def test_camel():
    assert camel("price_cents") == "priceCents" and camel("id") == "id" and camel("digital_file_url") == "digitalFileUrl"


def test_every_issue_is_reported(spark):
    df = spark.createDataFrame([("nope", "short", "x"), ("a@b.co", "long-enough", "Al"), (None, None, None)],
                               "email string, password string, name string")
    got = [list(r[0]) for r in df.select(issues("register")).collect()]
    assert got == [["email", "password", "name"], [], ["email", "password", "name"]]


def test_message_attachments_must_be_urls(spark):
    df = spark.createDataFrame([("hi", ["https://x.example/a"]), ("hi", ["nope"]), ("", None)],
                               "body string, attachments array<string>")
    got = [list(r[0]) for r in df.select(issues("message")).collect()]
    assert got == [[], ["attachments"], ["body"]]
