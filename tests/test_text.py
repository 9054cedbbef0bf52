import uuid

from pyspark.sql import functions as F

from siltstone.functions import exact, text
from siltstone.operators import chunking, graph


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_cjk_tokens(spark):
    for tokens in (text.lexical_tokens, exact.lexical_tokens):
        got = one(spark, "检查 /var/log/app.log v1.2 防汛预案", tokens)
        assert got == ["检查", "检查", "/var/log/app.log", "v1.2", "防汛预案", "防汛", "汛预", "预案"]
    assert one(spark, "ＡＢＣ", exact.lexical_tokens) == ["abc"]
    assert one(spark, None, text.lexical_tokens) in ([], None)


def test_exact_udfs(spark):
    df = spark.createDataFrame([("Ａ  b\u3000C",), (None,)], "x string").select(exact.match_key(F.col("x")).alias("k"), exact.lexical_tokens(F.col("x")).alias("t"), exact.uuid5(F.col("x")).alias("u")).collect()
    assert df[0].k == "abc" and df[0].t == ["a", "b", "c"] and df[0].u == str(uuid.uuid5(uuid.NAMESPACE_URL, "Ａ  b\u3000C"))
    assert df[1].k == "" and df[1].u is None


def test_token_estimate(spark):
    assert one(spark, "防汛 plan_b 12 预案", text.token_estimate) == chunking.estimate("防汛 plan_b 12 预案") == 6
    assert one(spark, None, text.token_estimate) == 0


def test_safe_names(spark):
    assert one(spark, "C:\\docs\\..\\a<b>.pdf", text.safe_filename) == "a_b_.pdf"
    assert one(spark, "/", text.safe_filename) == "unnamed"
    assert one(spark, "a/b\\c", text.safe_key) == "a_b_c"
    assert one(spark, "failed: mongodb+srv://u:p@h/db Bearer abc token=xyz", text.safe_error) == "failed: [redacted] [redacted] [redacted]"
    assert one(spark, "a" * 400, text.safe_error) == "a" * 300


def test_metadata(spark):
    df = spark.createDataFrame([({"api_key": "k", "file": "/tmp/x/a.txt", "n": "1", "prompt": "p"},)], "m map<string,string>")
    r = df.select(text.redacted_metadata(F.col("m")).alias("a"), text.safe_details(F.col("m")).alias("b")).first()
    assert r.a == {"api_key": "[redacted]", "file": "a.txt", "n": "1", "prompt": "p"}
    assert r.b == {"file": "/tmp/x/a.txt", "n": "1"}


def test_predicates(spark):
    df = spark.createDataFrame([("Depends-On", None), ("监控", None), ("likes", "监控"), ("related to", "不使用"), (None, None)], "predicate string, raw string")
    got = {(r.predicate, r.raw): r.canonical for r in graph.canonical(df, raw="raw").select("predicate", "raw", "canonical").collect()}
    assert got == {("Depends-On", None): "DEPENDS_ON", ("监控", None): "MONITORS", ("likes", "监控"): "MONITORS", ("related to", "不使用"): "RELATED_TO", (None, None): "RELATED_TO"}


def test_rules(spark):
    df = spark.createDataFrame([(429, "X"), (401, "X"), (500, "X"), (None, "ReadTimeout"), (None, "NetworkError"), (None, "JSONDecodeError"), (None, "ValidationError"), (None, "Y")], "s int, k string")
    assert [r.c for r in df.select(text.failure_category(F.col("s"), F.col("k")).alias("c")).collect()] == ["provider_rate_limit", "provider_auth", "provider_http", "provider_timeout", "provider_connection", "provider_invalid_response", "validation", "unknown"]
    for q, ok in (("MATCH (n) RETURN n", True), ("match (n) delete n", False), ("CREATE (n)", False), ("MATCH (n) RETURN n; MATCH (m) RETURN m", False), ("WITH 1 AS x RETURN x;", True)):
        assert one(spark, q, text.read_only_statement) is ok


def test_alias_match(spark):
    df = spark.createDataFrame([("天枢平台", "天枢"), ("a", "a"), ("North-Star", "north star"), ("x y", "z")], "a string, b string")
    assert [r.m for r in df.select(text.alias_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, True, False]
