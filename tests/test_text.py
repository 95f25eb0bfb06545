import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.functions import values as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def cleaned(spark, text, profile=T.CleaningProfile()):
    return T.clean(spark.createDataFrame([(text,)], "raw_text string"), profile=profile).first()


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("a\x00b\x07c", "abc"),
        ("ＡＢＣ　１２３", "ABC 123"),
        ("été", "été"),
        ("<p>Hi<br>there</p> &amp;lt; &#39;x&#39;", "Hi\nthere < 'x'"),
        ("a < b and c > d", "a < b and c > d"),
        ("Page 3 of 9\nbody\n-----\nmore", "body\n\nmore"),
        ("第 3 页\n正文", "正文"),
        ("x\r\ny\rz\t\t w\n\n\n\nq", "x\ny\nz w\n\nq"),
        ("wow!!! no... yes---", "wow! no… yes—"),
        ("", ""),
        (None, ""),
    ],
)
def test_cleaning(spark, raw, clean):
    r = cleaned(spark, raw)
    assert r.text == clean and [x.op for x in r.log] == list(T.OPERATIONS)
    assert r.log[0].chars_before == len(raw or "") and r.log[-1].chars_after == len(clean)


def test_change_is_seen_by_length_only(spark):
    df = T.clean(spark.createDataFrame([("ＡＢ",), ("a!!!b",)], "raw_text string"))
    assert [r.c for r in df.select(T.any_change(F.col("log")).alias("c")).collect()] == [False, True]


def test_profile_runs_first_and_checks_flags(spark):
    p = T.CleaningProfile.from_dict({"boilerplate_patterns": [{"pattern": "^SECRET.*$", "flags": ["MULTILINE", "IGNORECASE"]}], "disable_default_boilerplate": True})
    assert cleaned(spark, "secret x\nPage 1\nkept", p).text == "Page 1\nkept"
    with pytest.raises(ValueError, match="unknown flags"):
        T.CleaningProfile.from_dict({"boilerplate_patterns": [{"pattern": "x", "flags": ["LOUD"]}]})


def test_query_normalisation(spark):
    assert one(spark, T.normalize_query(F.col("q")), q="  ａ\tb\n\n c　") == "a b c"
    assert one(spark, T.normalize_query(F.col("q")), q=None) == ""


def tokens(t):
    cjk = sum(0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0xF900 <= ord(c) <= 0xFAFF or 0x20000 <= ord(c) <= 0x2A6DF for c in t)
    return cjk + (len(t) - cjk + 2) // 3


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab 漢字𠀀é", max_size=30), min_size=1, max_size=8), st.integers(0, 8))
def test_token_truncation(spark, texts, most):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, r in zip(texts, df.select("t", T.token_count(F.col("t")).alias("n"), T.truncate_tokens(F.col("t"), most).alias("head"), T.token_suffix(F.col("t"), most).alias("tail")).collect()):
        assert r.n == tokens(t) and tokens(r.head) <= most and tokens(r.tail) <= most
        assert t.startswith(r.head) and t.endswith(r.tail)
        assert r.head == t or tokens(t[: len(r.head) + 1]) > most


def test_lexical_tokens(spark):
    df = spark.createDataFrame([("Hello, 数据分析 x 单!",), (None,)], "t string")
    assert [r.x for r in df.select(T.lexical_tokens(F.col("t")).alias("x")).collect()] == [["hello", "数据", "据分", "分析", "x", "单"], []]


def test_ids_and_maps(spark):
    import hashlib
    import uuid

    df = spark.createDataFrame([("d1", {"b": "2", "a": "1"}, {"a": "9"})], "d string, m map<string,string>, n map<string,string>")
    key = V.chunk_id(F.col("d"), F.lit(2), F.lit(7))
    r = df.select(key.alias("c"), V.sub_chunk_id(key, F.lit(0)).alias("s"), V.point_id(key).alias("p"), V.versions_text(F.col("m")).alias("v"), V.merged(F.col("m"), F.col("n")).alias("g")).first()
    want = hashlib.sha1(b"d1:2:7").hexdigest()[:16]
    assert (r.c, r.s, r.p, r.v, r.g) == (want, hashlib.sha1(f"{want}:sub:0".encode()).hexdigest()[:16], str(uuid.uuid5(uuid.NAMESPACE_DNS, want)), "a=1,b=2", {"a": "9", "b": "2"})
    assert V.store_name("base", "0.1.0", "v1.2") == "base_0_1_0_v1_2"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])], "v array<double>, z array<double>, m array<array<double>>")
    r = df.select(
        V.l2_normalized(F.col("v")).alias("u"), V.l2_normalized(F.col("z")).alias("z"), V.cosine(F.col("v"), F.col("z")).alias("none"), V.mean_pooled(F.col("m"), F.lit(1), F.lit(3)).alias("p"), V.mean_pooled(F.col("m"), F.lit(2), F.lit(9)).alias("q"),
        V.token_range(F.lit(2), F.lit(5), F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 2), (2, 2), (2, 4), (4, 6), (6, 8))])).alias("range"),
    ).first()
    assert r.u == [0.6, 0.8] and r.z == [0.0, 0.0] and r.none is None and r.p == [4.0, 5.0] and r.q is None and tuple(r.range) == (2, 4)


def test_fences_and_metrics(spark):
    assert one(spark, V.unfenced(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, V.unfenced(F.col("t"), True), t="```\nx\n```\ny") == "x\ny"
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "z"]), ([], ["b"]), (["a"], [])], "got array<string>, rel array<string>")
    g, rel = F.col("got"), F.col("rel")
    rows = df.select(V.recall_at(g, rel, 2).alias("r"), V.precision_at(g, rel, 2).alias("p"), V.reciprocal_rank(g, rel).alias("m"), F.round(V.ndcg_at(g, rel, 3), 4).alias("n"), V.rejection(g).alias("x")).collect()
    assert [tuple(r) for r in rows] == [(0.5, 0.5, 0.5, 0.3869, 0.0), (0.0, 0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0, 0.0)]


def test_nfc_equals_python(spark):
    text = "ÅﬁÁ"
    assert one(spark, T.nfc(F.col("t")), t=text) == unicodedata.normalize("NFC", text)


def test_each_rule_is_computed_once(spark):
    texts = ["a\x00b!!!  c\r\n\n\n\nd", "<p>x&amp;y</p>", "Page 3 of 9\nbody", "---...", "", None, "Ａ fine text"]
    df = spark.createDataFrame([(t,) for t in texts], "raw_text string")
    cleaned = T.clean(df)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("blockquote") == 1 and plan.count(r"\r\n|\r") == 1 and plan.count("translate(") == 1
    log = {r.raw_text: [(x.op, x.chars_before - x.chars_after, x.detail) for x in r.log] for r in cleaned.collect()}
    assert log[texts[0]][1] == ("control_char_strip", 1, "removed 1 control chars") and log[texts[0]][5:] == [("whitespace_norm", 4, "4 chars normalised"), ("repeated_punct_fix", 2, "collapsed 1 punct run(s)")]
    assert log[texts[1]][3] == ("html_strip", 10, "regex stripped HTML; 10 chars removed") and log[texts[2]][4] == ("boilerplate_strip", 11, "removed 1 boilerplate match(es)")
    assert log[texts[3]][6][2] == "collapsed 2 punct run(s)" and log[texts[6]][2][2] == "" and log[None] == log[""] and all(d == 0 for _, d, _ in log[""])
