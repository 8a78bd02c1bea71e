import pytest
from pyspark.sql import functions as F

from papertrail import constants as K
from papertrail.functions import text as T
from papertrail.functions import tokens as TK
from papertrail.operators import features as FE


def test_lengths_and_tokens(spark):
    df = spark.createDataFrame([("", None), ("a  b ", "x")], "t string, a string")
    r = df.select(T.char_len("t").alias("lt"), T.space_tokens("t").alias("tt"),
                  T.char_len("a").alias("la"), T.space_tokens("a").alias("ta"),
                  T.graph_space_tokens("t").alias("gt"), T.graph_space_tokens("a").alias("ga")).collect()
    assert tuple(r[0]) == (0, 0, 0, 0, 1, 0)      # '' -> 0 tabular, 1 token in the graph path
    assert tuple(r[1]) == (5, 4, 1, 1, 4, 1)      # 'a  b ' keeps empty tokens


def test_year_parse(spark):
    df = spark.createDataFrame([("",), (None,), ("0",), ("2001",)], "y string")
    r = df.select(T.year_value("y").alias("v"), T.year_valid("y").alias("f")).collect()
    assert [tuple(x) for x in r] == [(-1, 0), (-1, 0), (0, 0), (2001, 1)]
    js = spark.createDataFrame([('{"year": 2001}',)], "j string")
    y = js.select(F.from_json("j", "year string")["year"].alias("y")).select(T.year_value("y")).first()[0]
    assert y == 2001


def test_countries(spark):
    df = spark.createDataFrame([([("a", "Univ of UKraine"), ("b", "UK, USA"), ("c", "")],)],
                               "authors array<struct<name:string,org:string>>")
    d = FE.author_features(df.withColumn("matched_org", F.lit(None).cast("string")))
    r = d.first()
    assert r["country_11"] == 2 and r["country_12"] == 1
    assert r["sum_country_cnt"] == 3 and r["country_dif_cnt"] == 2
    none = spark.createDataFrame([([("a", "x")],)], "authors array<struct<name:string,org:string>>")
    d2 = FE.country_shares(FE.author_features(none.withColumn("matched_org", F.lit("x"))))
    r2 = d2.first()
    assert r2["country_0_share"] is None and r2["country_dif_ratio"] == 0.0


def test_clean_phrase_and_tokens(spark):
    df = spark.createDataFrame([("a[b]c\\d-e Deep",)], "s string")
    toks = df.select(TK.clean_phrase("s", stopwords=[]).alias("t")).first()[0]
    assert toks == ["c\\d", "deep"]   # backslash kept, other punctuation -> space, 1-char dropped
    kw = spark.createDataFrame([("t", None, ["Deep Learning"], None, [])],
                               "title string, abstract string, keywords array<string>, venue string, "
                               "authors array<struct<name:string,org:string>>")
    bag = kw.select(TK.bag_of_tokens("title", "abstract", "keywords", "venue", "authors")).first()[0]
    assert bag == ["t", "deep learning"]


def test_stop_filter_keeps_duplicates(spark):
    df = spark.createDataFrame([(["xx", "the", "xx", "a"],)], "t array<string>")
    assert df.select(TK.stop_filter(F.col("t"), K.TABULAR_STOPWORDS)).first()[0] == ["xx", "xx"]


def test_name_normalise(spark):
    df = spark.createDataFrame([("Jean-Éric",), ("李 Wei!",)], "n string")
    r = [x[0] for x in df.select(T.normalise_name("n")).collect()]
    assert r == ["jeanéric", "李 wei"]


def test_compose_text(spark):
    df = spark.createDataFrame([("", "x" * 400, [], None, "2001")],
                               "title string, abstract string, keywords array<string>, venue string, year string")
    t = df.select(T.compose_text("title", "abstract", "keywords", "venue", "year")).first()[0]
    assert t.startswith("title:None abstract:xxx")
    assert t.endswith("keywords:None venue:None year:2001")
    assert len(t.split(" ")[1]) == len("abstract:") + 400
    cut = df.select(T.compose_text("title", "abstract", "keywords", "venue", "year", K.ABSTRACT_CHARS)).first()[0]
    assert len(cut.split(" ")[1]) == K.ABSTRACT_CHARS


def _readings(spark, rows, **kw):
    from papertrail.operators.names import Readings
    return Readings(spark.createDataFrame(rows, "ch string, reading string"), **kw)


def test_transliteration_takes_the_longest_entry(spark):
    rows = [("李", "li"), ("伟", "wei"), ("行", "xing"), ("银", "yin"), ("银行", "yin hang"), ("长", "chang"), ("长大", "zhang da")]
    texts = ["李伟", "银行 ABC行", "Wei 李-长大了", None, "", "abc", "银", "长银行", "银银行行", "了"]
    want = ["li wei", "yin hang  ABC xing", "Wei  li - zhang da 了", None, "", "abc", "yin", "chang yin hang",
            "yin yin hang xing", "了"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    read = _readings(spark, rows)
    got = df.select(read.text("t").alias("x"))
    assert [r.x for r in got.collect()] == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    one = _readings(spark, rows[:4])
    assert [r.x for r in df.select(one.text("t").alias("x")).collect()][:2] == ["li wei", "yin xing  ABC xing"]
    none = _readings(spark, [])
    assert [r.x for r in df.select(none.text("t").alias("x")).collect()][:2] == ["李 伟", "银 行  ABC 行"]


def test_a_dictionary_is_bounded(spark):
    with pytest.raises(ValueError, match="more than 2"):
        _readings(spark, [("李", "li"), ("伟", "wei"), ("行", "xing")], most=2)


def test_names_are_read_before_they_are_normalised(spark):
    from papertrail.operators import graph as G
    read = _readings(spark, [("李", "li"), ("伟", "wei")])
    pp = spark.createDataFrame([([("李伟", "O"), ("LI Wei", "O")],)], "authors array<struct<name:string,org:string>>")
    assert G.graph_input(pp, readings=read).first()["names"] == ["li wei", "li wei"]
