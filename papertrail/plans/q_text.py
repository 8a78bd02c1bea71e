"""Per-paper text/array feature queries (TXT-01..20, FLT-03, WIN-05, SET-01/06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail import constants as K
from papertrail.functions import text as T
from papertrail.functions import tokens as TK
from papertrail.operators import features as FE
from papertrail.operators.overlap import contained_sets
from papertrail.plans import sqlfrag as S
from papertrail.plans.common import r6
from papertrail.plans.registry import register
from papertrail.sources import driver as D
from papertrail.sources.driver import SQL_LINES, SQL_PAPER, sql_with

# Country list bound to the driver's organisation names (NATION_1 is a
# substring of NATION_10..19, like 'UK' inside 'UKraine').
DRIVER_COUNTRIES = [f"NATION_{i}" for i in range(13)]

P_SQL = sql_with(SQL_LINES, SQL_PAPER)


def _papers(spark, sf):
    return D.papers(spark, sf)


def _authors_sql():
    # names/orgs lists of the SQL paper view stand in for the authors array.
    return "names", "orgs"


@register("txt_01", P_SQL + f"""
SELECT paper_id, {S.char_len('title')} AS len_title, {S.space_tokens('title')} AS title_cnt,
 {S.char_len('abstract')} AS len_abstract, {S.space_tokens('abstract')} AS abstract_cnt,
 {S.char_len('venue')} AS len_venue, {S.space_tokens('venue')} AS venue_cnt FROM paper""")
def txt_01(spark, sf):
    return _papers(spark, sf).select(
        "paper_id", T.char_len("title").alias("len_title"), T.space_tokens("title").alias("title_cnt"),
        T.char_len("abstract").alias("len_abstract"), T.space_tokens("abstract").alias("abstract_cnt"),
        T.char_len("venue").alias("len_venue"), T.space_tokens("venue").alias("venue_cnt"))


@register("txt_01_documents", f"""
SELECT doc_id, {S.char_len('text')} AS len_text, {S.space_tokens('text')} AS text_cnt FROM documents""")
def txt_01_documents(spark, sf):
    """Length and space-token count over whole document texts."""
    return D.table(spark, sf, "documents").select(
        "doc_id", T.char_len("text").alias("len_text"), T.space_tokens("text").alias("text_cnt"))


@register("txt_02", P_SQL + f"""
SELECT paper_id, {S.graph_len('title')} AS len_title, {S.graph_tokens('title')} AS title_cnt,
 {S.graph_len('abstract')} AS len_abstract, {S.graph_tokens('abstract')} AS abstract_cnt,
 {S.graph_tokens('venue')} AS venue_cnt FROM paper""")
def txt_02(spark, sf):
    return _papers(spark, sf).select(
        "paper_id", T.graph_char_len("title").alias("len_title"),
        T.graph_space_tokens("title").alias("title_cnt"),
        T.graph_char_len("abstract").alias("len_abstract"),
        T.graph_space_tokens("abstract").alias("abstract_cnt"),
        T.graph_space_tokens("venue").alias("venue_cnt"))


@register("txt_03", P_SQL + f"""
SELECT paper_id, CAST(len(keywords) AS BIGINT) AS keywords_cnt, {S.list_chars('keywords')} AS len_keywords
FROM paper""")
def txt_03(spark, sf):
    return _papers(spark, sf).select("paper_id", T.array_count("keywords").alias("keywords_cnt"),
                                     T.keyword_chars("keywords").alias("len_keywords"))


_T04 = ["len_title_abstract", "title_abstract_cnt", "len_title_keywords", "title_keywords_cnt",
        "len_keywords_abstract", "keywords_abstract_cnt", "len_all", "all_cnt"]


@register("txt_04", P_SQL + f"""
, b AS (SELECT paper_id, {S.char_len('title')} AS lt, {S.space_tokens('title')} AS tc,
   {S.char_len('abstract')} AS la, {S.space_tokens('abstract')} AS ac,
   {S.list_chars('keywords')} AS lk, CAST(len(keywords) AS BIGINT) AS kc FROM paper)
SELECT paper_id, lt + la AS len_title_abstract, tc + ac AS title_abstract_cnt,
 lt + lk AS len_title_keywords, tc + kc AS title_keywords_cnt, lk + la AS len_keywords_abstract,
 kc + ac AS keywords_abstract_cnt, lt + la + lk AS len_all, tc + ac + kc AS all_cnt FROM b""")
def txt_04(spark, sf):
    return FE.base_text_features(_papers(spark, sf)).select("paper_id", *_T04)


@register("txt_05", P_SQL + """
SELECT paper_id, CAST(coalesce(TRY_CAST(year AS INTEGER), -1) AS BIGINT) AS year_value,
 CAST(coalesce(TRY_CAST(year AS INTEGER) <> 0, false) AS BIGINT) AS year_is_reanson FROM paper""")
def txt_05(spark, sf):
    return _papers(spark, sf).select("paper_id", T.year_value("year").alias("year_value"),
                                     T.year_valid("year").alias("year_is_reanson"))


@register("txt_06", P_SQL + f"""
SELECT paper_id, round({S.ratio0('CAST(len(keywords) AS BIGINT)', S.space_tokens('abstract'))}, 6)
  AS keywords_abstract_ratio FROM paper""")
def txt_06(spark, sf):
    return FE.base_text_features(_papers(spark, sf)).select(
        "paper_id", r6(F.col("keywords_abstract_ratio")).alias("keywords_abstract_ratio"))


@register("txt_07", P_SQL + f"""
SELECT paper_id, CAST(len(names) AS BIGINT) AS co_author_cnt, {S.list_chars('orgs')} AS all_org_len,
 {S.list_chars('names')} AS all_name_len, {S.list_tokens('orgs')} AS all_org_cnt,
 {S.list_tokens('names')} AS all_name_cnt FROM paper""")
def txt_07(spark, sf):
    a = "authors"
    return _papers(spark, sf).select(
        "paper_id", T.authors_count(a).alias("co_author_cnt"),
        T.authors_chars(a, "org").alias("all_org_len"), T.authors_chars(a, "name").alias("all_name_len"),
        T.authors_tokens(a, "org").alias("all_org_cnt"), T.authors_tokens(a, "name").alias("all_name_cnt"))


def _country_sql():
    return ", ".join(
        f"CAST(len(list_filter(orgs, lambda o: contains(coalesce(o, ''), {S.lit(c)}))) AS BIGINT) AS country_{i}"
        for i, c in enumerate(DRIVER_COUNTRIES))


_CC = P_SQL + f", cc AS (SELECT paper_id, {_country_sql()} FROM paper)\n"
_SUMC = " + ".join(f"country_{i}" for i in range(13))
_PRES = " + ".join(f"CASE WHEN country_{i} <> 0 THEN 1 ELSE 0 END" for i in range(13))


def _countries(spark, sf):
    return FE.author_features(_papers(spark, sf).withColumn("matched_org", F.lit(None).cast("string")),
                              countries=DRIVER_COUNTRIES)


@register("txt_08", _CC + "SELECT * FROM cc")
def txt_08(spark, sf):
    return _countries(spark, sf).select("paper_id", *[f"country_{i}" for i in range(13)])


@register("txt_09", _CC + f"""
SELECT paper_id, CAST({_PRES} AS BIGINT) AS country_dif_cnt, CAST({_SUMC} AS BIGINT) AS sum_country_cnt,
 round({S.ratio0(_PRES, _SUMC)}, 6) AS country_dif_ratio FROM cc""")
def txt_09(spark, sf):
    return _countries(spark, sf).select("paper_id", "country_dif_cnt", "sum_country_cnt",
                                        r6(F.col("country_dif_ratio")).alias("country_dif_ratio"))


@register("txt_10", _CC + "SELECT paper_id, " + ", ".join(
    f"round(CAST(country_{i} AS DOUBLE) / nullif({_SUMC}, 0), 6) AS country_{i}_share" for i in range(13))
    + " FROM cc")
def txt_10(spark, sf):
    d = FE.country_shares(_countries(spark, sf))
    return d.select("paper_id", *[r6(F.col(f"country_{i}_share")).alias(f"country_{i}_share")
                                  for i in range(13)])


@register("txt_12", P_SQL + """
SELECT paper_id, 'title:' || CASE WHEN title IS NULL OR title = '' THEN 'None' ELSE title END AS t_title,
 'abstract:' || CASE WHEN abstract IS NULL OR abstract = '' THEN 'None' ELSE abstract END AS t_abstract,
 'keywords:' || CASE WHEN len(keywords) > 0 THEN array_to_string(keywords, ' ') ELSE 'None' END AS t_keywords
FROM paper""")
def txt_12(spark, sf):
    return _papers(spark, sf).select(
        "paper_id", T.tagged("title", "title").alias("t_title"),
        T.tagged("abstract", "abstract").alias("t_abstract"),
        T.tagged_keywords("keywords").alias("t_keywords"))


@register("txt_13", P_SQL + """
SELECT paper_id,
 'title:' || CASE WHEN title IS NULL OR title = '' THEN 'None' ELSE title END || ' ' ||
 'abstract:' || CASE WHEN abstract IS NULL OR abstract = '' THEN 'None' ELSE abstract END
 || ' ' || 'keywords:' || CASE WHEN len(keywords) > 0 THEN array_to_string(keywords, ' ') ELSE 'None' END
 || ' venue:' || coalesce(venue, 'None') || ' year:' || coalesce(year, 'None') AS text FROM paper""")
def txt_13(spark, sf):
    return _papers(spark, sf).select("paper_id", T.compose_text("title", "abstract", "keywords",
                                                                "venue", "year").alias("text"))


@register("win_05", P_SQL + f"""
SELECT paper_id, substr('abstract:' || CASE WHEN abstract IS NULL OR abstract = '' THEN 'None'
 ELSE abstract END, 1, {K.ABSTRACT_CHARS}) AS abstract_cut FROM paper""")
def win_05(spark, sf):
    return _papers(spark, sf).select(
        "paper_id", F.substring(T.tagged("abstract", "abstract"), 1, K.ABSTRACT_CHARS).alias("abstract_cut"))


@register("txt_14", """
SELECT s_suppkey, lower(regexp_replace(s_name, '[^\\x{4e00}-\\x{9fa5}\\w\\s]', '', 'g')) AS name_norm
FROM supplier""")
def txt_14(spark, sf):
    return D.table(spark, sf, "supplier").select("s_suppkey", T.normalise_name("s_name").alias("name_norm"))


@register("txt_15", P_SQL + """
SELECT paper_id, list_transform(orgs, lambda o: lower(coalesce(o, ''))) AS orgs_lower FROM paper""")
def txt_15(spark, sf):
    return _papers(spark, sf).select("paper_id", T.lower_orgs("authors").alias("orgs_lower"))


@register("txt_17", f"SELECT doc_id, {S.clean_phrase('text')} AS tokens FROM documents")
def txt_17(spark, sf):
    """Cleaned tokens of whole document texts."""
    return D.table(spark, sf, "documents").select("doc_id", TK.clean_phrase("text").alias("tokens"))


def _bag_sql() -> str:
    empty = "[]::VARCHAR[]"
    ven = f"CASE WHEN venue IS NULL THEN {empty} ELSE {S.clean_phrase('venue')} END"
    orgs = f"coalesce(flatten(list_transform(orgs, lambda o: {S.clean_phrase('coalesce(o, ' + S.lit('') + ')')})), {empty})"
    kw = f"coalesce(list_transform(keywords, lambda k: lower(k)), {empty})"
    return (f"list_concat(list_concat(list_concat(list_concat({S.ws_tokens('lower(title)')}, "
            f"{S.ws_tokens('lower(abstract)')}), {kw}), {ven}), {orgs})")


@register("txt_19", P_SQL + f"SELECT paper_id, {_bag_sql()} AS tokens FROM paper")
def txt_19(spark, sf):
    return _papers(spark, sf).select(
        "paper_id", TK.bag_of_tokens("title", "abstract", "keywords", "venue", "authors").alias("tokens"))


@register("flt_03", f"""
SELECT doc_id, list_filter({S.ws_tokens('lower(text)')}, lambda t: length(t) > 1
  AND NOT list_contains({S.str_list(K.TABULAR_STOPWORDS)}, t)) AS tokens FROM documents""")
def flt_03(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", TK.stop_filter(TK.whitespace_tokens(F.lower("text")), K.TABULAR_STOPWORDS).alias("tokens"))


@register("txt_20", P_SQL + """
SELECT paper_id,
 CAST(CASE WHEN TRY_CAST(year AS INTEGER) IS NULL OR venue IS NULL THEN 2000 ELSE TRY_CAST(year AS INTEGER) END AS BIGINT) AS year_fb,
 CAST(CASE WHEN TRY_CAST(year AS INTEGER) IS NULL OR venue IS NULL THEN 0 ELSE length(venue) END AS BIGINT) AS len_venue_fb
FROM paper""")
def txt_20(spark, sf):
    y, lv = T.graph_year_fallback("year", "venue")
    return _papers(spark, sf).select("paper_id", y.alias("year_fb"), lv.alias("len_venue_fb"))


@register("set_01", P_SQL + """
, pairs AS (SELECT a.paper_id AS p1, b.paper_id AS p2, a.keywords AS k1, b.keywords AS k2
  FROM paper a JOIN orders oa ON oa.o_orderkey = a.paper_id
  JOIN orders ob ON ob.o_custkey = oa.o_custkey AND ob.o_orderkey > oa.o_orderkey
  JOIN paper b ON b.paper_id = ob.o_orderkey)
SELECT p1, p2, list_sort(list_distinct(list_filter(k1, lambda x: list_contains(k2, x)))) AS shared
FROM pairs WHERE len(list_filter(k1, lambda x: list_contains(k2, x))) > 0""")
def set_01(spark, sf):
    """Array intersection of keyword lists for paper pairs of one profile that
    share a keyword (pairs found through the keyword inverted index)."""
    from papertrail.operators import graph as G
    pp = G.graph_input(D.profile_papers(spark, sf))
    e = G.keyword_edges(pp).filter(F.col("src") < F.col("dst")).select(
        F.col("src").alias("p1"), F.col("dst").alias("p2"))
    kw = D.papers(spark, sf).select("paper_id", "keywords")
    a, b = kw.alias("a"), kw.alias("b")
    return (e.join(a, F.col("p1") == F.col("a.paper_id")).join(b, F.col("p2") == F.col("b.paper_id"))
            .select("p1", "p2", F.array_sort(F.array_intersect("a.keywords", "b.keywords")).alias("shared")))


@register("set_06", P_SQL + """
, pt AS (SELECT paper_id, list_distinct(flatten(list_transform(keywords, lambda k: string_split(k, ' ')))) AS toks
  FROM paper)
, pn AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS toks FROM part)
SELECT pt.paper_id, pn.p_name FROM pt, pn
WHERE len(list_filter(pn.toks, lambda t: NOT list_contains(pt.toks, t))) = 0""")
def set_06(spark, sf):
    """Token-set containment: part names whose tokens all occur among a paper's
    keyword tokens.  Exact blocking on the contained set's token that the fewest papers hold; a name with a token
    that no paper holds meets none.  Tokens that many papers hold are split by counted rows."""
    pn = (D.table(spark, sf, "part").select("p_name").distinct()
          .withColumn("ta", F.array_distinct(F.split("p_name", " "))))
    pt = (D.papers(spark, sf)
          .select("paper_id", F.array_distinct(F.flatten(F.transform(
              "keywords", lambda k: F.split(k, " ")))).alias("tb")))
    return contained_sets(pn, pt, "p_name", "paper_id").select("paper_id", "p_name")
