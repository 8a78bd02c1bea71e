"""Per-paper feature tables of the tabular and graph paths (TXT-01..13, TXT-20, Q2-Q4 fixes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail import constants as K
from papertrail.functions import text as T
from papertrail.operators import profiles as P

# The 33 columns summarised per author and expanded to degree 2 (fixed order).
STAT_COLS = ["len_title", "title_cnt", "len_abstract", "abstract_cnt", "len_keywords",
             "keywords_cnt", "len_venue", "venue_cnt", "len_title_abstract",
             "title_abstract_cnt", "len_title_keywords", "title_keywords_cnt",
             "len_keywords_abstract", "keywords_abstract_cnt", "len_all", "all_cnt", "year",
             "keywords_abstract_ratio", "co_org_ratio", "co_org_cnt", "not_co_org_ratio",
             "not_co_org_cnt", "org_dif_cnt", "co_author_cnt", "author_org_len",
             "author_org_cnt", "all_org_len", "all_name_len", "all_org_cnt", "all_name_cnt",
             "country_dif_cnt", "country_dif_ratio", "sum_country_cnt"]

JARO_COLS = [f"{s}_jaro_{p}" for p in ("venue", "year", "org")
             for s in ("max", "min", "mean", "max_min")]


def base_text_features(df: DataFrame, title="title", abstract="abstract", keywords="keywords",
                       venue="venue", year="year") -> DataFrame:
    """TXT-01, 03, 04, 05, 06 (tabular form; Q2 fixed: title + keywords)."""
    d = df.withColumns({
        "len_title": T.char_len(title), "title_cnt": T.space_tokens(title),
        "len_abstract": T.char_len(abstract), "abstract_cnt": T.space_tokens(abstract),
        "len_keywords": T.keyword_chars(keywords), "keywords_cnt": T.array_count(keywords),
        "len_venue": T.char_len(venue), "venue_cnt": T.space_tokens(venue),
        "year_value": T.year_value(year), "year_is_reanson": T.year_valid(year)})
    c = F.col
    return d.withColumns({
        "len_title_abstract": c("len_title") + c("len_abstract"),
        "title_abstract_cnt": c("title_cnt") + c("abstract_cnt"),
        "len_title_keywords": c("len_title") + c("len_keywords"),
        "title_keywords_cnt": c("title_cnt") + c("keywords_cnt"),
        "len_keywords_abstract": c("len_keywords") + c("len_abstract"),
        "keywords_abstract_cnt": c("keywords_cnt") + c("abstract_cnt"),
        "len_all": c("len_title") + c("len_abstract") + c("len_keywords"),
        "all_cnt": c("title_cnt") + c("abstract_cnt") + c("keywords_cnt"),
        "keywords_abstract_ratio": T.ratio_or_zero("keywords_cnt", "abstract_cnt"),
    })


def author_features(df: DataFrame, authors="authors", matched_org="matched_org",
                    countries=K.COUNTRIES) -> DataFrame:
    """TXT-07, 08, 09, 10, 11 against the matched org (Q1 fixed)."""
    counts = T.country_counts(authors, countries)
    n = T.authors_count(authors)
    mo = F.col(matched_org)
    co = T.same_org_count(authors, mo)
    has = F.size(F.col(authors)) > 0
    d = df.withColumns({
        "co_author_cnt": n,
        "all_org_len": T.authors_chars(authors, "org"),
        "all_name_len": T.authors_chars(authors, "name"),
        "all_org_cnt": T.authors_tokens(authors, "org"),
        "all_name_cnt": T.authors_tokens(authors, "name"),
        "author_org_len": T.char_len(mo), "author_org_cnt": T.space_tokens(mo),
        "org_is_null": F.when(F.coalesce(F.length(mo), F.lit(0)) > 0, 0).otherwise(1).cast("long"),
        "co_org_cnt": F.when(has, co).otherwise(0).cast("long"),
        **{f"country_{i}": c for i, c in enumerate(counts)}})
    c = F.col
    d = d.withColumns({
        "not_co_org_cnt": c("co_author_cnt") - c("co_org_cnt"),
        "co_org_ratio": T.ratio_or_zero("co_org_cnt", "co_author_cnt"),
        "sum_country_cnt": T.countries_total([c(f"country_{i}") for i in range(len(counts))]),
        "country_dif_cnt": T.countries_present([c(f"country_{i}") for i in range(len(counts))]),
    })
    return d.withColumns({
        "org_dif_cnt": c("not_co_org_cnt"),
        "not_co_org_ratio": T.ratio_or_zero("not_co_org_cnt", "co_author_cnt"),
        "country_dif_ratio": T.ratio_or_zero("country_dif_cnt", "sum_country_cnt"),
    })


def country_shares(df: DataFrame, n: int = len(K.COUNTRIES)) -> DataFrame:
    """TXT-10: share of each country mention; NULL when no country is mentioned."""
    return df.withColumns({f"country_{i}_share": T.share_or_null(f"country_{i}", "sum_country_cnt")
                           for i in range(n)})


def stat_features(pp: DataFrame, countries=K.COUNTRIES, method: str = "arrow") -> DataFrame:
    """Base text and author features (everything except the profile-similarity block)."""
    d = P.with_matched_org(pp, method=method)
    d = author_features(base_text_features(d), countries=countries)
    return d.withColumn("year", F.col("year_value")).drop("year_value")


def tabular_features(pp: DataFrame, countries=K.COUNTRIES, method: str = "arrow") -> DataFrame:
    """The full per-paper feature table: base text, author and profile-similarity
    features.  ``pp`` is profile rows joined with nested papers."""
    d = P.with_matched_org(pp, method=method)
    d = author_features(base_text_features(d), countries=countries)
    venues = P.top_k_values(d, "venue")
    years = P.top_k_values(d, "year")
    orgs = P.top_k_values(d, "matched_org", keep_null=False)
    v = P.profile_similarity(d, venues, F.col("venue"), "venue",
                             guard=F.coalesce(F.length("venue"), F.lit(0)) > 0)
    y = P.profile_similarity(d, years, F.col("year"), "year", top_as_str=True,
                             guard=F.coalesce(F.length("year"), F.lit(0)) > 0)
    o = P.profile_similarity(d, orgs, F.col("matched_org"), "org")
    d = d.join(v, ["author_id", "seq"]).join(y, ["author_id", "seq"]).join(o, ["author_id", "seq"])
    return d.withColumn("year", F.col("year_value")).drop("year_value")


# --- Graph path features (TXT-02, TXT-20, Q3/Q4 fixed) -------------------------
GRAPH_COLS = ["len_title", "title_cnt", "len_abstract", "abstract_cnt", "len_title_abstract",
              "abstract_title_cnt", "abstract_keywords_len", "cnt_abstract_keywords",
              "title_keywords_len", "cnt_title_keywords", "keywords_cnt", "len_keywords",
              "len_authors", "len_org", "len_name", "len_title_abstract_keywords",
              "title_keywords_abstract_cnt", "year", "len_venue", "venue_cnt",
              "sum_country_cnt", "key_abstract"] + [f"country_{i}" for i in range(10)]


def graph_features(df: DataFrame, title="title", abstract="abstract", keywords="keywords",
                   venue="venue", year="year", authors="authors",
                   countries=K.GRAPH_COUNTRIES) -> DataFrame:
    """The 32 node features of the graph path.  Empty text counts one token;
    unusable year or null venue take the fallbacks (year 2000, venue length 0)."""
    lt, tc = T.graph_char_len(title), T.graph_space_tokens(title)
    la, ac = T.graph_char_len(abstract), T.graph_space_tokens(abstract)
    kn, kc = T.array_count(keywords), T.keyword_chars(keywords)
    yr, lv = T.graph_year_fallback(year, venue)
    counts = T.country_counts(authors, countries)
    cols = {
        "len_title": lt, "title_cnt": tc, "len_abstract": la, "abstract_cnt": ac,
        "len_title_abstract": la + lt, "abstract_title_cnt": ac + tc,
        "abstract_keywords_len": la + kc, "cnt_abstract_keywords": ac + kn,
        "title_keywords_len": lt + kc, "cnt_title_keywords": tc + kn,
        "keywords_cnt": kn, "len_keywords": kc,
        "len_authors": T.authors_count(authors), "len_org": T.authors_chars(authors, "org"),
        "len_name": T.authors_chars(authors, "name"),
        "len_title_abstract_keywords": lt + la + kc,
        "title_keywords_abstract_cnt": tc + ac + kn,
        "year": yr, "len_venue": lv, "venue_cnt": T.graph_space_tokens(venue),
        "sum_country_cnt": T.countries_total(counts),
        "key_abstract": T.ratio_or_zero(kn, ac),
        **{f"country_{i}": c for i, c in enumerate(counts)}}
    return df.withColumns(cols)
