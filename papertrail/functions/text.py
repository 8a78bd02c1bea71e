"""Per-paper scalar and array feature expressions (TXT-01..13, TXT-15, TXT-20).

All functions build ``Column`` expressions; nothing runs in Python per row.
``length`` counts code points and ``split`` keeps empty tokens, which is what
the reference's ``len`` and ``str.split(' ')`` do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrail import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


# --- TXT-01: lengths and space-token counts, 0 when null or empty -----------------
def char_len(c) -> Column:
    c = _c(c)
    return F.when(_empty(c), F.lit(0)).otherwise(F.length(c)).cast("long")


def space_tokens(c) -> Column:
    c = _c(c)
    return F.when(_empty(c), F.lit(0)).otherwise(F.size(F.split(c, " "))).cast("long")


# --- TXT-02: graph variant: '' counts one token, null counts 0 ------------------
def graph_char_len(c) -> Column:
    return F.coalesce(F.length(_c(c)), F.lit(0)).cast("long")


def graph_space_tokens(c) -> Column:
    c = _c(c)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(F.split(c, " "))).cast("long")


# --- TXT-03: keyword count and total keyword characters ----------------------
def array_count(arr) -> Column:
    return F.coalesce(F.size(_c(arr)), F.lit(0)).cast("long")


def keyword_chars(arr) -> Column:
    return F.coalesce(F.aggregate(_c(arr), F.lit(0).cast("long"),
                                  lambda acc, x: acc + F.coalesce(F.length(x), F.lit(0))),
                      F.lit(0).cast("long"))


# --- TXT-05: year parse and validity flag -------------------------------------
def year_value(c) -> Column:
    return F.coalesce(F.expr(f"try_cast({_sql(c)} AS INT)"), F.lit(-1)).cast("long")


def year_valid(c) -> Column:
    y = F.expr(f"try_cast({_sql(c)} AS INT)")
    return F.coalesce(y != 0, F.lit(False)).cast("long")


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("year helpers take a column name")


# --- TXT-06 / TXT-10: guarded ratios ------------------------------------------
def ratio_or_zero(num, den) -> Column:
    num, den = _c(num), _c(den)
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


def share_or_null(num, den) -> Column:
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


# --- TXT-07: co-author aggregates over the authors array ----------------------
def authors_count(authors) -> Column:
    return array_count(authors)


def authors_chars(authors, field: str) -> Column:
    return F.coalesce(F.aggregate(_c(authors), F.lit(0).cast("long"),
                                  lambda acc, a: acc + F.coalesce(F.length(a[field]), F.lit(0))),
                      F.lit(0).cast("long"))


def authors_tokens(authors, field: str) -> Column:
    """Space tokens summed over authors; an empty string still counts one."""
    return F.coalesce(F.aggregate(
        _c(authors), F.lit(0).cast("long"),
        lambda acc, a: acc + F.when(a[field].isNull(), F.lit(0))
        .otherwise(F.size(F.split(a[field], " ")))), F.lit(0).cast("long"))


# --- TXT-08 / TXT-09: country mentions (case-sensitive substring) -------------
def country_counts(authors, countries=K.COUNTRIES, field: str = "org") -> list[Column]:
    def mentions(country: str) -> Column:
        return F.coalesce(F.size(F.filter(
            _c(authors), lambda a: F.coalesce(a[field], F.lit("")).contains(country))),
            F.lit(0)).cast("long")
    return [mentions(c) for c in countries]


def countries_present(counts: list[Column]) -> Column:
    return sum((F.when(c != 0, 1).otherwise(0) for c in counts), F.lit(0)).cast("long")


def countries_total(counts: list[Column]) -> Column:
    return sum(counts, F.lit(0)).cast("long")


# --- TXT-11: same-org co-author counts against a matched org ------------------
def same_org_count(authors, matched_org, field: str = "org") -> Column:
    m = _c(matched_org)
    return F.coalesce(F.size(F.filter(_c(authors), lambda a: a[field] == m)), F.lit(0)).cast("long")


# --- TXT-12 / TXT-13: tagged field text and composed document ------------------
def tagged(tag: str, c) -> Column:
    c = _c(c)
    return F.concat(F.lit(tag + ":"),
                    F.when(_empty(c), F.lit("None")).otherwise(c))


def tagged_keywords(arr) -> Column:
    arr = _c(arr)
    return F.concat(F.lit("keywords:"),
                    F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, F.array_join(arr, " "))
                    .otherwise(F.lit("None")))


def py_str(c) -> Column:
    """Python's str(): None prints as 'None'."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def compose_text(title, abstract, keywords, venue, year, limit: int | None = None) -> Column:
    """title + ' ' + abstract (tag included, cut to `limit` chars if one is given) + keywords + venue + year."""
    return F.concat_ws(" ", tagged("title", title),
                       tagged("abstract", abstract) if limit is None else F.substring(tagged("abstract", abstract), 1, limit),
                       tagged_keywords(keywords),
                       F.concat(F.lit("venue:"), py_str(venue)),
                       F.concat(F.lit("year:"), py_str(year)))


# --- TXT-14 / TXT-15: name and org normalisation -------------------------------
NAME_SYMBOLS = "(?U)[^一-龥\\w\\s]"


def normalise_name(c) -> Column:
    """Strip symbols (Unicode-aware, Han kept) and lower-case."""
    return F.lower(F.regexp_replace(_c(c), NAME_SYMBOLS, ""))


def lower_orgs(authors, field: str = "org") -> Column:
    return F.transform(_c(authors), lambda a: F.lower(F.coalesce(a[field], F.lit(""))))


def author_names(authors, field: str = "name", readings=None) -> Column:
    """Normalised names; with ``readings`` (``names.Readings``) Han characters are read before symbols go."""
    return F.transform(_c(authors), lambda a: normalise_name(readings.text(a[field]) if readings else a[field]))


def has_han(c) -> Column:
    return _c(c).rlike("[一-鿿]")


# --- TXT-20: graph feature fallback (year 2000 / venue length 0 together) -----
def graph_year_fallback(year, venue) -> tuple[Column, Column]:
    y = F.expr(f"try_cast({_sql(year)} AS INT)")
    bad = y.isNull() | _c(venue).isNull()
    return (F.when(bad, F.lit(K.GRAPH_YEAR_FALLBACK)).otherwise(y).cast("long"),
            F.when(bad, F.lit(0)).otherwise(F.length(_c(venue))).cast("long"))
