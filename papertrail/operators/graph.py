"""Paper-graph construction per author profile (GRF-01..08, JON-03..05, FLT-01/02).

Edges are found with prefix-filtered inverted indexes (``overlap``): each paper is
indexed under its distinct elements but the most frequent ones that the threshold
spares, so papers that share only the profile's own name never meet; there is no
within-author cross join.  Hot (author, element) keys are split by counted rows.

Input ``pp`` is one row per (author, paper row): author_id, seq, paper_id and
the arrays/columns the edge kinds read.  ``seq`` identifies the row inside the
profile, so a paper listed twice forms a self-loop like in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail import constants as K
from papertrail.functions import text as T
from papertrail.operators import overlap as O

PAIR_KEY = ["author_id", "src_seq", "src", "dst_seq", "dst"]
EDGE_COLS = ["author_id", "src", "dst", "weight"]

# Priority for merging edge kinds: a later kind overwrites an earlier one.
KIND_PRIORITY = {"coauthor": 1, "org": 2, "venue": 3, "keyword": 4}


def shared_counts(pp: DataFrame, elements, least: int = 1, **kw) -> DataFrame:
    """JON-03: for every ordered pair of distinct rows of one author that share ``least`` elements or more, the number
    of shared elements (distinct, non-null)."""
    return O.overlap_pairs(pp, elements, least, **kw)


def threshold_edges(pp: DataFrame, elements, min_shared: int, offset: int, kind: str, **kw) -> DataFrame:
    """Pairs with at least ``min_shared`` shared elements; weight = shared - offset."""
    return shared_counts(pp, elements, min_shared, **kw).select(
        *PAIR_KEY, (F.col("shared") - offset).cast("long").alias("weight"), F.lit(kind).alias("kind"))


# --- GRF-01: co-author edges on exact normalised names -----------------------
def coauthor_edges(pp: DataFrame, names_col: str = "names",
                   min_shared: int = K.MIN_SHARED_NAMES, **kw) -> DataFrame:
    return threshold_edges(pp, F.col(names_col), min_shared, 1, "coauthor", **kw)


# --- GRF-03: co-organisation edges -------------------------------------------
def org_edges(pp: DataFrame, orgs_col: str = "orgs",
              min_shared: int = K.MIN_SHARED_ORGS, **kw) -> DataFrame:
    return threshold_edges(pp, F.col(orgs_col), min_shared, 1, "org", **kw)


# --- GRF-05: co-keyword edges (raw, case-sensitive) ---------------------------
def keyword_edges(pp: DataFrame, keywords_col: str = "keywords",
                  min_shared: int = K.MIN_SHARED_KEYWORDS, **kw) -> DataFrame:
    return threshold_edges(pp, F.col(keywords_col), min_shared, 0, "keyword", **kw)


# --- GRF-04 / JON-04: same-venue edges, NULL = NULL and '' = '' match ----------
def venue_key(venue_col: str = "venue"):
    """Null-safe, hashable key: null and '' are different values, each matching itself."""
    v = F.col(venue_col)
    return F.struct(v.isNull().alias("is_null"), F.coalesce(v, F.lit("")).alias("v"))


def venue_edges(pp: DataFrame, venue_col: str = "venue", **kw) -> DataFrame:
    """Every pair of a clique, as large as its output; ``venue_cliques`` holds the same edges in linear space."""
    return shared_counts(pp, F.array(venue_key(venue_col)), 1, **kw).select(
        *PAIR_KEY, F.lit(1).cast("long").alias("weight"), F.lit("venue").alias("kind"))


def venue_cliques(pp: DataFrame, venue_col: str = "venue") -> DataFrame:
    """Factorised form of the venue edges: one row per paper row with its clique
    key and size.  Its implied edge set is every ordered pair of distinct rows in
    one clique; propagation consumes this form without forming the pairs."""
    k = venue_key(venue_col)
    sizes = (pp.groupBy("author_id", k.alias("clique"))
             .agg(F.count(F.lit(1)).alias("clique_size")))
    return pp.select("author_id", "seq", "paper_id", k.alias("clique")).join(
        sizes, ["author_id", "clique"])


# --- GRF-02 / JON-05: token-subset co-author pairs -----------------------------
def subset_pair_counts(pp: DataFrame, names_col: str = "names", least: int = 1, **kw) -> DataFrame:
    """Number of (i, j) position pairs whose name token set of row A is contained in the token set of row B, where it
    is ``least`` or more."""
    return O.subset_pairs(pp, F.col(names_col), least, **kw)


def subset_coauthor_edges(pp: DataFrame, names_col: str = "names",
                          min_shared: int = K.MIN_SHARED_NAMES, **kw) -> DataFrame:
    return subset_pair_counts(pp, names_col, min_shared, **kw).select(
        *PAIR_KEY, (F.col("shared") - 1).cast("long").alias("weight"), F.lit("coauthor").alias("kind"))


def profile_sizes(pp: DataFrame) -> DataFrame:
    """AGG-05: papers per profile (positives + outliers), partial aggregation."""
    return pp.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_papers"))


def with_profile_size(pp: DataFrame) -> DataFrame:
    return pp.join(profile_sizes(pp), "author_id")


# --- FLT-01: drop oversized profiles ----------------------------------------
def drop_large_profiles(pp: DataFrame, max_papers: int) -> DataFrame:
    return (with_profile_size(pp).filter(F.col("n_papers") <= max_papers).drop("n_papers"))


# --- GRF-06: merge kinds, later kind overwrites the weight -------------------
def split_coauthor_edges(pp: DataFrame, names_col: str = "names", subset_above: int = K.SUBSET_MATCH_PROFILE,
                         **kw) -> DataFrame:
    """GRF-01 for profiles up to ``subset_above`` papers, GRF-02 above it."""
    sized = with_profile_size(pp)
    small = sized.filter(F.col("n_papers") <= subset_above).drop("n_papers")
    large = sized.filter(F.col("n_papers") > subset_above).drop("n_papers")
    return coauthor_edges(small, names_col, **kw).unionByName(subset_coauthor_edges(large, names_col, **kw))


NAME_RULES = {"exact": coauthor_edges, "subset": subset_coauthor_edges}


def pair_edges(pp: DataFrame, *, names_col="names", orgs_col="orgs", keywords_col="keywords", name_rule: str = "exact",
               subset_above: int | None = None, **kw) -> DataFrame:
    """Co-author, org and keyword edges; ``name_rule`` holds for all profiles, whatever their size, unless ``subset_above``
    is given: then larger profiles match by token subset, the others by equal names."""
    names = (NAME_RULES[name_rule](pp, names_col, **kw) if subset_above is None
             else split_coauthor_edges(pp, names_col, subset_above, **kw))
    return (names.unionByName(org_edges(pp, orgs_col, **kw))
            .unionByName(keyword_edges(pp, keywords_col, **kw)))


def typed_edges(pp: DataFrame, *, venue_col="venue", **kw) -> DataFrame:
    """All four edge kinds as one typed edge list (author_id, src, dst, weight, kind)."""
    hot = {k: v for k, v in kw.items() if k == "hot_rows"}
    return pair_edges(pp, **kw).unionByName(venue_edges(pp, venue_col, **hot))


def merge_edges(typed: DataFrame) -> DataFrame:
    """One edge per (author, src, dst): weight and kind of the highest-priority kind.

    Row pairs collapse onto paper pairs here, as in a graph keyed by paper id."""
    prio = F.create_map(*[x for k, v in KIND_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    t = typed.withColumn("_p", prio[F.col("kind")])
    return (t.groupBy("author_id", "src", "dst")
            .agg(F.max_by(F.struct("weight", "kind"), F.struct("_p", "src_seq", "dst_seq")).alias("w"))
            .select("author_id", "src", "dst", F.col("w.weight").alias("weight"),
                    F.col("w.kind").alias("kind")))


# --- GRF-07 / GRF-08: nodes and self-loops -------------------------------------
def nodes(pp: DataFrame, feature_cols: list[str], label_col: str = "label") -> DataFrame:
    """One node per (author, paper); a duplicated paper keeps its last row."""
    feats = F.array(*[F.col(c).cast("double") for c in feature_cols]) if feature_cols \
        else F.array().cast("array<double>")
    return (pp.groupBy("author_id", "paper_id")
            .agg(F.max_by(F.struct(feats.alias("x"), F.col(label_col).alias("y")), F.col("seq")).alias("n"))
            .select("author_id", "paper_id", "n.x", "n.y"))


def add_self_loops(edges: DataFrame, node_df: DataFrame) -> DataFrame:
    loops = node_df.select("author_id", F.col("paper_id").alias("src"),
                           F.col("paper_id").alias("dst"), F.lit(1).cast("long").alias("weight"),
                           F.lit("self").alias("kind"))
    return edges.select("author_id", "src", "dst", "weight", "kind").unionByName(loops)


# --- FLT-02: drop profiles without any edge ----------------------------------
def drop_edgeless(node_df: DataFrame, edges: DataFrame) -> DataFrame:
    return node_df.join(edges.select("author_id").distinct(), "author_id", "left_semi")


def graph_input(pp: DataFrame, authors_col: str = "authors", readings=None) -> DataFrame:
    """Add the normalised name (Han read by ``readings`` first, if given) and lower-cased org arrays the edge kinds read."""
    return pp.withColumn("names", T.author_names(F.col(authors_col), readings=readings)) \
             .withColumn("orgs", T.lower_orgs(F.col(authors_col)))
