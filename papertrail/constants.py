"""Fixed values that must equal the reference's for identical results.

FIXED VALUES: do not edit.  They are listed plainly, in their natural order.
"""

# Country names searched in organisation strings, in feature order country_0..12.
COUNTRIES = ["China", "Japan", "Canada", "Germany", "France", "Italy", "Sweden",
             "Australia", "Singapore", "Netherlands", "Korea", "UK", "USA"]
# The graph path uses only the first ten.
GRAPH_COUNTRIES = COUNTRIES[:10]

# Stop lists of the tabular word-vector corpus (general, special, checked).
STOP_GENERAL = ["did", "not", "at", "based", "in", "of", "for", "on", "and", "to", "an",
                "using", "with", "the", "by", "we", "be", "is", "are", "can"]
STOP_SPECIAL = ["university", "univ", "china", "department", "dept", "laboratory", "lab",
                "school", "al", "et", "institute", "inst", "college", "chinese", "beijing",
                "journal", "science", "international"]
STOP_CHECKED = ["a", "was", "were", "that", "2", "key", "1", "technology", "0", "sciences",
                "as", "from", "r", "3", "academy", "this", "nanjing", "shanghai", "state",
                "s", "research", "p", "results", "peoples", "4", "which", "5", "high",
                "materials", "study", "control", "method", "group", "c", "between", "or",
                "it", "than", "analysis", "system", "sci", "two", "6", "has", "h", "after",
                "different", "n", "national", "japan", "have", "cell", "time", "zhejiang",
                "used", "data", "these", "wuhan", "tsinghua", "kyoto"]
TABULAR_STOPWORDS = STOP_GENERAL + STOP_SPECIAL + STOP_CHECKED
# The graph corpus omits "did", "not" and "kyoto" and adds a stopword file
# (read with sources.io.read_stopwords) on top.
GRAPH_STOPWORDS = ([w for w in STOP_GENERAL if w not in ("did", "not")] + STOP_SPECIAL
                   + [w for w in STOP_CHECKED if w != "kyoto"])

# Punctuation characters replaced by a space when cleaning a phrase; the
# backslash is NOT one of them.
PUNCTUATION = "!“”\"#$%&'()*+,-./:;<=>?@[]^_`{|}~—～’"

# Thresholds.
MAX_PROFILE_PAPERS = 1600      # training graph build drops larger profiles
SUBSET_MATCH_PROFILE = 800     # larger profiles use token-subset name matching
MIN_SHARED_NAMES = 2           # co-author edge: shared names > 1
MIN_SHARED_ORGS = 2            # co-org edge: shared orgs > 1
MIN_SHARED_KEYWORDS = 1        # keyword edge: shared keywords > 0
TOP_K = 5
N_FOLDS = 5
WINKLER_SCALE = 0.1
ABSTRACT_CHARS = 300
ENCODER_BATCH = 256
GRAPH_YEAR_FALLBACK = 2000

# Final blend: 0.7 * (0.3 * w2v + 0.7 * sci) + 0.3 * trees.
BLEND_W2V = 0.3
BLEND_SCI = 0.7
BLEND_GRAPH = 0.7
BLEND_TREES = 0.3

# Propagation settings of the graph network branches.
APPNP_STEPS = 5
APPNP_ALPHA = 0.2
SGC_HOPS = 4
CHEB_LAMBDA_MAX = 2.0
