"""Fixed values that results must show, written out once more: the checking SQL does not take them from
the library under test."""

# Stop words of the basic text step.
BASIC_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its",
    "of", "on", "that", "the", "to", "was", "will", "with",
]

# English stop words.
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which
    who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will
    just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
    they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
    wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
    shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
""".split()

# English noun endings, (ending, replacement).
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]

# First-category keywords, tried in this order.
STRICT_CATEGORIES = ["Male", "Female", "Other", "Yes", "No", "True", "False"]
LOOSE_CATEGORIES = [
    "Male", "Female", "male", "female", "M", "F", "Yes", "No", "True", "False", "High", "Medium", "Low",
]

# Name parts that rule a column out as long text.
NO_TEXT_PARTS = [
    "name", "id", "location", "city", "country", "state", "address",
    "gender", "sex", "status", "category", "type", "class", "label", "group", "level", "grade", "rank",
    "tier", "flag", "indicator", "code", "tag", "segment",
]

# Other names of the encoding step and the strategy each stands for.
ENCODING_ALIASES = {
    "onehot": "onehot", "onehot_encode": "onehot", "label": "label", "label_encode": "label",
}

# The order of steps; others run last, at 1000.
STEP_ORDER = {
    "skip": 0, "fix_infinite": 10, "remove_outliers": 20, "fill_missing": 30, "deduplicate": 40,
    "drop_constant": 50, "handle_datetime": 60, "handle_skewness": 70, "categorical_encode": 80,
    "onehot": 80, "onehot_encode": 80, "label": 80, "label_encode": 80, "text_clean": 90,
    "remove_stopwords": 100, "lemmatize": 110, "tfidf": 120, "standardize": 130,
}
LAST = 1000
TEXT_OPERATIONS = ["text_clean", "remove_stopwords", "lemmatize", "tfidf"]
