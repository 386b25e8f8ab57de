"""Word lists, name keywords and patterns that results depend on."""

from __future__ import annotations

# Stop words of the basic text step.
BASIC_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with",
]

# Name parts that rule a column out as long text.
IDENTIFIER_PARTS = ["name", "id", "location", "city", "country", "state", "address"]
CATEGORY_PARTS = [
    "gender", "sex", "status", "category", "type", "class", "label",
    "group", "level", "grade", "rank", "tier", "flag", "indicator",
    "code", "tag", "segment",
]

# Whole words that mark an identifier column.
IDENTIFIER_WORDS = [
    "id", "name", "serial", "serial_no", "index", "uid", "unique", "uuid", "row_id", "sno",
]

# Name parts that mark a date column.
DATETIME_PARTS = ["date", "time", "timestamp"]

# First-category keywords, tried in this order.
STRICT_CATEGORIES = ["Male", "Female", "Other", "Yes", "No", "True", "False"]
LOOSE_CATEGORIES = [
    "Male", "Female", "male", "female", "M", "F", "Yes", "No", "True", "False",
    "High", "Medium", "Low",
]

# The characters Python counts as whitespace, as text and as a (?U) regex class body.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\s\x1c-\x1f"

# English noun endings, (ending, replacement).
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]
