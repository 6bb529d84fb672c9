"""Schemas of the canonical tables."""

TERM = "term_id string, ord int, name string, definition string, tags map<string,array<string>>"
EDGE = "child string, parent string"
CLOSURE = "term_id string, ancestor string, dist int"
ALT = "alt_id string, main_id string"
PROFILE = "profile_id string, pos int, term_id string"
ITEM = "term_id string, item_id string"
RELATION = "term1 string, term2 string, value double"
KEYWORD = "kwd_id string, text string"
CORPUS = (
    "pmid string, text string, original_filename string, year int, text_length int, number_of_sentences int, "
    "length_of_sentences array<int>, title string, article_type string, article_category string"
)
