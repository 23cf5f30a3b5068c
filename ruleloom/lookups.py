"""Words, phrases, thresholds and tables that results depend on. Nothing here is logic."""

from __future__ import annotations

MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")

# -- rule sheets ------------------------------------------------------------------------------------------------------
# Phrases by which a sheet's header row is found, and by which columns are found when roles can't be resolved.
HEADER_PHRASES = {
    "section": ("section", "labels"),
    "subsection": ("sub-section", "sub section", "section heder", "section header"),
    "item": ("item name and number", "item", "field", "labels"),
    "if_missing": ("if = blank; note", "if missing (blank), print", "if missing (blank)", "if missing", "if blank"),
    "if_unknown": ("if = unknown; note", "if = unknown, print", "if = unknown", "if unknown", "if = unknown print", "if unknown print", "if unknown, print", "if=unknown", "unknown"),
    "instruction": ("printing instructions", "printing instructions--", "print instructions"),
    "label_printed": ("label printed",),
    "example": ("example",),
    "max_chars": ("max. chars.", "max chars"),
    "shrink_size": ("if shrink to fit needed char size", "min char size", "shrink"),
    "char_size": ("char. size", "start char size", "char size"),
    "bold": ("bold",),
    "font": ("font",),
}

# The roles of a rule sheet's columns and the phrases that name them.
ROLE_PHRASES = {
    "section": ("section", "form section", "block"),
    "subsection": ("sub section", "subsection", "sub-section", "group"),
    "item": ("item name and number", "item name number", "item name", "item", "field name", "field label", "label", "data element", "element name", "field", "printed label"),
    "item_number": ("item number", "item no", "item #", "line number", "row number"),
    "instruction": ("printing instructions", "printing instruction", "print instructions", "print instruction", "print rule", "print rules", "instructions", "instruction", "printing rule", "printing rules", "rule"),
    "example": ("example", "examples", "sample", "sample value", "example value", "sample output", "example output", "values"),
    "if_unknown": ("if unknown print", "if unknown", "if = unknown", "if=unknown", "if value unknown", "unknown rule", "if unknown value", "when unknown"),
    "if_missing": ("if missing blank print", "if missing print", "if missing", "if blank", "if = blank", "if=blank", "if value missing", "when blank", "missing rule"),
    "max_chars": ("max chars", "max characters", "maximum characters", "char limit", "character limit", "max length"),
    "shrink_char_size": ("if shrink to fit needed char size", "shrink to fit char size", "shrink char size", "shrink to fit"),
    "char_size": ("char size", "character size", "font size", "point size"),
    "bold": ("bold", "is bold", "bold?", "font weight"),
    "font": ("font", "font name", "typeface", "font family"),
    "label_printed": ("label printed", "printed label text", "label text", "label on form"),
}
REQUIRED_ROLES = ("item", "instruction")
NOTE_DELIMITERS = (";", " note:", " note ", "(note", " - note", "\n")
HEADER_PUNCTUATION = "_-/\\.:()[]=?"
ROLE_FLOOR = 82.0

NO_PRINT_PHRASES = ("NO PRINT RULE", "LEAVE BLANK")
LEAKED_MARKER = "NO PRINT RULES IN THIS SECTION"
DATE_PARTS = ("MONTH", "MM", "DAY", "DD", "YEAR", "YYYY")
YEAR_PARTS = ("YEAR", "YYYY")
TYPOS = ("LASE", "DESIGNATORR", "OFFCIANT", "EDUCATIONN", "ORIGN", "SPECIFIY")
FORM_HINTS = {
    "Marriage Application": ("WISCONSIN MARRIAGE LICENSE APPLICATION", "F-05061", "STATISTICAL INFORMATION"),
    "CERTIFICATE OF MARRIAGE": ("CERTIFICATE OF MARRIAGE", "STATE FILE NUMBER", "STATE FILE DATE"),
    "Court Ordered Amendment": ("REPORT OF COURT ORDER TO AMEND", "F-05093", "PART I CURRENT MARRIAGE RECORD INFORMATION"),
    "Officiant Affidavitt": ("OFFICIANT AFFIDAVIT", "F-01481", "MARRIAGE RECORD AMENDMENT REQUEST"),
    "Marriage License": ("WISCONSIN MARRIAGE LICENSE", "ISSUED BY COUNTY CLERK"),
}

# -- values -----------------------------------------------------------------------------------------------------------
PLACEHOLDER_WORDS = ("UNKNOWN", "UNNAMED", "NONE")
PLACEHOLDER_VALUES = ("", "N/A", "NA", "NONE", "99999")
LINE_PLACEHOLDERS = ("UNKNOWN", "UNNAMED")
BOLD_WORDS = ("yes", "y", "true", "bold")
SELECTED_WORDS = ("selected", "true", "1", "yes", "x", "checked")
WRAPPER_WORDS = ("options", "matched", "expected", "confidence", "score", "reason", "result")
SPECIFY_PHRASES = ("specify", "other, specify", "please specify", "if other")
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
SSN_MASK = "***-**-****"

# -- identity ---------------------------------------------------------------------------------------------------------
STOP_WORDS = ("a", "an", "and", "apply", "at", "by", "check", "choose", "completed", "enter", "field", "for", "from", "in", "is", "label", "of", "on", "one", "option", "or", "the", "this", "time", "to", "with")
GENERIC_WORDS = ("name", "date", "number", "country", "county", "city", "state", "parent", "party", "field", "value")
PART_WORDS = (
    "FIRST", "FIRST NAME", "MIDDLE", "MIDDLE NAME", "LAST", "LAST NAME", "SUFFIX", "PREFIX", "TITLE", "MAIDEN", "MAIDEN NAME", "SURNAME", "GIVEN", "GIVEN NAME", "INITIAL", "MI",
    "CITY", "STATE", "ZIP", "ZIP CODE", "COUNTY", "COUNTRY", "STREET", "APT", "NUMBER", "MONTH", "DAY", "YEAR",
)
GLYPHS = ("✘", "✔", "☑", "☒", ">", "➢", "•", "·")

# -- matching ---------------------------------------------------------------------------------------------------------
LABEL_FLOOR, ACCEPT_FLOOR = 60.0, 70.0
KIND_PENALTY = -60.0
SECTION_BONUS, SECTION_PENALTY = 12.0, -15.0
SUBSECTION_BONUS, SUBSECTION_PENALTY = 10.0, -15.0
VALUE_CAP, VALUE_DISCOUNT = 90.0, 10.0
PLACEHOLDER_PENALTY = -5.0
PART_FLOOR, PART_LINE = 82.0, 0.012
SEQUENCE_WEIGHTS, SEQUENCE_SPAN, SEQUENCE_FLOOR = (0.65, 0.20, 0.15), 8, 0.55
OPTION_FLOOR = 70.0
IDENTITY_RATIO, IDENTITY_RULE_COVER, IDENTITY_FIELD_COVER = 72.0, 75.0, 60.0
REVIEW_LABEL_FLOOR, REVIEW_MATCH_FLOOR = 88.0, 80.0

# -- layout, as fractions of the page ---------------------------------------------------------------------------------
BAND_RIGHT, BAND_HEIGHT, TIER_SPREAD, BAND_SLACK = 0.11, 0.04, 0.02, 0.005
HEADER_WORDS, HEADER_HEIGHT, HEADER_WIDTH = 6, 0.03, 0.10
LABEL_ABOVE = 0.055
SAME_ROW, ROW_GAP, COLUMN_STEP, COLUMN_SHIFT = 0.010, 0.14, 0.016, 0.06
COMPOSITE_ROW = 0.010
BOX_ROW, BOX_LEFT, BOX_RIGHT, BOX_LABEL_FLOOR, BOX_MOST = 0.018, 0.06, 0.75, 78.0, 24
TOP_OF_PAGE = 0.12
TEXT_LEAST = 4

# -- outcomes ---------------------------------------------------------------------------------------------------------
ROLLUP_ORDER = ("FAIL", "MISSING_DATA", "UNKNOWN_DATA", "PASS")
