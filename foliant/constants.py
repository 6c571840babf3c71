"""Lists, thresholds and patterns whose exact content decides the results."""

# --- file formats -----------------------------------------------------------------
FORMATS = ["pdf", "epub", "chm", "mobi", "azw3", "fb2"]

# language names by the low byte of a locale id
LANGUAGES = {
    0x09: "English",
    0x04: "Chinese",
    0x07: "German",
    0x0C: "French",
    0x0A: "Spanish",
    0x10: "Italian",
    0x11: "Japanese",
    0x12: "Korean",
    0x16: "Portuguese",
    0x19: "Russian",
}

# --- chunking ---------------------------------------------------------------------
INDEX_CHUNK_CHARS = 5000
EMBED_CHUNK_WORDS = 200
SENTENCE_ENDS = ".!?"

# --- search -----------------------------------------------------------------------
KEYWORD_WEIGHT = 0.4
RANGE_FLOOR = 0.001
VECTOR_TOP_BOOKS = 50
CHUNK_RESULTS = 12
KEYWORD_BOOST = 0.25
KEYWORD_BASE = 0.45
HINT_STORE = 0.3
HINT_MATCH = 0.4
HINT_BOOST = 0.15
QUALITY_GATE = 0.15
FALLBACK_LOW, FALLBACK_HIGH = 0.3, 0.6
TIER_FILE, TIER_TITLE, TIER_AUTHOR = 100.0, 50.0, 40.0
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
SNIPPET_TOKENS = 40
SNIPPET_CHARS = 200
FIND_CONTEXT = 30
PREVIEW_CHARS = 800

# words ignored when match terms are built
MATCH_STOP_WORDS = """
find me the a an is are was were be been and or not for with from to in on at of
i my we you it its this that some any all want need give show get make have has do does
can could would should will about what how which like please just very really also so but if then
""".split()

# words ignored when salient keywords are picked
KEYWORD_STOP_WORDS = """
find me a an the is are was were be and or not for with from to in on at of
i my we you it its this that some any all want need give show get make have has do does
can could would should will about what how which like please just very really also so but if then
recipe recipes cook cooking dish meal food tell list
""".split()

# --- prompts ----------------------------------------------------------------------
PROMPT_EXCERPTS = 10
CITATIONS_GENERAL, CITATIONS_COOKBOOK = 5, 10
HISTORY_TURNS = 8
SUMMARY_BATCH_WORDS = 4000
TOP_UP_BELOW = 3
SUMMARY_PHRASES = [
    "summarize", "summary", "summarise", "overview",
    "what is this book about", "what's this book about",
    "tell me about this book", "describe this book",
    "book summary", "book overview",
]

# --- pattern score ----------------------------------------------------------------
# each match (or distinct word) adds the weight, up to the given number of times
QUANTITY_PATTERNS = [
    r"\d+\s*(cup|cups|tbsp|tsp|tablespoon|teaspoon|oz|ounce|pound|lb|kg|gram|ml|liter)",
    r"\d+/\d+\s*(cup|tbsp|tsp)",
    r"\d+\s*(clove|bunch|sprig|pinch|dash|handful)",
]
QUANTITY_WEIGHT, QUANTITY_MAX = 0.08, 5
INSTRUCTION_WORDS = [
    "preheat", "bake", "roast", "simmer", "boil", "sauté", "saute",
    "fry", "grill", "broil", "whisk", "stir", "fold", "knead",
    "chop", "dice", "mince", "slice", "drain", "season",
    "marinate", "glaze", "reduce", "deglaze", "blanch",
]
INSTRUCTION_WEIGHT, INSTRUCTION_MAX = 0.06, 6
TIME_PATTERN = r"\d+\s*(minute|hour|min|hr)s?"
TIME_WEIGHT, TIME_MAX = 0.05, 3
TEMPERATURE_PATTERN = r"\d+\s*°?\s*(f|c|fahrenheit|celsius|degrees)"
TEMPERATURE_WEIGHT, TEMPERATURE_MAX = 0.1, 2
HEADER_WORDS = [
    "ingredients", "instructions", "directions", "method", "preparation",
    "serves", "servings", "yield", "makes",
]
HEADER_WEIGHT, HEADER_MAX = 0.08, 3

# --- page type --------------------------------------------------------------------
FRONT_MATTER = [
    "table of contents", "contents", "index", "copyright",
    "acknowledgments", "acknowledgements", "dedication",
    "about the author", "foreword", "preface", "introduction",
    "bibliography", "glossary", "credits",
]
FRONT_MATTER_CHARS = 60
INDEX_LINE_PATTERN = r"(?m)^[A-Za-z][A-Za-z\s,\-']{2,40},\s*\d{1,4}(\s*,\s*\d{1,4})*\s*$"
INDEX_LINES = 4
LEADER_LINES = 3
DIGIT_SHARE = 0.2

# --- annotations ------------------------------------------------------------------
TEXT_TOOLS = ["highlight", "underline", "strikethrough", "freeText", "comment"]
SHAPE_TOOLS = ["line", "arrow", "circle", "square"]

# --- records in model answers -----------------------------------------------------
BULLETS = ["-", "•", "*", "·", "—", "–"]
RECORD_HEADER_PATTERN = r"(?i)^\s*recipe\s+\d+\s*[:.\-—]"
EXCERPT_PATTERN = r"(?i)excerpt\s*#?\s*(\d+)"
ID_LIST_PREFIX = "BOOKS:"
UUID_PATTERN = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"

# --- text folding -----------------------------------------------------------------
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
