"""Fixed values that decide results. Plain text, natural order."""

# --- Fixed values: corpus and model sizes -----------------------------------
DEFAULT_BATCH_SIZE = 512
EMBEDDING_SIZE = 128
LEARNING_RATE = 0.1
MIN_IDENTIFIER_QUERY_LENGTH = 12
BPE_SHARE = 0.5
VOCABULARY_SIZE = 10000
CODE_LENGTH = 200
QUERY_LENGTH = 30
NGRAM_MIN = 2
NGRAM_MAX = 8
TOKEN_COUNT_THRESHOLD = 10
MAX_FILE_CHARS = 100000
MAX_QUERY_CHARS = 256
MAX_CODE_CHARS = 4096
MIN_SAMPLES_PER_LANGUAGE = 800
WEB_RESULTS = 20
CLI_RESULTS = 30
EVALUATION_RESULTS = 150
TREES = 200
REPOSITORY_TREES = 600
EVALUATION_BATCH = 1000
REPOSITORY_EVALUATION_BATCH = 50
PATIENCE = 5
REPOSITORY_PATIENCE = 3
MAX_EPOCHS = 100
NORM_EPSILON = 1e-8
BATCH_NORM_EPSILON = 1e-5
SPLIT_SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}

# --- Fixed values: reserved tokens ------------------------------------------
PAD = "__pad"
UNK = "__unk"
SOW = "__sow"
EOW = "__eow"
MASK_TOKEN = "%MASK%"
UNKNOWN_TOKEN = "%UNK%"

# --- Fixed values: repository update states ---------------------------------
UPDATE_IN_PROGRESS = 0
UPDATE_FINISHED = 1
UPDATE_ERROR = 2

# --- Fixed values: languages -------------------------------------------------
LANGUAGES = ["go", "java", "javascript", "php", "python", "ruby"]
EXTENSIONS = {
    "go": "go",
    "java": "java",
    "javascript": "js",
    "php": "php",
    "python": "py",
    "ruby": "rb",
}
IGNORED_PATH_PARTS = {
    "go": ["test", "vendor"],
    "java": ["test", "tests"],
    "javascript": ["vendor", "test", "node_modules", ".min", "dist"],
    "php": ["test", "tests"],
    "python": ["test"],
    "ruby": ["test", "vendor"],
}
BLACKLISTED_IDENTIFIERS = {
    "java": ["toString", "hashCode", "equals", "finalize", "notify", "notifyAll", "clone"],
    "javascript": ["toString", "toLocaleString", "valueOf"],
}
HASH_COMMENT_LANGUAGES = ["python", "ruby", "php"]
SLASH_COMMENT_LANGUAGES = ["java", "javascript", "go", "php"]

# --- Fixed values: patterns --------------------------------------------------
# White space as trimmed by a Unicode-aware strip.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
DOCSTRING_TOKEN = (
    r"[^\s,'\"`.():\[\]=*;>{}+\-./\\]+|\\+|\.+|\(\)|\{\}|\[\]|\(+|\)+|:+|\[+|\]+"
    r"|\{+|\}+|=+|\*+|;+|>+|\++|-+|/+"
)
COMMENT_OPENING = r"^(?:\*|/\*\*|//|/\*)"
LANGUAGE_FILTER = r"\+language=(\S+)"

# Lexer alternatives: a string, a comment, a word, a number, any other symbol.
LEX_STRING = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|' + r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
LEX_HASH_COMMENT = r"#[^\n]*"
LEX_SLASH_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
LEX_WORD = r"[\p{L}_][\p{L}\p{N}_]*"
LEX_NUMBER = r"[0-9]+(?:\.[0-9]+)?"
LEX_SYMBOL = r"[^\s]"
