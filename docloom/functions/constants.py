"""Formats, patterns and word lists that results depend on."""

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
EPUB = "application/epub+zip"
ODT = "application/vnd.oasis.opendocument.text"

# MIME type by file extension, for detection.
EXTENSION_MIME = {
    ".pdf": "application/pdf",
    ".epub": EPUB,
    ".docx": DOCX,
    ".doc": "application/msword",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".html": "text/html",
    ".htm": "text/html",
    ".rtf": "application/rtf",
    ".xml": "application/xml",
    ".json": "application/json",
    ".csv": "text/csv",
    ".xlsx": XLSX,
    ".odt": ODT,
}

# The extensions that extraction trusts over content.
EXTRACTION_EXTENSIONS = (".pdf", ".epub", ".docx", ".txt", ".md", ".markdown", ".html", ".htm")

# Leading bytes by MIME type, in the order of the test.
SIGNATURES = (
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x89PNG", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"<?xml", "application/xml"),
    (b"<html", "text/html"),
    (b"<!DOCT", "text/html"),
)

# Line starts that mark Markdown, in detection and in extraction.
MARKDOWN_STARTS = ("# ", "## ", "### ", "- ", "* ", "| ", "```", "[", "![]")
MARKDOWN_FILE_STARTS = ("# ", "## ", "```", "| ", "- [")

# Items of lists in Markdown, in plain text, on pages and in OCR text (indent, marker, text).
MARKDOWN_ITEM = r"^(\s*)([-*+]|\d+\.)\s+(.*)"
TEXT_ITEM = r"^(\s*)([-*•]|\d+[.):])\s+(.*)"
PAGE_ITEM = r"^(\s*)([-•*·◦○]\s+|\d+[.)]\s+)(.*)"

# The level that a heading's looks suggest: by the length of one in capitals (below the limit), by the
# parts of its number (6 at most), by its words (this many at most), else.
CAPITAL_LEVELS = ((40, 1), (60, 2))
NUMBER_OF_HEADING = r"^(\d+(?:\.\d+)*)"
DEEPEST, FEW_WORDS, FEW_WORDS_LEVEL, OTHER_LEVEL = 6, 3, 3, 2

# What makes a line of a page a heading. A numbered one is no measure ("1 day: 24 h"); one in capitals is
# no label; a short title holds eight words at most, no sentence punctuation, and nothing of what follows it here.
NUMBERED_HEADING = r"(?!\d+\s+\w+(?:\s+\w+)?:\s*\d)\d+(?:\.\d+)*\.?\s+\S"
NUMBERED_BELOW, CAPITALS_ABOVE, CAPITALS_BELOW = 120, 3, 80
SHORT_TITLE = r"(?=.{1,79}$)[^\s.!?;]+(?:\s+[^\s.!?;]+){0,7}"
NO_TITLE = (
    r"^[\-•*·◦○\d]",
    r"^(?i:See|Source|Note|Ref|Also)\s*:",
    r"(?i)wikipedia:|arxiv:|doi:|https?://",
    r"^(?i:edit)$",
    r"^\S+(?:\s+\S+){0,2}(?<=:)$",
    r"^(?:_|[^\w\s])+$",
    r"^\S{3,}\s+:",
)
DEFINITION = r"(?P<term>[A-Za-z][A-Za-z\s\-]{1,30}):\s*(?P<definition>.+)"
TERM_WORDS, SPLIT_TITLE_BELOW = 4, 40

# A paragraph of OCR text is a heading up to these words and below this length, without sentence
# punctuation unless in capitals; confidence of what OCR text is taken for.
OCR_HEADING_WORDS, OCR_HEADING_BELOW = 6, 80
OCR_CONFIDENCE = {"heading": 0.75, "paragraph": 0.80, "list": 0.75}

# Programming language by file extension.
CODE_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".sh": "bash",
    ".rb": "ruby", ".go": "go", ".rs": "rust", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cc": "cpp",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".r": "r", ".m": "objective-c", ".pl": "perl", ".lua": "lua",
    ".sql": "sql", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".xml": "xml", ".css": "css", ".scss": "scss", ".sass": "sass",
    ".html": "html", ".htm": "html", ".bash": "bash", ".zsh": "zsh",
    ".ps1": "powershell", ".bat": "batch", ".cmd": "batch",
    ".dockerfile": "dockerfile", ".makefile": "makefile", ".mk": "makefile",
    ".graphql": "graphql", ".gql": "graphql", ".proto": "protobuf",
    ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".properties": "properties",
    ".gradle": "groovy", ".groovy": "groovy", ".clj": "clojure",
    ".erl": "erlang", ".ex": "elixir", ".exs": "elixir", ".elm": "elm",
    ".hs": "haskell", ".lhs": "haskell", ".nim": "nim", ".dart": "dart",
    ".v": "v", ".fs": "fsharp", ".fsx": "fsharp", ".ml": "ocaml",
    ".mli": "ocaml", ".pas": "pascal", ".dpr": "pascal",
    ".cr": "crystal", ".jl": "julia", ".tcl": "tcl", ".ada": "ada",
    ".adb": "ada", ".ads": "ada", ".coffee": "coffeescript",
    ".litcoffee": "coffeescript", ".jsx": "javascript", ".tsx": "typescript",
    ".vue": "vue", ".svelte": "svelte", ".sol": "solidity",
    ".vy": "vyper", ".cairo": "cairo", ".move": "move",
    ".rsx": "rust", ".rlib": "rust", ".purs": "purescript",
}

# Language by interpreter named in a shebang line.
INTERPRETER_LANGUAGE = {
    "python": "python", "python3": "python", "python2": "python",
    "node": "javascript", "bash": "bash", "sh": "bash", "zsh": "zsh",
    "ruby": "ruby", "perl": "perl", "lua": "lua", "php": "php",
    "r": "r", "julia": "julia", "wish": "tcl",
}

# Patterns of cross-references, in the order of the scan.
REFERENCE_PATTERNS = (
    ("url", r"https?://[^\s<>\"')\]]+"),
    ("arxiv", r"ar[Xx]iv:\d{4}\.\d{4,5}(?:v\d+)?"),
    ("doi", r"10\.\d{4,}/[^\s]+"),
    ("wikipedia", r"[Ww]ikipedia:[^\s]+"),
    ("email", r"[\w.-]+@[\w.-]+\.\w+"),
)

# Definitions in source code (function, class, imports by family).
FUNCTION_PATTERN = (
    r"^[ \t]*(?:async\s+)?(?:def|function|func|fn|void|int|float|double|bool|string|"
    r"var|let|const|public\s+static|private\s+static|protected\s+static|static)?\s*"
    r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*(?:->\s*\S+\s*)?[{:;=]"
)
CLASS_PATTERN = r"^[ \t]*(?:class|struct|interface|trait|protocol|enum)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
IMPORT_PATTERNS = (
    r"^[ \t]*(?:import|from)\s+([a-zA-Z_][a-zA-Z0-9_.]*)",
    r"^[ \t]*#include\s+[<\"]([^>\"]+)[>\"]",
    r"^[ \t]*(?:require|require_once|include|include_once)\s*\(?['\"]([^'\"]+)['\"]\)?",
    r"^[ \t]*(?:using)\s+([a-zA-Z_][a-zA-Z0-9_.]*);",
    r"^[ \t]*(?:extern\s+crate|use)\s+([a-zA-Z_][a-zA-Z0-9_:]*);",
    r"^[ \t]*(?:package)\s+([a-zA-Z_][a-zA-Z0-9_.]*);",
    r"^[ \t]*(?:module)\s+([a-zA-Z_][a-zA-Z0-9_.]*)",
    r"^[ \t]*(?:library|require)\s*\(?['\"]([^'\"]+)['\"]\)?",
)
NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch", "else", "elif", "return", "import", "from", "class")

# Roles by the first keyword a heading contains.
SECTION_ROLES = (
    ("introduction", "introduction"), ("background", "background"), ("related work", "background"),
    ("method", "method"), ("methods", "method"), ("methodology", "method"), ("approach", "method"),
    ("experiment", "results"), ("experiments", "results"), ("results", "results"), ("evaluation", "results"),
    ("discussion", "discussion"), ("conclusion", "conclusion"), ("conclusions", "conclusion"),
    ("abstract", "abstract"), ("references", "reference"), ("acknowledgment", "metadata"),
)

# Block types without embeddings; keys that are no keys; tracking parameters; months.
NOT_EMBEDDED = ("metadata", "page_header", "page_footer", "footnote", "unknown")
EXCLUDED_KEYS = ("wikipedia", "see", "arxiv", "http", "https", "doi", "ref", "source")
EXCLUDED_KEY_PARTS = (".com", ".org", ".net", "http")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# HTML elements that are noise; meta properties and names that are kept.
HTML_NOISE = (
    "script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "svg", "canvas",
    "form", "input", "button", "select", "textarea", "template", "dialog", "address",
)
# HTML elements without an end tag.
HTML_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
META_PROPERTIES = ("og:title", "og:description", "og:url", "og:type", "og:site_name")
META_NAMES = ("description", "author", "keywords", "language", "twitter:title", "twitter:description")
CODE_CLASSES = ("python", "javascript", "java", "cpp", "bash", "sql")

# Block types, node types and error codes of the schema.
BLOCK_TYPES = (
    "heading", "paragraph", "table", "list", "code_block", "figure_caption", "footnote", "quote", "metadata",
    "equation", "abstract", "keyword_block", "reference_entry", "page_header", "page_footer",
    "image_placeholder", "annotation", "divider", "unknown",
)
