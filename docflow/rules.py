"""Fixed values that decide results: lists, patterns and limits, as the documentation pipeline defines them."""

TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "ref", "referral", "source")
DOC_SIGNALS = ("/docs", "/documentation", "/reference", "/guide", "/api", "/learn", "/manual", "/tutorial")
EXCLUDED_SIGNALS = ("/blog", "/login", "/signup", "/pricing", "/careers", "/contact", "/support/tickets")
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".map", ".zip", ".tar", ".gz", ".mp4", ".mov", ".avi")
NON_DOC_ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js", ".mjs", ".map", ".pdf", ".zip", ".tar", ".gz", ".mp4", ".mp3", ".ico")
BULK_ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".map", ".zip", ".tar", ".gz", ".mp4")
BLOCKED_SEEDS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".css", ".js", ".pdf", ".zip")
DOC_HINTS = ("docs", "doc", "documentation", "reference", "api", "guide", "manual", "tutorial", "learn", "find", "search", "index")
SEED_SUFFIXES = ("index.html", "reference/", "api/", "docs/", "documentation/", "guide/", "manual/", "tutorial/", "find/", "search/", "all.html", "modules.html")
LABEL_HINTS = "docs?|documentation|api|reference|guide|tutorial|learn|menu|nav|sidebar|module|namespace"
CODE_TOKENS = ("{", "}", "();", ");", "=>", "==", "!=", "->", "function ", "const ", "let ", "var ", "return ", "import ", "from ", "def ", "class ", "public ", "#include", "<?php")
PAGINATION_HINTS = ("next", "more", "load more", "show more", "expand", "see more", "older", "continue")
DOCUMENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
PREFIX_STOPS = ("home", "index", "overview", "documentation")
MAX_HEADINGS, MAX_NAV_LABELS, MAX_PROBED = 14, 20, 20
SPARSE_CHARS, DUPLICATE_PROSE_CHARS = 120, 40
LINK_PATTERN = r"<a\b[^>]*\bhref=['\"]([^'\"]+)['\"][^>]*>"
