"""Fixed values of the engine: regular expressions in Java's spelling (and RE2's where SQL is compared), word lists,
limits. A class that Java and RE2 spell differently matches the same code points in both."""

# White space as Python's str.split sees it.
WS = r"(?U)[\s\x1c-\x1f]"
WS_RE2 = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
END = r"(?=\n?\z)"

# URL classes, in the order in which they are tried; all are substrings of the lower-cased URL.
VIDEO = ("youtube.com/watch", "youtube.com/playlist", "youtube.com/shorts", "youtu.be/", "youtube.com/c/", "youtube.com/channel/", "youtube.com/@", "youtube.com/live/")
PAPER = ("arxiv.org/abs/", "arxiv.org/pdf/", "arxiv.org/html/")
POST_HOSTS = ("twitter.com/", "x.com/", "nitter.")
PODCAST = ("podcasts.apple.com/", "open.spotify.com/episode/", "open.spotify.com/show/", "feeds.megaphone.fm/", "anchor.fm/", "podcasters.spotify.com/")
FEED_STRONG = ("/rss", ".rss", "?format=rss", "&format=rss")
FEED_WEAK = (".xml", "/feed")
FEED_WORDS = ("podcast", "episode", "feeds.", "anchor.fm", "megaphone", "show", "series", "itunes")
LOCAL_SUFFIXES = (".md", ".txt", ".docx", ".doc", ".html", ".htm", ".mhtml", ".mht", ".pptx", ".ppt", ".xlsx", ".xls", ".csv", ".json", ".xml", ".epub", ".msg", ".zip")
TYPE_ORDER = ("youtube", "podcast", "pdf", "local_file", "twitter", "article")

CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"
SENTENCE_END = r"[.!?。！？](?U)[\s\x1c-\x1f]*\z"
SENTENCE_END_RE2 = rf"[.!?。！？]{WS_RE2}*\z"
CUE_STAMP = r"([0-9]+:[0-9]{2}:[0-9]{2}[.,][0-9]{3})\s*-->\s*([0-9]+:[0-9]{2}:[0-9]{2}[.,][0-9]{3})"
WORD_STAMP, TAG = r"<[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}>", "<[^>]+>"
MD_HEADING = r"^(#{1,6})\s+([^\n]+)\z"
CAPS_HEADING, COLON_HEADING = r"^[A-Z][A-Z0-9 :,.\-]{2,}\z", r"^([^\n]{3,60}):(?U)\s*\z"
REFERENCES = r"(?i)^(?:references|bibliography|works\s+cited|cited\s+works)\z"
MATH = r"[\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{27C0}-\x{27EF}\x{2190}-\x{21FF}]|\\(?:frac|sum|int|prod|lim|infty|partial|nabla|sqrt)\b|\([0-9]+\)\s*\z"
IMAGE_REF, HYPHEN_BREAK = r"!\[[^\n]*?\]\([^\n]*?\)", r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])"
PAPER_ID = r"arxiv\.org/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
MARKER = r"<!--IMG:[0-9a-f\-]+-->"
URL = r"https?://[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Splitting of long texts: sentence ends first, then clause ends, then a space, looked for in so many characters.
CHUNK_TIERS, CHUNK_LOOK_BACK = ("。！？.!?", "，、；：,;:", " "), 500
IMAGE_FORMATS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
BASENAMES = ("transcript", "article", "paper", "document", "presentation", "tweet", "podcast")
SKIPPED_FOLDERS = ("archive", "book_notes", "batch-process")
