"""Word lists, hosts and markers that results depend on. Changing one changes results."""

from __future__ import annotations

PROVIDERS = ("qwen", "gemini", "grok", "chatgpt", "claude")

#: Host of a share link to provider.
HOSTS = {
    "claude.ai": "claude",
    "chatgpt.com": "chatgpt",
    "gemini.google.com": "gemini",
    "grok.com": "grok",
    "chat.qwen.ai": "qwen",
}

#: What a URL contains, in the order that it is looked for.
URL_MARKERS = (
    ("qwen", ("chat.qwen.ai",)),
    ("gemini", ("gemini.google.com",)),
    ("grok", ("grok.com",)),
    ("chatgpt", ("chatgpt.com",)),
    ("claude", ("claude.ai",)),
)

#: What the first HTML_PREFIX characters of a page contain, in the order that it is looked for.
HTML_PREFIX = 60_000
HTML_MARKERS = (
    ("qwen", ("chat.qwen.ai", "qwen studio")),
    ("gemini", ("share-viewer", "bardchatui")),
    ("grok", ("cdn.grok.com", "xai grok")),
    ("chatgpt", ("data-message-author-role", "conversation-turn-")),
    ("claude", ("anthropic", "data-test-render")),
)

USER_WORDS = ("user", "human", "question", "prompt", "client", "visitor")
ASSISTANT_WORDS = ("assistant", "bot", "model", "answer", "response", "qwen")

#: A text that is one of these, or starts with one and a space, is interface noise.
NOISE_PREFIXES = (
    "sign in", "log in", "download app", "privacy policy", "terms of service",
    "copy link", "share conversation", "report conversation", "new chat",
)
NOISE_PREFIXES_QWEN = (
    "go to qwen", "official app provided by qwen", "get the app",
    "current system does not support", "qwen is actively working to ensure compatibility",
    "designed for mobile devices",
)

#: A text that contains one of these, in any case, is interface noise of that provider.
NOISE_PARTS = {
    "claude": (
        "this is a copy of a chat", "this is a copy of a claude conversation", "content may include",
        "claude can make mistakes", "accept all cookies", "privacy policy", "terms of service",
        "try claude", "open in claude",
    ),
    "chatgpt": (
        "this is a copy of a shared chatgpt conversation", "report conversation",
        "error loading app failed to fetch template", "failed to fetch template retry",
        "chatgpt can make mistakes", "terms of use", "privacy policy",
    ),
    "gemini": (
        "google privacy policy", "google terms of service", "your privacy & gemini apps",
        "gemini may display inaccurate info", "sign in", "copy prompt", "report",
        "opens in a new window",
    ),
}

#: White space as browsers' scripts see it, as the inside of a character class.
SPACE_CLASS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: The same for RE2, as DuckDB has it.
SPACE_CLASS_SQL = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

TITLE_SUFFIX = r"(?i)[{space}]*\|[{space}]*(Shared )?(ChatGPT|Claude|Gemini|Grok|Qwen).*$"
TITLE_EMPTY = r"(?i)^Check out this chat$"
DEFAULT_TITLE = "AI Conversation"
NO_MESSAGES = "No conversation messages were found in this HTML."
BLOCKED_MARKS = ("Just a moment...", "Cloudflare")

NOISE_NODES = (
    "script, style, noscript, template, button, input, textarea, select, nav, footer, aside, form, iframe, "
    "canvas, audio, video, .sr-only, .cdk-visually-hidden, [aria-hidden=true], .hidden, .action-buttons, "
    ".actions, .luminous-actions-container, .link-action-buttons, .response-container-header, "
    ".response-container-footer, .inline-media-container, .file-preview-container, .query-file-carousel, "
    ".order-first, .sticky"
)
#: The same for turns that are captured one by one, and for the messages of a captured share page.
TURN_NOISE_NODES = (
    "script, style, noscript, template, button, input, textarea, select, nav, footer, aside, form, iframe, "
    "canvas, audio, video, [aria-hidden=true], .sr-only, .hidden, .sticky, .order-first, [class*=actions], "
    "[class*=copy], [class*=popover], [class*=tooltip]"
)
SNAPSHOT_NOISE_NODES = (
    "script, style, noscript, template, button, input, textarea, select, iframe, canvas, audio, video, svg, [role=button], "
    ".message-hoc-container, .user-message-footer, .response-message-footer"
)
TURN_NODES = "section[data-turn], [data-testid^=conversation-turn-]"
MATH_NODES = (
    ".katex-display, .katex, mjx-container, .MathJax_Display, .MathJax, math, [data-latex], [data-tex], "
    "[data-math], .math-display, .math-inline, .display-math, .inline-math"
)
#: Classes of formulas that stand on lines of their own.
BLOCK_MATH_CLASSES = frozenset({"katex-display", "mathjax_display", "math-display", "display-math"})
#: What in a label shows that it is TeX.
TEX_MARK = r"\\(?:frac|sqrt|begin|sum|int|log|sin|cos|tan|left|right|mathbf|mathrm)|[_^{}]"
#: Where a formula's TeX is looked for: nodes inside it, then attributes.
TEX_NODES = ("annotation[encoding='application/x-tex'], annotation[encoding='application/tex']", "script[type^='math/tex']")
TEX_ATTRIBUTES = ("data-latex", "data-tex", "data-math", "data-formula")
MATH_SOURCE_TAGS = frozenset({"annotation", "annotation-xml"})
PICTURE_TAGS = frozenset({"svg", "path", "img", "picture", "source"})
SAFE_LINK = r"https?://|#"
#: Blocks that are left out when nothing stands in them, one kind after the other.
EMPTY_BLOCKS = (r"<div>\s*</div>", r"<p>\s*</p>")
ALLOWED_TAGS = frozenset(
    "p div span strong b em i u s code pre blockquote ul ol li h1 h2 h3 h4 h5 h6 table thead tbody tr th td hr a br".split()
)
MATHML_TAGS = frozenset(
    "math semantics mrow mi mn mo mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts "
    "mprescripts none mtable mtr mtd mtext mspace mstyle mpadded mphantom menclose mfenced maction merror "
    "mlabeledtr maligngroup malignmark ms mstack mlongdiv msgroup msrow mscarries mscarry msline".split()
)
MATHML_ATTRIBUTES = frozenset(
    "xmlns display displaystyle scriptlevel mathvariant mathsize mathcolor mathbackground stretchy symmetric "
    "fence separator form accent accentunder lspace rspace minsize maxsize movablelimits largeop linebreak "
    "rowalign columnalign columnspacing rowspacing columnlines rowlines frame framespacing equalrows "
    "equalcolumns rowspan columnspan width height depth voffset open close separators notation linethickness "
    "bevelled numalign denomalign subscriptshift superscriptshift columnwidth groupalign side minlabelspacing "
    "edge selection actiontype decimalpoint charalign charspacing longdivstyle stackalign position shift".split()
)
#: Keys that a structured message may hold its text in, in order.
TEXT_KEYS = ("text", "content", "message", "answer", "response", "output", "query", "prompt", "value")
#: Keys of an object's role, of its author's, and of its content, in order.
ROLE_KEYS = ("role", "authorRole", "messageRole", "sender")
AUTHOR_KEYS = ("role", "type")
CONTENT_KEYS = ("content", "text", "message", "answer", "response", "output")
#: Messages in scripts that are no JSON: role before content, and content before role.
MINED_ROLE_FIRST = r"""["']role["']\s*:\s*["'](user|human|assistant|bot|model)["'][^{}]{0,1800}?["'](?:content|text|message|answer|response)["']\s*:\s*["']((?:\\.|[^"'\\])*)["']"""
MINED_CONTENT_FIRST = r"""["'](?:content|text|message|answer|response)["']\s*:\s*["']((?:\\.|[^"'\\])*)["'][^{}]{0,1800}?["']role["']\s*:\s*["'](user|human|assistant|bot|model)["']"""
#: Caps on embedded JSON: characters of a script, of a text; depth of a value; matches of a pattern.
MAX_SCRIPT, MAX_TEXT, MAX_DEPTH, MAX_MATCHES = 8_000_000, 250_000, 18, 500
