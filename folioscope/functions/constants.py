"""Fixed values that extraction, highlighting and layout share.  All lists are data, in one place."""

# Elements whose subtree is never part of an article.
SKIP_TAGS = "script style noscript template nav aside footer header form button select textarea label input svg iframe menu dialog audio video canvas object embed map area".split()
SKIP_ROLES = "navigation banner search complementary contentinfo form".split()
# Words in class or id that mark page furniture.
BOILERPLATE_MARKERS = (
    "related rel-post sharedaddy addthis addtoany social-share share-links share-buttons sidebar widget comment breadcrumb pagination pager newsletter "
    "subscribe advert sponsor cookie banner popup modal disqus recommend post-navigation nav-links screen-reader skip-link visually-hidden sr-only "
    "table-of-contents author-box previous-post next-post"
).split()
TAXONOMY_PREFIXES = "tag category cat".split()
# Article containers of well-known platforms, then two fallbacks.
PLATFORM_SELECTORS = (
    "article main [role=main] #content #main-content #main .post-content .entry-content .entry-inner .entry-body .entry .post-inner .article-content "
    ".article-body .article__body .post-body .post__content .post-content-inner .single-content .gh-content .blog-post-content .story-body "
    ".c-entry-content .articleBody .td-post-content .e-content .available-content .body.markup .markup .markdown-body .md-content .theme-doc-markdown "
    ".docs-content .doc-content .documentation .rst-content .wy-nav-content .vp-doc .content .prose"
).split()
STRUCTURE_SELECTORS = "article main section div".split()
INLINE_TAGS = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
LINE_BREAKING_TAGS = "p div tr table ul ol blockquote section article h1 h2 h3 h4 h5 h6".split()
MIN_TEXT_LENGTH, PARAGRAPH_BONUS = 200, 50
MAX_CONTENT_TABLE_ROWS, NESTED_TABLE_ROWS = 30, 8
UNTITLED = "Başlıksız belge"
TITLE_SEPARATORS = (" | ", " :: ", " » ", " — ", " – ")
MIN_TITLE_HEAD = 15

# Where an image may have its source.
SOURCE_ATTRIBUTES = "src data-src data-lazy-src data-original data-original-src data-url data-hi-res-src data-full-src".split()
SRCSET_ATTRIBUTES = "srcset data-srcset data-lazy-srcset data-original-set".split()
SPACER_FILES = "blank.gif spacer.gif pixel.gif 1x1.gif blank.png placeholder.png placeholder.svg".split()
MAX_SRCSET_WIDTH = 2400
MIN_IMAGE_PIXELS = 24

# How code blocks mark highlighted lines and name their language.
HIGHLIGHT_TOKENS = "highlighted highlight hl hll highlight-line highlighted-line is-highlighted line-highlighted mark marked".split()
HIGHLIGHT_SUFFIXES = "-highlighted-line -highlighted -highlight-line -highlighted-lines".split()
HIGHLIGHT_ATTRIBUTES = "data-highlighted-line data-line-highlight data-highlight-line data-highlight".split()
NON_LANGUAGE_TOKENS = "hljs highlight code pre prettyprint linenums source syntax chroma codehilite plaintext text nohighlight brush lang language".split()
LANGUAGE_PREFIXES = "language- lang- highlight-source- highlight- brush- prism- syntax-".split()
KNOWN_LANGUAGES = "rust python javascript typescript go c cpp java csharp kotlin swift scala bash sql ruby php json yaml toml ini css markdown html".split()
LANGUAGE_ALIASES = {
    alias: name
    for name, aliases in {
        "rust": "rs",
        "python": "py python3 py3 sage",
        "javascript": "js jsx node mjs cjs",
        "typescript": "ts tsx",
        "go": "golang",
        "cpp": "c++ cxx cc hpp hxx",
        "c": "h",
        "csharp": "cs c#",
        "bash": "sh shell zsh console shell-session terminal ksh",
        "sql": "mysql postgres postgresql sqlite plsql tsql",
        "ruby": "rb",
        "yaml": "yml",
        "json": "jsonc json5",
        "kotlin": "kt kts",
        "css": "scss sass less styl",
        "html": "xml xhtml svg rss vue html5",
        "markdown": "md mdx",
    }.items()
    for alias in aliases.split()
}

# Keywords of each rule set.
KEYWORDS = {
    "rust": "as async await bool break char const continue crate dyn else enum extern f32 f64 false fn for i128 i16 i32 i64 i8 if impl in isize let loop match mod move mut pub ref return self Self static str struct super trait true type u128 u16 u32 u64 u8 unsafe use usize where while yield",
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return self try while with yield True False None",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends finally for from function get if implements import in instanceof interface let new null of private protected public readonly return set static super switch this throw try type typeof undefined var void while yield true false",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false",
    "c": "abstract as assert auto bool break case catch char class const continue data default defer delete do double else enum extends extern false final finally float fn for fun func guard if implements import in inline instanceof int interface internal is lambda let long map namespace new nil null nullptr object operator override package private protected protocol public readonly register repeat return sealed short signed sizeof static struct super switch template this throw throws trait true try typealias typedef typename union unsafe unsigned val var virtual void volatile when where while with yield",
    "bash": "alias break case cd continue do done echo elif else esac exec exit export fi for function if in local readonly return select set shift source then trap typeset unset until while",
    "sql": "add all alter and any as asc avg begin between by case cast check column commit constraint count create cross current database default delete desc distinct drop else end except exists false foreign from full group having if in index inner insert into is join key left like limit max min not null offset on or order outer primary references right rollback select set sum table then true union unique update values view when where with",
    "ruby": "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo require rescue retry return self super then true undef unless until when while yield",
    "php": "abstract and array as break case catch class clone const continue declare default do echo else elseif enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global if implements include instanceof interface isset list match namespace new or print private protected public readonly require return static switch throw trait try unset use var while xor yield true false null",
    "json": "true false null none True False None yes no",
    "generic": "and as async await break case class const continue def default do else elseif end enum except export extends false finally fn for from func function if impl import in interface let match new nil none not null of or package pass private protected pub public raise return self static struct switch then this throw trait true try type use var void when where while with yield",
}
# Fixed values: (keywords, line comments, block comment, quotes, flags) of each language.
RULES = {
    "rust": ("rust", ("//",), ("/*", "*/"), '"', "capital"),
    "python": ("python", ("#",), None, "\"'", "triple"),
    "javascript typescript": ("javascript", ("//",), ("/*", "*/"), "\"'`", "capital"),
    "go": ("go", ("//",), ("/*", "*/"), '"`', ""),
    "c cpp java csharp kotlin swift scala": ("c", ("//",), ("/*", "*/"), "\"'", "capital"),
    "bash": ("bash", ("#",), None, "\"'", ""),
    "sql": ("sql", ("--",), ("/*", "*/"), "'\"", "nocase"),
    "ruby": ("ruby", ("#",), None, "\"'", "capital"),
    "php": ("php", ("//", "#"), ("/*", "*/"), "\"'", "capital"),
    "json": ("json", (), None, '"', ""),
    "yaml toml ini": ("json", ("#", ";"), None, "\"'", ""),
    "css": (None, (), ("/*", "*/"), "\"'", ""),
    "markdown": (None, (), None, '"', ""),
    "html": (None, (), ("<!--", "-->"), "\"'", "markup"),
    "generic": ("generic", ("//", "#"), ("/*", "*/"), "\"'`", "capital"),
}

# Page sizes (mm), themes (text, muted, background) and code palettes.
PAGE_SIZES = {"a4": (210.0, 297.0), "a5": (148.0, 210.0), "letter": (216.0, 279.0), "tablet": (162.0, 216.0)}
BASE_MARGINS = (10.0, 18.0, 16.0, 18.0)  # top, right, bottom, left of an a4 page
IMAGE_HEIGHT_SHARE = 0.74
THEMES = {"light": ("1F242B", "6B7280", None), "dark": ("E4E7EB", "9AA4B2", "16191D"), "sepia": ("4A3B2A", "8A7355", "F6EEDC")}
PALETTE_ROLES = "background border gutter accent highlight plain keyword string comment number function type".split()
PALETTES = {
    "github-light": "F6F8FA D0D7DE 7D8590 8250DF FFF3CC 24292F CF222E 0A3069 6E7781 0550AE 662AC0 953800",
    "github-dark": "0D1117 30363D 6E7681 8957E5 2E2A1A C9D1D9 FF7B72 A5D6FF 8B949E 79C0FF D2A8FF FFA657",
    "dark-on-page": "1E2228 30363D 7D8590 8957E5 35301E CFD6DE FF7B72 A5D6FF 8B949E 79C0FF D2A8FF FFA657",
    "monokai": "272822 3E3D32 75715E F92672 3E3D32 F8F8F2 F92672 E6DB74 75715E AE81FF A6E22E 66D9EF",
    "solarized-light": "FDF6E3 EEE8D5 839496 268BD2 EEE8D5 586E75 859900 2AA198 93A1A1 D33682 268BD2 B58900",
    "solarized-dark": "002B36 073642 586E75 268BD2 073642 93A1A1 859900 2AA198 586E75 D33682 268BD2 B58900",
    "sepia": "EFE5CE D6C59F A08C6A A06A2A EAD9AC 3E3226 9A2F12 1E5B40 8A7355 2C4E7A 6B3A7C 8A4B12",
}
AUTO_CODE_THEME = {"light": "github-light", "dark": "dark-on-page", "sepia": "sepia"}
CODE_THEME_ALIASES = {"github": "github-light", "solarized": "solarized-light"}

# Font sizes (pt) of headings by level and of other kinds of blocks, and the
# characters that page furniture uses.
CODE_PADDING_MM = 2.0
HEADING_SIZES = (17.0, 15.0, 13.0, 12.0)
FONT_SIZES = {"code": 9.0, "table": 9.0, "caption": 8.0}
INTERFACE_TEXT = "Sayfa 0123456789 · kod devamı │ » • [görsel ağ: ] / . -"

# Resource types of requests and what filter rules call them.
REQUEST_TYPES = {
    alias: name
    for name, aliases in {
        "script": "script",
        "image": "image img",
        "stylesheet": "stylesheet css",
        "object": "object object-subrequest",
        "xmlhttprequest": "xmlhttprequest xhr fetch",
        "subdocument": "subdocument frame iframe sub_frame",
        "document": "document doc main_frame",
        "ping": "ping beacon",
        "websocket": "websocket",
        "media": "media",
        "font": "font",
        "other": "other",
    }.items()
    for alias in aliases.split()
}
# Other options of rules that decide about requests.
FILTER_OPTIONS = "third-party 3p first-party 1p domain from match-case important badfilter redirect all".split()
# Common public suffixes of two labels.
SECOND_LEVEL = tuple(
    f"{second}.{top}"
    for top, seconds in {
        "uk": "co org ac gov ltd plc net sch nhs police me",
        "tr": "com org net gov edu bel k12 av gen web info biz tv",
        "au": "com net org edu gov id asn",
        "jp": "co ne or ac go ad ed gr lg",
        "br": "com net org gov edu art blog eco",
        "nz": "co net org govt ac school geek",
        "za": "co net org gov ac web",
        "in": "co net org gov ac firm gen ind nic res",
        "kr": "co ne or go ac re pe",
        "cn": "com net org gov edu ac",
        "tw": "com net org gov edu idv",
        "hk": "com net org gov edu idv",
        "mx": "com net org gob edu",
        "ar": "com net org gob edu",
        "il": "co net org gov ac muni",
        "sg": "com net org gov edu per",
        "id": "co net or go ac web",
        "pl": "com net org edu gov waw",
        "ua": "com net org edu gov in",
    }.items()
    for second in seconds.split()
)

# Advance widths of the characters from space to tilde in thousandths of the font size, for a sans font and its bold; of all characters of a mono font.
SANS_WIDTHS = (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 "
    "1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 "
    "333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
)
BOLD_WIDTHS = (
    "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 "
    "975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 "
    "333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
)
MONO_WIDTH, OTHER_WIDTH = 600, 556
# Height of a line in font sizes, space between lines; gaps around blocks in lines of body text (before, after).
SANS_LINE, MONO_LINE, LINE_SPACING = 1.149, 1.133, 1.3
GAPS = {"title": (0.0, 0.8), "heading": (0.4, 0.2), "paragraph": (0.0, 0.35), "caption": (0.0, 0.35), "quote": (0.0, 0.35), "code": (0.0, 0.5), "table": (0.2, 0.6), "image": (0.0, 0.4), "note": (0.0, 0.2), "divider": (0.0, 0.5), "list_item": (0.0, 0.5)}
TITLE_SIZE, BODY_SIZE, DIVIDER_SIZE, HEADER_SIZE, BADGE_SIZE = 20.0, 12.0, 8.0, 8.0, 7.0
# Fixed values (mm): around quotes and cells (upright, sideways), and of one level of a list.
QUOTE_PADDING, CELL_PADDING, LIST_INDENT = (4.0, 18.0), (1.0, 2.0), 10.0
