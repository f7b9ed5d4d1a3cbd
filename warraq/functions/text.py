"""Text functions over columns, and the patterns of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of Arabic orthographies, marks and the elongation stroke.
LETTERS = "\u0621-\u063a\u0641-\u064a\u0671\u066e-\u06d3\u06fa-\u06fc\u06ff"
MARKS = "\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e8\u06ea-\u06ed"
STROKE = "\u0640"
WORD = LETTERS + MARKS + STROKE
#: Token kinds and patterns, first match wins.
KINDS = {
    "code": r"```(?s:.*?)```|`[^`\n]+`",
    "url": r"(?:https?://|ftp://|www\.)[^\s<>\[\]{}\"'`]+",
    "email": r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "hashtag": f"#[{LETTERS}A-Za-z0-9_]+",
    "mention": f"@[{LETTERS}A-Za-z0-9_]+",
    "arabic": f"[{LETTERS}](?:[{WORD}]*[{LETTERS}{MARKS}])?",
    "number": r"[+\-]?[0-9٠-٩]+(?:[.,٫٬][0-9٠-٩]+)*[%٪]?",
    "latin": r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’\-][A-Za-zÀ-ÖØ-öø-ÿ]+)*",
    "whitespace": r"\s+",
    "punctuation": r"[،؛؟.!?,;:…]+",
    "symbol": r"\S",
}
RUN = f"[{WORD}]+|[^{WORD}]+"
LETTER_RUN = f"[{LETTERS}]+|[^{LETTERS}]+"


def pieces(docs: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """``doc_id, idx, piece, start, stop`` of the consecutive matches that make up each text."""
    import re

    from warraq.functions.scan import rows_of

    found = re.compile(pattern)
    return rows_of(docs, lambda text: ((i, m[0], m.start(), m.end()) for i, m in enumerate(found.finditer(text))), "idx int, piece string, start long, stop long", *keep)


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """Lossless tokens with kinds: ``doc_id, idx, piece, start, stop, kind``. Marks that close an address are tokens of their own."""
    from warraq.functions import scan

    return scan.rows_of(docs, lambda text: ((i, *t) for i, t in enumerate(scan.tokens_of(text))), "idx int, piece string, start long, stop long, kind string", *keep)


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{MARKS}{STROKE}]", "")


#: Compositions of an Arabic base letter and a following mark.
COMPOSED = (
    ("\u0627\u0653", "\u0622"), ("\u0627\u0654", "\u0623"), ("\u0627\u0655", "\u0625"), ("\u0648\u0654", "\u0624"), ("\u064a\u0654", "\u0626"),
    ("\u06d5\u0654", "\u06c0"), ("\u06c1\u0654", "\u06c2"), ("\u06d2\u0654", "\u06d3"),
)
FOLD_FROM, FOLD_TO = "أإآٱىؤئة", "اااايويه"


def normalize(text: Column, mode: str) -> Column:
    """strict: compose; lookup: also drop marks and strokes; search: also fold letters; aggressive: also drop signs and squeeze blanks."""
    for pair, one in COMPOSED:
        text = F.replace(text, F.lit(pair), F.lit(one))
    if mode == "strict":
        return text
    text = strip_marks(text)
    if mode == "lookup":
        return text
    text = F.translate(text, FOLD_FROM, FOLD_TO)
    if mode == "search":
        return text
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def respace(text: Column) -> Column:
    """One blank between words, none before punctuation, one after Arabic commas and colons."""
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, " ([،؛:,.!?؟])", "$1")
    return F.trim(F.regexp_replace(text, "([،؛:]) *", "$1 "))


def html_text(html: Column) -> Column:
    """Headings, items, emphasis and code as Markdown, block ends as blank lines, other tags gone."""
    for pattern, to in HTML_STEPS:
        html = F.regexp_replace(html, pattern, to)
    return F.trim(html)


#: The steps of html_text, in order; ``$1`` is the first group.
HTML_STEPS = (
    *((rf"(?is)<h{k}[^>]*>(.*?)</h{k}>", "#" * k + " $1\n\n") for k in (1, 2, 3)),
    (r"(?is)<li[^>]*>(.*?)</li>", "- $1\n"),
    (r"(?is)<(?:strong|b)[^>]*>(.*?)</(?:strong|b)>", "**$1**"),
    (r"(?is)<(?:em|i)[^>]*>(.*?)</(?:em|i)>", "*$1*"),
    (r"(?is)<code[^>]*>(.*?)</code>", "`$1`"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(?:p|div|ul|ol)>", "\n\n"),
    (r"<[^>]+>", ""),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    (r"\n{3,}", "\n\n"),
)
