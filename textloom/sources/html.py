"""Plain text of whole HTML pages by a chain of replacements, which any SQL engine can run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|section|table|td|th|tr|ul"
#: Pattern and replacement, in order; blocks are parted by a blank line and a list item begins with a bullet.
STEPS = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<script[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style[^>]*>.*?</style\s*>", ""),
    (r"(?is)<head[^>]*>.*?</head\s*>", ""),
    (r"\s+", " "),
    (r"(?i)<li[^>]*>", "\n\n• "),
    (r"(?i)</li\s*>", "\n\n"),
    (rf"(?i)</?(?:{_BLOCKS})(?:\s[^>]*)?/?>", "\n\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&copy;", "©"),
    (r"&middot;", "·"),
    (r"&amp;", "&"),
    (r" *\n[ \n]*", "\n\n"),
    (r"^[ \n]+|[ \n]+$", ""),
    (r"\n• *", "\n  • "),
)


def plain_text(html: Column) -> Column:
    """Text of a page: blocks parted by a blank line, list items bulleted, link texts kept."""
    out = F.coalesce(html, F.lit(""))
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement.replace("\\1", "$1"))
    return out


def plain_text_sql(html: str) -> str:
    """The same chain in DuckDB."""
    out = f"coalesce({html}, '')"
    for pattern, replacement in STEPS:
        flags = "g"
        for flag in ("(?is)", "(?i)", "(?m)"):
            if pattern.startswith(flag):
                pattern, flags = pattern[len(flag) :], "g" + flag[2:-1]
                break
        text = replacement.replace("'", "''").replace("\n", "' || chr(10) || '")
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{text}', '{flags}')"
    return out
