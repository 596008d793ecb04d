"""HTML as tokens, in column expressions: text blocks and tables of real-world markup.

One pattern reads the markup from left to right, as a tokenizer does: comments, whole script and style elements,
tags whose quoted attributes may hold > or <, and text. What counts as structure is left in
the text between two control signs, everything else of markup goes. A fold over the few structural tokens then keeps
the state that patterns lack: how deep tables nest, and whether a cell is open. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that no HTML text may hold; they are taken out of the input first.
TAG, END, CELL, ROW = "\x01", "\x02", "\x03", "\x04"
_ATTRIBUTES = "(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+"
#: Raw text runs to its end tag, or to the end of the page where there is none; so do comments.
_HIDDEN = "!--(?s:.*?)(?:--!?>|\\z)|(script|style|template|noscript|textarea)\\b" + _ATTRIBUTES + ">(?s:.*?)(?:</\\1\\s*>|\\z)"
_OTHER = "/?[a-z]" + _ATTRIBUTES + ">|[!?/][^>]*+>"
#: Elements that begin and end a block of text.
BLOCKS = "address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|select|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"
#: Entities by name.
ENTITIES = {"&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&euro;": "€"}


def _tokens(html: Column, kept: str) -> Column:
    """The text cut at tags named in ``kept``: an array whose first element is text, and each other one a tag's name, with / if it ends, END and the text after it."""
    clean = F.translate(html, TAG + END + CELL + ROW, "")
    # a kept tag's name is group 2; of what hides text and of other tags nothing stays
    marked = F.regexp_replace(clean, f"(?i)<(?:{_HIDDEN}|(/?(?:{kept})(?=[\\s/>])){_ATTRIBUTES}>|{_OTHER})", f"{TAG}$2{END}")
    return F.split(F.replace(marked, F.lit(TAG + END), F.lit("")), TAG)


def unescaped(text: Column) -> Column:
    """Entities by name or number as characters; unknown ones stay as they are."""
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    number = lambda x: F.coalesce(F.conv(F.nullif(F.regexp_extract(x, "^[xX]([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10).cast("int"), F.regexp_extract(x, "^([0-9]{1,7});", 1).try_cast("int"))
    good = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    one = lambda x: F.get(F.transform(F.array(number(x)), lambda n: F.when(good(n), F.concat(sign(n), F.regexp_replace(x, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), x))), F.lit(0))
    parts = F.split(text, "&#")
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(one(x))), "")
    return F.replace(F.when(F.contains(text, F.lit("&#")), joined).otherwise(text), F.lit("&amp;"), F.lit("&"))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\s\xa0]+", " "))


def text_blocks(html: Column) -> Column:
    """The texts between block elements, in order, entities decoded and white space collapsed; empty ones are left out. Null for null."""
    own = lambda x: _spaced(unescaped(F.substring_index(x, END, -1)))
    return F.filter(F.transform(_tokens(html, BLOCKS), own), lambda x: x != "")


def first_table(html: Column) -> Column:
    """Rows of the first table that is not within another, each an array of the texts of its td cells.

    A cell ends at the next cell, row or end tag; what a nested table holds is no part of it; a table that never ends takes the rest. A th cell has
    no text here. Null for null, no rows without a table.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit(False).alias("open"), F.lit("").alias("out"))

    def step(s: Column, token: Column) -> Column:
        tag = F.lower(F.substring_index(token, END, 1))
        text = F.substring_index(token, END, -1)
        depth = F.greatest(s["depth"] + F.when(tag == "table", 1).when(tag == "/table", -1).otherwise(0), F.lit(0))
        here = (depth == 1) & ~s["done"]
        opens = F.when(here & (tag == "td"), True).when(here & tag.isin("tr", "/tr", "/td", "th", "/th", "table"), (tag == "table") & (s["depth"] > 0) & s["open"]).otherwise(s["open"])
        out = F.concat(s["out"], F.when(here & (tag == "tr"), ROW).when(here & (tag == "td"), CELL).otherwise(""), F.when(here & opens & ~((tag == "table") & (s["depth"] == 0)), text).otherwise(""))
        return F.struct(depth.alias("depth"), (s["done"] | ((tag == "/table") & (s["depth"] == 1))).alias("done"), opens.alias("open"), out.alias("out"))

    flat = F.aggregate(F.slice(_tokens(html, "table|tr|td|th"), 2, 1 << 30), start, step, lambda s: s["out"])
    # what stands before the first row or cell is no row
    rows = F.slice(F.split(flat, ROW), 2, 1 << 30)
    cells = lambda r: F.transform(F.slice(F.split(r, CELL), 2, 1 << 30), lambda c: F.trim(unescaped(c), F.lit(" \t\r\n\x0b\x0c\xa0")))
    return F.when(F.contains(html, F.lit("<")), F.transform(rows, cells)).when(html.isNotNull(), F.array().cast("array<array<string>>"))
