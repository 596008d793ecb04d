import pytest
from pyspark.sql import functions as F

from ballast.sources import markup, readers

TABLES = [
    ("<table><tr><td>1<td>2<tr><td>3</table>", [["1", "2"], ["3"]]),  # cells and rows without end tags
    ('<TABLE class="a>b" title=\'x > y\'><TR data-x="<td>no</td>"><TD>1</TD ><td\n>2</td></TR></TABLE>', [["1", "2"]]),  # quoted > and <
    ("<!-- <table><tr><td>no</td></tr></table> --><table><tr><td>1<!-- </td> -->2</td></tr></table>", [["12"]]),  # comments
    ("<script>var t = '<table><tr><td>no</td></tr></table>';</script><table><tr><td>1</td></tr></table>", [["1"]]),
    ("<table><tr><td>a<table><tr><td>in</td></tr></table>b</td><td>c</td></tr></table><table><tr><td>2</td></tr></table>", [["ab", "c"]]),  # nested, second
    ("<table><tr><th>h</th><td>1</td></tr><tr><td></td><td> <b>x</b> y&nbsp;</td></tr>", [["1"], ["", "x y"]]),  # th, empty, inline tags, no end
    ("<table><tbody><tr><td>&#26399;&#x671F;&lt;&amp;lt;&bogus;&#99999999;&#0;</td></tr></tbody></table>", [["期期<&lt;&bogus;&#99999999;&#0;"]]),
    ("<table>stray<tr>stray<td>1</td>stray</tr>stray</table>after<tr><td>no</td></tr>", [["1"]]),
    ("<tr><td>no table</td></tr>", []), ("text", []), ("", []), (None, None), ("<table>", []), ("<table", []), ("<table><tr><td>a < b</td></tr></table>", [["a < b"]]),
    ("</table></table><table><tr><td>1</td></tr></table>", [["1"]]),
    ("<table><tr><td>unclosed <!-- comment </td></tr></table>", [["unclosed"]]),
    ("<table><tr><td>\x01\x02\x03\x04</td></tr></table>", [[""]]),
]


@pytest.mark.parametrize("k", range(len(TABLES)))
def test_first_table(spark, k):
    html, want = TABLES[k]
    got = spark.createDataFrame([(html,)], "h string").select(markup.first_table(F.col("h"))).first()[0]
    assert (got if got is None else [list(r) for r in got]) == want


BLOCKS = [
    ("<p>a <b>b</b>c<p>d<br>e", ["a bc", "d", "e"]),
    ('<div title="a > <p>b</p>">x</div>', ["x"]),
    ("<style>p{}</style><script type='x'>if (a<b) '</p>'</script >y<SCRIPT>never ends <p>z", ["y"]),
    ("a&amp;b &quot;c&#39; &#x1F600; &copy", ["a&b \"c' 😀 &copy"]),
    ("<pre>a\n\n b</pre><prefix>c</prefix>", ["a b", "c"]),
    ("<!doctype html><?xml x?>a</>b", ["ab"]), ("<h1>1</h1><h7>2</h7>", ["1", "2"]), ("", []), (None, None), ("1 < 2 <3", ["1 < 2 <3"]),
]


@pytest.mark.parametrize("k", range(len(BLOCKS)))
def test_text_blocks(spark, k):
    html, want = BLOCKS[k]
    assert spark.createDataFrame([(html,)], "h string").select(markup.text_blocks(F.col("h"))).first()[0] == want


def test_long_pages(spark):
    rows = "".join(f"<tr><td>{i}期</td><td>01 02 03 04 05 06</td><td>07</td></tr>" for i in range(2000))
    long = "<p title='" + "x" * 300_000 + "'>" + "word " * 200_000 + "<table><tr><th>h</th></tr>" + rows + "</table>"
    got = readers.parse_html(spark.createDataFrame([(1, long)], "page_id long, html string")).collect()
    assert len(got) == 2000 and got[-1].issue == "1999"
    assert spark.createDataFrame([(long,)], "h string").select(F.size(markup.text_blocks(F.col("h")))).first()[0] == 6002
