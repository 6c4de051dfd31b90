import pytest

from leafloom.kernel.flat import parse_html
from leafloom.kernel.markdown import markdown
from leafloom.kernel.serialize import serialize
from leafloom.kernel.text import clean, strings, text


@pytest.mark.parametrize(
    ("html", "options", "want"),
    [
        ("<p> one \t\n two </p>", {}, "one two"), ("<p> one </p>", {"trim": False}, " one "), ("<div>a</div>b<div>c</div>", {}, "a\nb\nc"), ("x<br><br>y", {}, "x\n\ny"), ("<br>x", {}, "x"),
        ("<table><tr><th>a<td>b<tr><td>c</table>", {}, "a b\nc"), ("<pre> a\n  b</pre>c", {"trim": False}, " a\n  b\nc"), ("a&nbsp; b", {}, "a b"), ("a&nbsp;b", {"nbsp": False}, "a\xa0b"),
        ("a<script>x</script><style>y</style><template>z</template><!--w-->b", {}, "ab"), ("<svg><style>x</style><text>y</text></svg>", {}, "y"), ("<title>t</title>b", {}, "t\nb"), ("", {}, ""),
    ],
)
def test_clean(html, options, want):
    assert clean(parse_html(html), 0, **options) == want


def test_text_and_strings():
    t = parse_html("<p>a<b> b </b><!--c--><script>s</script><template>t</template></p>")
    p = t.name.index("p")
    assert text(t, p) == "a b s" and text(t, p, recursive=False) == "a" and strings(t, p) == ["a", "b"] and strings(t, p, False, False) == ["a", " b "]
    assert clean(t, t.type.index("comment")) is None


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>T <em>x</em></h2><p>a<br>b", "## T *x*\n\na\\\nb"),
        ("<p>a <strong> b </strong>c", "a **b** c"),
        ("<p><b><i>x</i></b> y<i>z</i>!", "**x** y*z*!"),
        ("<p>w<i>!</i>x", "w!x"),
        ("<ol><li>a<ul><li>b</ul><li>c</ol>", "1. a\n   - b\n2. c"),
        ("<ul><li>a</ul><ul><li>b</ul>", "- a\n\n* b"),
        ("<blockquote>q<p>r</blockquote>", "> q\n>\n> r"),
        ("<pre><code class=lang-py>x\n```</code></pre>", "````py\nx\n```\n````"),
        ("<a href='/a(b)'>t</a> <img src=i alt='[x]'>", "[t](/a\\(b\\)) ![\\[x\\]](i)"),
        ("<p>1. x</p><p>* y</p><p>a_b _c_</p>", "1\\. x\n\n\\* y\n\na_b \\_c\\_"),
        ("<table><tr><th>h<th>i<tr><td>a|b<td>c</table>", "| h | i |\n| --- | --- |\n| a\\|b | c |"),
        ("<table><tr><td colspan=2>w<tr><td>a<td>b</table>", "w\n\na b"),
        ("<ul><li><hr></ul><hr>", "- ***\n\n---"),
        ("<p>x <code>a ` b</code>", "x ``a ` b``"),
        ("<head><title>t</title></head>", ""),
    ],
)
def test_markdown(html, want):
    assert markdown(parse_html(html), 0) == want


def test_markdown_resolves_links():
    t = parse_html("<base href=/r/><a href=x>y</a>", base_url="https://s.test/a")
    assert markdown(t, 0) == "[y](https://s.test/r/x)"


def test_serialize():
    t = parse_html("<p class='a\"b'>x &lt; y&nbsp;<br></p><script>a<b</script>")
    p = t.name.index("p")
    assert serialize(t, p) == '<p class="a&quot;b">x &lt; y&nbsp;<br></p>' and serialize(t, p, outer=False) == "x &lt; y&nbsp;<br>"
    assert serialize(t, t.name.index("script")) == "<script>a<b</script>"
    pretty = serialize(parse_html("<div><p>a <b>b</b></p><pre> x </pre></div>"), 0, pretty=True)
    assert pretty.split("\n") == ["<html>", "  <head></head>", "  <body>", "    <div>", "      <p>a <b>b</b></p>", "      <pre> x </pre>", "    </div>", "  </body>", "</html>"]
