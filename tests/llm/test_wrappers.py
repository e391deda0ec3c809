import json
import re

import pytest
from hypothesis import given, settings, strategies as st

from gaugemill.llm import wrappers as w

SCHEMA = "page_id long, url string, html string, text string"


def tree(page):
    return w.compact(w.parse(page))


def regex(node):
    """A wrapper as it is written: names, # for a slot, ? and +."""
    inner = "#" if node[0] == "T" else "(" + " ".join(map(regex, node[2])) + ")" if node[0] == "G" else f"{node[2]}[{' '.join(map(regex, node[3]))}]"
    return inner + {0: "", 1: "?", 2: "+", 3: "+?"}[node[1]]


def joined(*pages):
    out = tree(pages[0])
    for p in pages[1:]:
        out = w.merge(out, tree(p), True)
    return regex(out)


def test_repeats_optionals_and_slots():
    assert joined("<ul><li>a<li>b</ul><p>x") == "[ul[li[#]+] p[#]]"
    assert joined("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p></div>") == "[div[(h2[#] p[#]+)+]]"
    assert joined("<h1>a</h1><p>b</p>", "<h1>c</h1><div class=x>q</div><p>d</p><p>e</p>") == "[h1[#] div.x[#]? p[#]+]"
    assert joined("<p>b</p>", "<p>a</p><h2>c</h2>", "<p>a</p><table><tr><td>1<td>2<tr><td>3</table>") == "[p[#] h2[#]? table[tr[td[#]+]+]?]"
    assert joined("<div><p>a</p></div>", "<div></div>") == "[div[p[#]?]]"


def test_a_page_and_its_wrapper_agree_in_any_order():
    pages = ["<h1>a</h1><p>b</p>", "<p>b</p><h2>c</h2><p>d</p>", "<h1>x</h1><ul><li>1<li>2</ul><p>y</p>"]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        out = tree(pages[order[0]])
        for i in order[1:]:
            out = w.merge(out, tree(pages[i]), True)
        for page in pages:
            assert None not in w._matched(w.parse(page)[3], out[3])


ARTICLE = "<h1>Title {n} &amp; more</h1><p>First <b>bold</b>{n} text,\n  with <a href=x>a link</a>.<p>Second&nbsp;paragraph {n} goes on for a while<br>here.</p><ul><li>point {n}</li><li>other &lt;{n}&gt;</li></ul>"
WANTED = "Title {n} & more First bold{n} text, with a link. Second paragraph {n} goes on for a while here. point {n} other <{n}>"
AROUND = (
    "<!DOCTYPE html><html><head><title>T {n}</title><style>p{{x:y}}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li><li><a href=/{n}>n{n}</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies, {n}.</div><script>var t='</p><p>no {n}';</script><!-- <p>not {n}</p> -->"
)
AFTER = "<aside>See also {n}</aside><div id=sidebar-2><p>side {n}</p></div><form><label>Name</label><input name=a><button>Send {n}</button></form><div class='ad top'>Buy {n}</div><footer><p>&copy; {n}</p></footer></body></html>"
COMMENTS = "<section id=comments><h3>Comments</h3><div class=comment><p>I disagree {n}</p></div><div class=comment><p>Me too {n}</p></div></section>"
TEMPLATES = {
    "article": AROUND + "<article>" + ARTICLE + "<p class='promo'>Subscribe {n}</p>" + COMMENTS + "</article>" + AFTER,
    "main": AROUND + "<main role=main><div class=post-content>" + ARTICLE + "</div>" + COMMENTS + "</main>" + AFTER,
    "plain": AROUND + "<div id=content><div class=article-body>" + ARTICLE + "</div></div>" + COMMENTS + AFTER,
    "links": AROUND + "<div><p><a href=1>one {n}</a> <a href=2>two {n}</a></p></div><div class=story>" + ARTICLE + "</div>" + AFTER,
    "header": AROUND + "<article><header><p>By someone {n}</p><h1>Title {n} &amp; more</h1></header>" + ARTICLE.split("</h1>")[1] + "</article>" + AFTER,
    "fixed": AROUND + "<div>" + ARTICLE + "</div><div class=x>All rights in this place are ours.</div>" + AFTER,
}


@pytest.mark.parametrize("fold", [500, 2])
def test_templates(spark, monkeypatch, fold):
    monkeypatch.setattr(w, "FOLD", fold)
    rows = []
    for i, name in enumerate(TEMPLATES):
        for k in range(6):
            n = 1000 * i + k
            page = TEMPLATES[name].replace("</ul><aside", "</ul><h2>more</h2><p>last</p><aside") if k == 5 else TEMPLATES[name]
            rows.append((n, f"HTTPS://{name}.Example.com:80/{n}?q", page.format(n=n), "clash"))
    got = {r.page_id: r for r in w.main_text(spark.createDataFrame(rows, SCHEMA).repartition(4), ["page_id", "url", "text"]).collect()}
    assert len(got) == len(rows)
    for n, url, _, _ in rows:
        assert (got[n].url, got[n].n_chars) == (url, len(got[n].text))
        assert got[n].text == WANTED.format(n=n), url


def test_a_host_with_two_templates_and_a_page_without_the_region(spark):
    rows = [(n, "http://h.example/", (TEMPLATES["article"] if n % 3 else "<body><p>only {n} words</p><nav>m</nav></body>").format(n=n), "") for n in range(12)]
    got = {r.page_id: r.text for r in w.main_text(spark.createDataFrame(rows, SCHEMA), ["page_id"]).collect()}
    assert got == {n: WANTED.format(n=n) if n % 3 else f"only {n} words" for n in range(12)}


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(7, "http://h.example/", TEMPLATES["article"].format(n=1), "")] * 5
    got = w.main_text(spark.createDataFrame(rows, SCHEMA), ["page_id"]).collect()
    assert len(got) == 5 and all(r.text == WANTED.format(n=1) for r in got)


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(w, "BROADCAST_BYTES", -1)
    deep = "<div>" * 5000 + "bottom" + "</div>" * 5000
    long = "<article>" + "<p>word &amp; word" * 100_000 + "</article>"
    names = "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26)}>t{i}</div>" for i in range(500))
    odd = [None, "", "   ", "no tags at all", "<p>cut <b", "<script>never ends <p>x", "<!-- open <p>x", "</p></div>stray", deep, long, "<a " * 20_000, "a < b & c &amp d &am; 1 > 0", "<p title=\"a>b\">in</p>", names, "<p>😀 é z</p>"]
    want = ["", "", "", "no tags at all", "cut <b", "", "", "stray", "bottom", " ".join(["word & word"] * 100_000), ("<a " * 20_000).strip(), "a < b & c & d &am; 1 > 0", "in", " ".join(f"t{i}" for i in range(500)), "😀 é z"]
    odd[-1] = "<p>😀 é z</p>"
    rows = [(i, None if i % 2 else f"http://h{i}.example", page, "") for i, page in enumerate(odd)]
    got = {r.page_id: r.text for r in w.main_text(spark.createDataFrame(rows, SCHEMA), ["page_id"]).collect()}
    for i, text in enumerate(want):
        assert got[i] == text, i
    assert w.main_text(spark.createDataFrame([], SCHEMA), ["page_id"]).count() == 0


def test_wrappers_stay_bounded():
    out = tree("<p>a</p>")
    for i in range(300):
        out = w.merge(out, tree(f"<div class=x{chr(97 + i % 26)}{chr(97 + i // 26)}>t</div><p>b</p>"), True)
    assert len(json.dumps(w.split(out, []))) < 20_000


PIECES = st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<br>", "<ul>", "<li>", "</ul>", "x", " y ", "&amp;", "<article>", "</article>", "<td>", "<tr>", "<table>", "</table>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=25), min_size=1, max_size=5))
def test_every_page_fits_its_hosts_wrapper_and_no_text_is_lost(pages):
    pages = ["".join(p) for p in pages]
    out = tree(pages[0])
    for p in pages[1:]:
        out = w.merge(out, tree(p), True)

    def walk(nodes, children):
        for n, there in zip(nodes, w._matched(nodes, children), strict=True):
            assert there is not None and w.key(n) == w.key(there)
            if n[0] == "E":
                walk(n[3], there[3])

    for p in pages:
        walk(w.parse(p)[3], out[3])
        said = re.sub(r"\s", "", "".join(x[7] for x in texts(w.parse(p))))
        assert said == re.sub(r"\s", "", re.sub(r"<[^>]*>", "", p)).replace("&amp;", "&")


def texts(node):
    return [node] if node[0] == "T" else [t for c in node[3] for t in texts(c)]
