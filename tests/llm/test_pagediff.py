import random

import pytest
from pyspark.sql import functions as F

from echoledger.llm import pagediff

COLUMNS = "page_id bigint, url string, html string"


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("table_bits", [1 << 24, 20])
def test_common_lines_are_a_longest_common_subsequence(table_bits):
    rng = random.Random(1)
    for _ in range(800):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(25))] for _ in range(2))
        got = pagediff.common_lines(a, b, table_bits)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == longest(a, b)
        assert all(any(a[i] == y for y in rest) for i in got)


@pytest.mark.parametrize("html, want", [
    ("", ""), ("plain", "plain"), ("a < b &amp; c <p>d", "a < b & c\nd"), ("<p>a<br>b</p>", "a b"), ("<p>a\n\t b&nbsp;c<p>d", "a b c\nd"),
    ("<article><h1>T</h1><p><b>x<p>y</article><footer>f</footer>", "T\nx\ny"),
    ("<div class='site with-sidebar'><nav>n</nav><main>m<aside>s</aside>t</main>u</div>", "m\nt"),
    ("<article>a<div class='ad'>b<div>c</div></div>d<section id=comments><article>e</article></section>f</article>", "a\nd\nf"),
    ("<body class=has-menu><p class=cookie-notice>we use<p>text<script>if(a<b)'</p>'</script> on<style>x</style></body>", "text on"),
    ("<p>one <span class=ad>buy</span>two<!-- <p>no --><form>q<input name=x>r</form>", "one two"),
    ("<p title='a>b'>c</p><p title=\"d>\">e", "c\ne"), ("<p>a<script>never ends", "a"), ("a<!-- never ends", "a"), ("<p>a</b></div></article>b", "a\nb"),
    ("<div><article>in</div>out", "in"), ("&#38;&#x26;&lt;p&gt;&am", "&&<p>&am"), ("<ul><li class=ad>x<li>y</ul>", "y"), ("<TITLE>t</TITLE><P>B", "B"),
    ("<div role=navigation>x</div><div role=main>y</div>", "y"), ("<p>a</p>" * 3, "a\na\na"), ("1 <2> 3 </ 4> 5 <", "1 <2> 3  5 <".replace("  ", " ")),
])
def test_page_lines(html, want):
    lines, places = pagediff.page_lines(html)
    if pagediff.INSIDE in places:
        lines = [t for t, p in zip(lines, places) if p == pagediff.INSIDE]
    assert "\n".join(lines) == want


def brute(rows):
    """Texts by sorting and comparing every page of a host in one list."""
    parsed = [(*pagediff.place_of(url), pagediff.page_lines(html or "")) for _, url, html in rows]
    out = []
    for (page_id, url, _), (host, path, (lines, places)) in zip(rows, parsed):
        if pagediff.INSIDE in places:
            out.append((page_id, url, "\n".join(t for t, p in zip(lines, places) if p == pagediff.INSIDE)))
            continue
        by_lines = {}
        for h, p, (own, _) in parsed:
            if h == host:
                by_lines[tuple(own)] = min(p, by_lines.get(tuple(own), p))
        key = lambda t: (by_lines[t], pagediff.hashlib.blake2b(
            b"".join(pagediff.hashlib.blake2b(x.encode(), digest_size=8).digest() for x in t), digest_size=16).digest())
        order = sorted(by_lines, key=key)
        k = order.index(tuple(lines))
        own, near = by_lines[order[k]], []
        for side, j in ((0, k - 1), (-1, k + 1)):
            if 0 <= j < len(order):
                near.append((pagediff.nearness(own, by_lines[order[j]]), side, order[j]))
        gone = set(pagediff.common_lines(lines, list(max(near)[2]))) if near else set()
        out.append((page_id, url, "\n".join(t for i, t in enumerate(lines) if i not in gone)))
    return sorted(out, key=repr)


def test_nearest_pages_lose_shared_lines(spark):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        host = rng.choice(("a.example", "a.example", "B.example:80", "c.example"))
        section = rng.choice(("news", "news/2024", "shop", ""))
        chrome = [f"Menu of {section}", "All rights reserved"]
        body = [f"line {rng.randrange(400)}" for _ in range(rng.randrange(6))]
        parts = [f"<div>{t}</div>" for t in (chrome[:1] + body + chrome[1:])]
        if k % 9 == 0:
            parts.append("<article><p>All rights reserved</p></article>")
        rows.append((k, f"http://{host}/{section}/{rng.randrange(60)}?q={k}", "".join(parts)))
    rows += [rows[5]] * 3 + [(900, rows[6][1], rows[6][2]), (901, None, "<p>x"), (902, "no url", "<p>x<p>y"), (None, None, None), (None, "http://a.example/", ""), (903, "http://[::1", "<p>z")]
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    for name in ("host", "path", "signature", "lines", "places", "hashes", "shared", "kind", "part", "text", "near"):
        df = df.withColumn(name, F.lit("mine"))
    got = sorted((tuple(r)[:3] for r in pagediff.main_texts(df).collect()), key=repr)
    assert got == brute(rows)
    assert not any("Menu of news/2024" in r[2] for r in got if r[0] in range(0, 0))
    one = spark.createDataFrame(rows[:1], COLUMNS)
    assert [r.text for r in pagediff.main_texts(one).collect()] == [brute(rows[:1])[0][2]]


def test_empty_and_long(spark):
    assert pagediff.main_texts(spark.createDataFrame([], COLUMNS)).count() == 0
    long = [(k, f"http://a.example/{k}", "<p>start" + "".join(f"<p>{i % 700} {i * k % 11}" for i in range(20000)) + "<a x='" * 3000) for k in (1, 2)]
    made = pagediff.extract(spark.createDataFrame(long, COLUMNS)).collect()
    assert all(r.n_lines >= 20001 and r.n_deleted == r.n_shared > 0 for r in made)
