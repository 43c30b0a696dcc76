import random
from itertools import combinations

import pytest

from quillspark.llm import wrapper as w


def page(i, article=True):
    r = random.Random(i)
    para = lambda: " ".join(r.choice(("alpha", "beta", "gamma", "delta", "eps")) + str(r.randint(0, 99)) for _ in range(30))
    body = [f"Title {i} &amp; more", para(), para() + " &lt;b&gt; &eacute;", para()][: 2 + i % 3]
    inner = f"<h1>{body[0]}</h1><div class='share-buttons'><a href=x>Share</a></div>" + "".join(f"<p>{b[: len(b) // 2]}<br><b>{b[len(b) // 2 :]}\n </b>" for b in body[1:]) + "<p>Support our work today"
    inner = f"<article class='post no-comments'>{inner}<section id=comments><p>First! {para()}</p></section></article>" if article else f"<div class=text>{inner}</div>"
    html = f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var x = "</p><article>";</script></head><body class="has-sidebar">
<header><h2>Site {i}</h2></header><nav><ul><li><a href=/{i}>n{i}</a><li><a>m</a></ul></nav><div class="cookie-notice">Cookies {i}</div><!-- <p>no</p> -->
<div id=wrap class=sidebar-left>{inner}</div><aside>Aside {i}</aside><form><p>Form <input></form><div class=ad>{para()}</div><footer>Foot {i}</footer></body></html>"""
    import html as h

    return html, "\n\n".join(" ".join(h.unescape(b[: len(b) // 2] + " " + b[len(b) // 2 :] if k else b).split()) for k, b in enumerate(body))


@pytest.mark.parametrize("article", [True, False])
def test_host_template_goes_and_article_stays(spark, article):
    made = [page(i, article) for i in range(12)]
    rows = [(i, f"https://a.example:8{i}/x?{i}", h, "text") for i, (h, _) in enumerate(made)] + [(100 + i, "https://a.example/copy", made[0][0], "") for i in range(30)]
    got = {r["page_id"]: r for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(got) == 42
    for i, (_, want) in enumerate(made):
        assert got[i]["text"] == want
        assert got[i]["n_chars"] == len(want)
    assert {got[100 + i]["text"] for i in range(30)} == {made[0][1]}


def test_odd_pages(spark):
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "x", "no markup &am &amp here"),
        (4, "http://b.example", "<p>a<p>b <i>c</i>d</p> tail <div>e"),
        (5, "http://b.example", "<article><p>&am x</article><nav>z"),
        (6, "http://b.example", "<script>never closed <p>x"),
        (7, "http://b.example", "<div>" * 3000 + "<p>deep</p>" + "</div>" * 10),
        (8, "http://b.example", "<article>" + "<p>word 'quote</p>" * 20000 + "</article>"),
        (9, "http://c.example", '<p class="x>broken <p>y'),
        (9, "http://c.example", '<p class="x>broken <p>y'),
    ]
    got = w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 10
    assert (by[1], by[2], by[3]) == ("", "", "no markup &am & here")
    assert by[4] == "a\n\nb cd\n\ntail\n\ne" and by[5] == "&am x" and by[6] == "" and by[7] == "deep"
    assert by[8] == "\n\n".join(["word 'quote"] * 20000)
    assert w.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def grow(r, n):
    tree = [(-1, "#")]
    for _ in range(n):
        tree.append((r.randrange(len(tree)), r.choice("ab")))
    return tree


def size_of_best(a, b, x=0, y=0):
    """The largest order-preserving, parent-preserving mapping, by trying all choices of children."""
    if a[x][1] != b[y][1]:
        return 0
    xs, ys = ([i for i, (p, _) in enumerate(t) if p == k] for t, k in ((a, x), (b, y)))
    best = 0
    for n in range(1, min(len(xs), len(ys)) + 1):
        for cs in combinations(xs, n):
            for ds in combinations(ys, n):
                each = [size_of_best(a, b, c, d) for c, d in zip(cs, ds)]
                best = max(best, sum(each) if all(each) else 0)
    return 1 + best


def test_matching_is_the_best():
    r = random.Random(3)
    for _ in range(150):
        a, b = grow(r, r.randint(0, 7)), grow(r, r.randint(0, 7))
        found = w.match(a, b)
        assert len(found) == size_of_best(a, b)
        assert all(a[i][1] == b[j][1] and (i == 0 or found[a[i][0]] == b[j][0]) for i, j in found.items())
        assert len(set(found.values())) == len(found)


def site(host, i, r):
    """A page whose menu, advert and footer come from the host's small pools, without telling names; and its article."""
    pool = lambda k, n: f"{host} {k} " + " ".join(random.Random(f"{host}{k}{r.randrange(n)}").choices("one two three four five six".split(), k=6))
    para = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(2, 60)))
    texts = [para() for _ in range(r.randint(1, 6))]
    body = f"<div class=a><span>{pool('menu', 4)}</span></div><div class=b>{pool('advert', 4)}</div><div class=c><h1>{para()}</h1>" + "".join(f"<p>{t}</p>" for t in texts)
    return f"<html><body>{body}</div><div class=d>{pool('foot', 4)}</div><script>id={i}</script></body></html>"


def brute(pages):
    """The whole query with plain loops: ratings by looking at every page of a host for every text."""
    from urllib.parse import urlsplit

    by, out = {}, {}
    for i, (_, url, source) in enumerate(pages):
        by.setdefault((urlsplit(url).hostname or "").lower(), []).append((i, w.Page(source or ""), source or ""))
    for rows in by.values():
        made = []
        for i, p, source in rows:
            tree, place = p.skeleton()
            made.append((i, source, tree, [{"node": place[n], "links": k, "doubtful": p.doubtful[n], "text": t} for n, t, k in p.blocks if not p.never[n]]))
        names = [w.encode_tree(t) for _, _, t, _ in made]
        pivot = w.decode_tree(max(names, key=lambda x: (names.count(x), x)))
        places = [w.slots(t, pivot) for _, _, t, _ in made]
        different = {source: (slot, blocks) for (_, source, _, blocks), (slot, _) in zip(made, places)}
        rated, common = {}, set()
        for k in range(len(pivot)):
            texts = {}
            for slot, blocks in different.values():
                for t, b in {b["text"]: b for b in reversed(blocks) if slot[b["node"]] == k}.items():
                    texts.setdefault(t, []).append(b)
            if not texts:
                continue
            n, x = len(different), [*texts.items()]
            often = {t for t, u in x if n >= 5 and len(u) >= 0.8 * n}
            rated[k] = w.Rating(len(x), sum(len(u) > 1 for _, u in x), sum(max(b["doubtful"] for b in u) for _, u in x), sum(len(t) for t, _ in x), sum(len(t) * max(b["links"] for b in u) for t, u in x), sum(len(u) for _, u in x), sum(len(t) * len(u) for t, u in x), sum(len(t) * len(u) for t, u in x if t in often))
            common |= {(k, w.digest(t)) for t in often if 2 * rated[k].constant_chars < rated[k].used_chars}
        found = w.wrapper(pivot, rated, len(different))
        for (i, _, tree, blocks), (slot, own) in zip(made, places):
            out[i] = w.content(tree, slot, own, blocks, found, common)
    return [out[i] for i in range(len(pages))]


def test_whole_query_equals_brute_force_and_needs_induction(spark):
    r = random.Random(11)
    pages = [(i, f"https://h{i % 3}.example/{i}", site(f"h{i % 3}", i, r)) for i in range(90)]
    pages += [(200 + i, "https://H1.example/copy", pages[1][2]) for i in range(40)]
    pages += [(300 + i, f"http://h{i % 3}.example/x", page(i)[0]) for i in range(6)] + [(400, "//alone.example/", page(3)[0]), (401, None, site("h9", 1, r)), (402, "https://h0.example/", None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in w.extract(table).collect()}
    want = dict(zip((p[0] for p in pages), brute(pages)))
    assert got == want
    import re

    for i in range(90):
        assert got[i] == "\n\n".join(re.findall(r"<(?:h1|p)>(.*?)</", pages[i][2]))
    parsed = w.materialise(w.parse(table), "pages")
    without = {r["page_id"]: r["text"] for r in w.apply_wrappers(parsed, w.induce(parsed).limit(0)).collect()}
    assert all(without[i] != got[i] for i in range(90))


def test_hosts_of_copies_keep_their_text(spark):
    """Pages that differ in their scripts only, or in one paragraph: what they share is no template."""
    text = [f"Paragraph {i} " + "word " * 30 for i in range(8)]
    one = lambda i, edit: "<body><div class=m>menu</div><article><h1>Same title</h1>" + "".join(f"<p>{t} {i if edit and k == i % 8 else ''}</p>" for k, t in enumerate(text)) + f"</article><script>{i}</script></body>"
    rows = [(i, "http://same.example", one(i, False)) for i in range(12)] + [(100 + i, "http://near.example", one(i, True)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, source in rows:
        paragraphs = source.split("<p>")[1:]
        assert got[i].split("\n\n")[-8:] == [" ".join(p.split("</p>")[0].split()) for p in paragraphs]
