import random

import numpy as np
import pytest
from cases import prose

from skyledger.llm import extract as E
from skyledger.llm.markup import blocks


def page(k, *, marked, body=None):
    """A page with menu, advert, notice, form, comments and footer around a text; without marks the places have no telling names."""
    tag, rng = ("article", "nav", "footer", "ad") if marked else ("div", "div", "section", "x1"), random.Random(k)
    menu = "".join(f"<li><a href='/{w}'>{w} {w}</a></li>" for w in (prose(k % 4, 6)).split())
    text = body or [prose(k * 3 + j, 60) for j in range(3)]
    inner = "".join(f"<p>{t.replace('&', '&amp;')}" for t in text)
    foot = f"&copy; site all rights reserved {prose(77 + k % 3, 8)}"
    side = "<form><input name=q><button>Search now please</button></form><div class='cookie-notice'>We use cookies here</div>" if marked else ""
    comments = "<section id='comments'><p>first reader says hi " + prose(rng.randrange(99), 9) + "</p></section>" if marked else ""
    html = (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><{tag[1]}><ul>{menu}</ul></{tag[1]}><!-- <p>hidden</p> -->"
            f"<div class='{tag[3]}'>{prose(50 + k % 5, 12)}</div><{tag[0]}><h1>Title {k} &eacute;&#233;&lt;x&gt;</h1>{inner}</{tag[0]}>{side}{comments}<{tag[2]}>{foot}</{tag[2]}></body></html>")
    return html, "\n".join([f"Title {k} éé<x>", *(" ".join(t.split()) for t in text)])


def slow_covered(tokens, page, run):
    """Every pair of places compared."""
    hit = [False] * len(tokens)
    for a in range(len(tokens) - run + 1):
        for b in range(len(tokens) - run + 1):
            if page[a] != page[b] and all(tokens[a + d] == tokens[b + d] >= 0 for d in range(run)):
                hit[a:a + run] = [True] * run
    return hit


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 200)
    order, rank = E.suffix_array(tokens, 200)
    assert [tokens[k:].tolist() for k in order] == sorted(tokens[k:].tolist() for k in range(200))
    _, rank = E.suffix_array(tokens, 4)
    keys = [tuple(tokens[k:k + 4]) for k in range(200)]
    assert all((keys[a] == keys[b]) == (rank[a] == rank[b]) for a in range(0, 197) for b in range(0, 197))


@pytest.mark.parametrize("seed", range(6))
def test_covered_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    tokens, page = rng.integers(0, 3, 90), np.sort(rng.integers(0, 5, 90))
    ends = np.flatnonzero(np.diff(page))
    tokens[ends] = -1 - np.arange(len(ends))
    assert E.covered(tokens, page, 4).tolist() == slow_covered(tokens.tolist(), page.tolist(), 4)


@pytest.mark.parametrize("marked", [True, False])
def test_only_the_article_stays(marked):
    made = [page(k, marked=marked) for k in range(40)]
    assert E.main_texts([p for p, _ in made]) == [t for _, t in made]


def test_copied_articles_are_kept():
    same = [prose(500 + j, 80) for j in range(3)]
    for marked in (True, False):
        made = [page(k, marked=marked) for k in range(40)] + [page(7, marked=marked, body=same)] * 30
        assert E.main_texts([p for p, _ in made]) == [t for _, t in made]


def test_markup_cases():
    text = lambda p: "\n".join(b.text for b in blocks(p))
    assert text("a<b>b</b>c &nbsp; d<br>e<p>f &amp;lt; &#x41; &unknown; <i>g") == "abc d e\nf &lt; A &unknown; g"
    assert text("<div>1<div>2</div>3</div><script>x</script><SCRIPT>y") == "1\n2\n3"
    assert text("<p title='a > b'>x</p></div></p>y < z 3<4") == "x\ny < z 3<4"
    assert text("") == text("<>") .replace("<>", "") == ""
    assert E.main_texts(["<body><header>Site</header><main><header><h1>H</h1></header>t<footer>f</footer><aside>s</aside></main>rest</body>"]) == ["H\nt"]
    assert E.main_texts(["<div hidden>no</div><div style='display: none'>no</div><p role=alert>no</p><p>yes</p>"]) == ["yes"]


def test_class_words_of_wrappers_do_not_empty_a_page():
    for before, after in (("<div class='layout with-sidebar'><article>", "</article></div>"), ("<div class='no-sidebar'><p>", "</div>"),
                          ("<article class='post category-social'>", "</article>"), ("<div id=comments><article>", "</article></div>"),
                          ("<div class='social'><p>", "</div>")):
        assert E.main_texts([f"<body><nav>menu</nav>{before}the text{after}<footer>foot</footer>"]) == ["the text"]
    # Beside another article they count, and so do those inside one.
    assert E.main_texts(["<article><p>text<div class=share>share this</div></article><div class=comments><article>first</article></div>"]) == ["text"]


def test_repeats_go_from_marked_articles_and_unique_text_beside_them_stays():
    made, due = [], []
    for k in range(30):
        lead, body, more = prose(1000 + k, 30), prose(2000 + k, 70), prose(3000 + k, 40)
        made.append(f"<body><div class=lead>{lead}</div><article><p>{body}</p><p>Written by the staff of this paper every day</p>"
                    f"<div class=box>Get our best stories by mail each morning</div></article><div>{more}</div><div>All rights reserved by the paper</div>")
        due.append("\n".join(" ".join(t.split()) for t in (lead, body, more)))
    assert E.main_texts(made) == due


def test_short_articles_under_long_menus():
    made = [f"<body><div class=m>{prose(1, 60)}</div><p>{prose(4000 + k, 20)}</p><p>Written by the staff of this paper every day</p><div class=f>{prose(2, 60)}</div>" for k in range(30)]
    assert E.main_texts(made) == [" ".join(prose(4000 + k, 20).split()) for k in range(30)]


def near_copy(k, v, n=6):
    """A marked page of article `k` with `n` paragraphs; copies differ in words of their longest paragraph."""
    paragraphs = [" ".join(prose(7000 + 10 * k + j, 60 - 5 * j).split()) for j in range(n)]
    words = paragraphs[0].split()
    words[20:21] = [f"changed{v}"]
    paragraphs[0] = " ".join(words)
    head = f"Headline number {k} of the day"
    return f"<title>{head}</title><nav>Menu of us</nav><article><h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>", "\n".join([head, *paragraphs])


@pytest.mark.parametrize("others", [0, 1, 40])
def test_near_copies_keep_all_their_text(others):
    made = [near_copy(0, v) for v in range(3)] + [near_copy(k, 0) for k in range(1, others + 1)]
    assert E.main_texts([p for p, _ in made]) == [t for _, t in made]
    # In any order, and where one paragraph is another text altogether.
    swapped = [(p.replace(t.split("\n")[2], prose(8000 + v, 90).strip()), t) for v, (p, t) in enumerate(made[:3])]
    found = E.main_texts([p for p, _ in swapped[::-1] + made[3:]])[:3]
    for text, (_, t) in zip(found, swapped[::-1]):
        assert all(line in text.split("\n") for j, line in enumerate(t.split("\n")) if j != 2)


def test_headlines_stay_and_boxes_go():
    made, due = [], []
    for k in range(30):
        body = " ".join(prose(9000 + k, 70).split())
        made.append(f"<title>Weekly letter to the readers</title><article><h1>Weekly letter to the readers</h1><h2>Weekly letter to the readers</h2><p>{body}</p>"
                    "<div class=box><h3>Get our best stories by mail</h3><span>Every morning before eight, free of charge</span></div></article>")
        due.append("\n".join(["Weekly letter to the readers"] * 2 + [body]))
    assert E.main_texts(made) == due


def test_passages_that_some_articles_share_stay():
    shared = " ".join(prose(1, 60).split())
    texts = [[" ".join(prose(9500 + k, 70).split()), *([shared] if k % 3 == 0 else [])] for k in range(30)]
    assert E.main_texts(["<article>" + "".join(f"<p>{t}" for t in ts) + "</article>" for ts in texts]) == ["\n".join(ts) for ts in texts]


def slow_numbers(pages, run=4):
    """Near copies by looking at all earlier pages for every run; all blocks are marked articles on one page each or on copies."""
    grams, numbers = [], []
    for p in pages:
        words = [b.text.lower().split() for b in blocks(p)]
        grams.append([tuple(w[k:k + run]) for w in words for k in range(max(len(w) - run, 0) + 1)])
        votes = {}
        for g in grams[-1]:
            earlier = [numbers[j] for j in range(len(numbers)) if g in grams[j]]
            if earlier:
                votes[earlier[0]] = votes.get(earlier[0], 0) + 1
        best = max(votes, key=lambda n: (votes[n], -n), default=None)
        numbers.append(best if best is not None and 2 * votes[best] >= len(grams[-1]) else max(numbers, default=-1) + 1)
    return numbers


def test_numbers_of_near_copies_equal_brute_force():
    rng = random.Random(4)
    pages = []
    for _ in range(60):
        words = prose(rng.randrange(8), 60).split()
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = rng.choice(["new", "words", "here"]) + str(rng.randrange(50))
        pages.append(f"<article><p>{' '.join(words)} end{len(pages)}</article>")
    numbers = E.own_texts([blocks(p) for p in pages])[0]
    assert numbers == slow_numbers(pages) and len(set(numbers)) < 40


def test_a_very_long_page():
    body = [" ".join(prose(9900 + j, 2000).split()) for j in range(20)]
    assert E.main_texts(["<article>" + "".join(f"<p>{b}" for b in body) + "</article>", "", "<p>x"]) == ["\n".join(body), "", "x"]


def test_rows_on_spark(spark):
    made = [page(k, marked=True) for k in range(60)]
    rows = [(k, f"https://h{k % 2}.example/{k}", p, "c", 1) for k, (p, _) in enumerate(made)]
    rows += [(100, None, "<p>alone", "c", 1), (101, "odd", None, "c", 1), (102, "http://x/", "", "c", 1), (5, rows[5][1], rows[5][2], "d", 2), (None, "http://x/", "<p>b", "c", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, shard int")
    expected = {k: t for k, (_, t) in enumerate(made)} | {100: "alone", 101: "", 102: "", None: "b"}
    for size in (1 << 22, 20_000):
        got = E.extract(df, shard_bytes=size).collect()
        assert len(got) == len(rows)
        assert all(r.text == expected[r.id] and r.n_chars == len(r.text) for r in got)
    assert E.extract(df.limit(0)).count() == 0


def mixed_host(n, seed=1):
    """Pages with near copies, shared passages, boxes, headlines, unmarked articles, repeated rows and pages without text."""
    rng, made = random.Random(seed), []
    for k in range(n):
        kind = rng.randrange(8)
        if kind < 2:
            html = page(k, marked=bool(kind))[0]
        elif kind == 2:
            html = near_copy(rng.randrange(n // 12 + 1), k)[0]
        elif kind == 3:
            words = prose(rng.randrange(6), 60).split()
            for _ in range(rng.randrange(20)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
            html = f"<article><p>{' '.join(words)}</article><div>All rights reserved by the paper</div>"
        elif kind == 4:
            html = f"<title>Weekly letter</title><article><h1>Weekly letter</h1><p>{prose(k, 50)}<p>Written by the staff of this paper every day<p>{prose(k % 3, 40)}</article>"
        elif kind == 5:
            html = f"<div class=m>{prose(1, 60)}</div><p>{prose(4000 + k, 20)}</p><p>Written by the staff of this paper every day</p>"
        else:
            html = rng.choice(["", "<p>x", f"<p>{prose(k % 9, 3)}", made[rng.randrange(len(made))] if made else "<p>first"])
        made.append(html)
    return made


@pytest.mark.parametrize("run", [4, 3])
def test_the_text_of_a_page_does_not_depend_on_the_size_of_its_host(spark, run):
    hosts = {f"h{h}.example": mixed_host(n, h) for h, n in enumerate((160, 7))}
    rows = [(k if k % 40 else None, f"https://{h}/{k}", html) for h, made in hosts.items() for k, html in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    due = {}
    for h in hosts:
        own = sorted((r for r in rows if f"//{h}/" in r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        due |= {r[1]: t for r, t in zip(own, E.main_texts([r[2] for r in own], run))}
    assert len(set(due.values())) > 60
    for size in (1 << 24, 4000, 0):
        assert {r.url: r.text for r in E.extract(df, min_run=run, shard_bytes=size).collect()} == due
