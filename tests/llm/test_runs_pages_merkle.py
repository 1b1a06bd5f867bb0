import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import html, merkle, periodic, queries
from tests.llm import messy

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def ready(spark):
    C.prepare(spark)


# ------------------------------------------------------------------ periodic runs

def runs_brute(words):
    """Every period, every stretch; one whose own period is smaller is not a run of this one."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q):
                part = words[i:i + size]
                if not any(all(part[k] == part[k + d] for k in range(size - d)) for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_every_period():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6 and n:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert list(map(tuple, periodic.runs_of(np.array(words, np.int64)).tolist())) == runs_brute(words)


@pytest.mark.parametrize("words, runs", [
    ([0] * 100_000, [(0, 100_000, 1)]), ([0, 1] * 50_000, [(0, 100_000, 2)]), (list(range(100_000)), []),
    ([0] * 5, []), ([0] * 6, [(0, 6, 1)]), ([0, 1] * 3 + [0], []), ([0, 1] * 4, [(0, 8, 2)]), ([], []), ([1], []),
    ([9, *range(30_000)] + [*range(30_000)] * 3, [(1, 120_000, 30_000)]),
])
def test_long_and_short_runs(words, runs):
    assert list(map(tuple, periodic.runs_of(np.array(words, np.int64)).tolist())) == runs


def test_many_places_of_one_phrase():
    """A phrase met 20,000 times, after another word each time, makes no pair."""
    words = [w for i in range(20_000) for w in (0, 1, 2, 3, 4, 5, 100 + i)]
    assert not len(periodic.runs_of(np.array(words, np.int64)))


def row_brute(doc_id, text, plant):
    words = []
    for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" "):
        words += [w] * (w != "")
    n = len(words)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_brute(words)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_query_against_loops(spark):
    """Texts of up to 600 words; the loop takes the square of a text."""
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_periodic(spark, SF).collect()}
    docs = C.read(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    short = [r for r in docs if len((r.text or "").split()) <= 600]
    assert len(short) > 100 and sum(got[r.doc_id][1] for r in short) > 5
    for r in short:
        assert got[r.doc_id] == row_brute(r.doc_id, r.text, True)


def test_runs_of_awkward_rows(spark):
    rows = messy.ROWS[:6] + messy.ROWS[8:] + [(20, "la " * 9, "a"), (20, "la " * 9, "a"), (21, "x y " * 8 + "\x1c", None)]
    got = periodic.periodic_runs(messy.table(spark, rows))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=key) == sorted((row_brute(r[0], r[1], False) for r in rows), key=key)
    assert {r.collapsed for r in got.filter("doc_id = 20").collect()} == {"la"}
    assert periodic.periodic_runs(messy.table(spark)).filter("n_words > 29999").count() == 2
    assert periodic.periodic_runs(messy.empty(spark)).count() == 0


# ------------------------------------------------------------------ main text

BODY = ["Rivers carry silt, and silt makes islands.", "Short one.", "In spring the water rises, the reeds bend & the herons return to the old bank.",
        "A note: see <the map>, kept in the tower, for all the names that are no longer used."]
ESCAPED = [p.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&#62;") for p in BODY]
PARAS = "".join(f"<p>{p}</p>\n" for p in ESCAPED)
TITLE = "The islands of the delta"
WANT = "\n".join([TITLE, *BODY])
CHATTER = "I was there last year, and it was lovely, truly lovely, as everyone says, although the ferry, alas, was late again, and again. "
NOISE = f"""<script>if (a < b) document.write("<p>no, no, no, never this, not this</p>")</script><style>p > a {{color: red}}</style>
<noscript>Please turn scripts on, thank you, this site needs them.</noscript><!-- <p>hidden, hidden, hidden</p> -->
<div class="cookie-notice"><p>We use cookies, small files, to improve, measure and personalise what you see on this site.</p></div>"""
MENU = "<nav><ul><li><a href='/a'>News</a><li><a href='/b'>Maps, charts</a><li><a href='/c'>Boats</a></ul></nav>"
COMMENTS = "<div id='comments'><h3>Comments</h3>" + f"<div class='comment'><p>{CHATTER * 6}</p></div>" * 8 + "</div>"
SIDE = f"<aside><h2>Also</h2><p>{CHATTER}</p></aside><div class='sidebar-right'><h2>Most read</h2><p>{CHATTER}</p></div>"
ADVERT = "<div class='ad'>Buy our boats, fast boats, cheap boats, today only, while stocks last, call now.</div>"
FORM = "<form action='/s'><p>Your name, your address, your opinion, please.</p><input><button>Send</button></form>"
FOOT = "<footer><p>&copy; Delta Herald, all rights reserved, printed on paper, sold in shops.</p></footer>"


def page(inner):
    return f"<!DOCTYPE html><html><head><title>{TITLE} | Herald</title>{NOISE[:0]}</head><body>{inner}</body></html>"


LAYOUTS = {
    "article": page(f"{NOISE}{MENU}<article><h1>{TITLE}</h1>{PARAS}</article>{SIDE}{COMMENTS}{FOOT}"),
    "inside": page(f"{MENU}<article><h1>{TITLE}</h1>{ADVERT}{PARAS}{FORM}{NOISE}{COMMENTS}</article>{FOOT}"),
    "divs": page(f"<div class='header'><p>Delta Herald, founded long ago, daily, and weekly on paper.</p></div><div id='wrap'>{MENU}"
                 f"<div class='content'><h1>{TITLE}</h1>{PARAS}</div>{SIDE}</div>{COMMENTS}{FOOT}"),
    "no wrapper": page(f"{MENU}<h1>{TITLE}</h1>{PARAS}{ADVERT}{FOOT}"),
    "sections": page(f"<header><h1>Delta Herald</h1></header><main><h1>{TITLE}</h1>"
                     f"<section><p>{ESCAPED[0]}</p></section><section><p>{ESCAPED[1]}</p></section>"
                     f"<section><p>{ESCAPED[2]}</p><p>{ESCAPED[3]}</p></section></main>{SIDE}{FOOT}"),
    "layout class": page(f"<div class='has-sidebar page'>{MENU}<article class='post'><h1>{TITLE}</h1>{PARAS}</article></div>{FOOT}"),
    "left open": f"<html><body>{MENU}<article><h1>{TITLE}</h1><p><b>{ESCAPED[0]}<br><p>{ESCAPED[1]}<p><i>{ESCAPED[2]}</b><p>{ESCAPED[3]}",
    "upper case": page(f"{MENU}<ARTICLE><H1 >{TITLE}</H1>{PARAS.replace('<p>', '<P CLASS=lead title=\"a > b\">').replace('</p>', '</P >')}</ARTICLE>{FOOT}"),
    "blank": page(f"{MENU}<article>\n <h1>\n  The  islands\tof\n the <em>delta</em></h1>" + "".join(f"<p>\n {p.replace(' ', chr(10) + '  ')} </p>" for p in ESCAPED) + "</article>"),
    "unnamed menu": page(f"<ul><li><a href='/a'>News</a></li><li><a href='/b'>Maps</a></li><li><a href='/c'>Boats</a></li></ul><div><h1>{TITLE}</h1>{PARAS}</div>{FOOT}"),
    "article bits": page(f"{MENU}<div class='main'><article><h1>{TITLE}</h1>{PARAS}</article><div class='related'><article><p>{CHATTER}</p></article></div></div>{FOOT}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_layouts(name):
    assert html.article_of(LAYOUTS[name]) == WANT


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain &amp; simple\n text", "plain & simple text"), ("<nav><a href=x>Menu</a></nav>", ""), ("<p>One", "One"),
    ("<p>a &lt; b&nbsp;&eacute;&#x20AC; &am", "a < b é€ &am"), ("<div>One<p>Two</p>Three</div>", "One\nTwo\nThree"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>", "deep\nafter"),
    ("<script>never closed <p>text</p>", ""), ("<p>kept</p><!-- never closed <p>text</p>", "kept"), ("<p>kept</p><a href='never closed>x</a>", "kept"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<ul><li>x<ul><li>y</ul><li>z</ul>", "x\ny\nz"), ("<p>1 < 2 and <3", "1 < 2 and <3"),
    ("<p>" + "a</i>" * 50_000 + "</p>", "a" * 50_000),
])
def test_main_text_of_odd_pages(source, want):
    assert html.article_of(source) == want


def test_main_text_of_the_pages(spark):
    """These pages mark their article; its blocks are cut out by hand here."""
    import re
    from html import unescape

    pages = {r.page_id: r for r in C.read(spark, SF, "pages").collect()}
    got = queries.op12_html(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        source = pages[r.page_id].html
        inner = source[source.index("<article>") + 9:source.index("</article>")]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_main_text_of_awkward_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "v", LAYOUTS["article"], "x"), (2, "w", LAYOUTS["article"], "x"), (2, "w", LAYOUTS["article"], "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html.main_text(table).collect(), key=str)
    assert [r.n_chars for r in got] == [0, 0] + [len(WANT)] * 3 or sorted(r.n_chars for r in got) == [0, 0] + [len(WANT)] * 3
    assert html.main_text(table.limit(0)).count() == 0


# ------------------------------------------------------------------ Merkle

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_brute(items):
    """The root, and each leaf's (before, after) siblings from below."""
    siblings, level = [[] for _ in items], [(d, [j]) for j, d in enumerate(items)]
    while len(level) > 1:
        above = []
        for a in range(0, len(level), 2):
            run = level[a:a + 2]
            for b, (_, leaves) in enumerate(run):
                for j in leaves:
                    siblings[j].append(("".join(x[0] for x in run[:b]), "".join(x[0] for x in run[b + 1:])))
            above.append((digest(*(x[0] for x in run)), [j for x in run for j in x[1]]))
        level = above
    return level[0][0], siblings


def merkle_brute(rows):
    leaves = [digest(*map(field, r)) for r in rows]
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[2], []).append(k)
    for ks in groups.values():
        ks.sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaves[k]))
    trees = {lang: tree_brute([leaves[k] for k in ks]) for lang, ks in groups.items()}
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    root, above = tree_brute([trees[x][0] for x in names])
    out = []
    for name, over in zip(names, above):
        for k, own in zip(groups[name], trees[name][1]):
            i, source, lang, n, text = rows[k]
            at = leaves[k]
            if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0:
                at = digest(*map(field, (i, source, lang, n + 1, text)))
            for before, after in own + over:
                at = digest(before, at, after)
            out.append((i, leaves[k], trees[name][0], root, digest(*(x for s in own + over for x in s)), at, at == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, n string, tree string, lo string, part string"


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 2, None: 3}, {"en": 2100, "é": 1, None: 5, "": 8, "z": 1024, "zz": 1025}])
def test_merkle_against_a_loop(spark, tmp_path, sizes):
    rng = random.Random(3)
    rows = []
    for lang, size in sizes.items():
        for k in range(size):
            rows.append((rng.randrange(10**6), rng.choice([None, "s", "ü"]), lang, rng.choice([None, 3, 40]), rng.choice([None, "", "täxt", "x" * 40])))
    rows += [r for r in rows[:3]] + [(None, None, lang, None, None) for lang in list(sizes)[:1]]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == (merkle_brute(rows) if rows else [])
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_merkle_of_many_trees(spark, monkeypatch):
    """More chunks than are broadcast, and a top tree of several tiers."""
    monkeypatch.setattr(merkle, "MAX_CHUNKS", 2)
    rows = [(k, None, f"l{k % 1500}", k, "t") for k in range(3200)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    plain = merkle.proofs(table).collect()
    want = {r[0]: r for r in merkle_brute(rows)}
    assert len(plain) == len(rows) and all(r.verified and r.folded_root == r.root for r in plain)
    assert all(tuple(r)[:5] == want[r.doc_id][:5] for r in plain)
    claim = F.when(F.col("doc_id") == 5, F.sha2(F.lit("other"), 256))
    assert [r.doc_id for r in merkle.proofs(table, claim=claim).collect() if not r.verified] == [5]
