"""Phrases, the filter audit and page texts against brute force on small fixtures."""

import html
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import duckdb
import pytest

from skewprobe.llm import audit, pages, phrases, registry
from skewprobe.session import ship

SF = "/root/testdata/sf0.001"


# --- phrases ------------------------------------------------------------------


def brute_counts(docs, longest):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(rb"[.,;:!?\n-\r]", (text or "").encode().lower()):
            words = [w for w in re.split(rb"[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und"][tuple(words[i : i + n])] += 1
    return counts, total


def brute_collocations(docs, longest, least, within, top):
    counts, total = brute_counts(docs, longest)
    rows = []
    for lang, f in counts.items():
        mine = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(
                len(q) > len(p) and 100 * b >= within * a and b >= least
                and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in f.items()
            )
            if not inside:
                mine.append((-score, -a, b" ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


def texts(n, seed, words=6):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "é", "x y", "梦", "a_b", "-"][:words]
    marks = [" ", "  ", "\t", ", ", ".", "\n", "!? ", " ", " ", " "]
    passage = "Once upon a time in the west of the town"
    out = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "de", None]), f"{text} {passage} {text}" if i % 3 == 0 else text))
    return [*out, *out[:20], ("en", None), ("en", ""), (None, ".,;"), ("fr", "solo")]


@pytest.mark.parametrize("trigger", [1, 3, 16])
def test_chunks_hold_every_phrase_once(trigger):
    for lang, text in texts(40, 5) + [("en", "word " * 5000), ("en", "w" * 5000)]:
        found = Counter()
        for chunk, own in phrases.chunks_of((text or "").encode(), 3, trigger):
            for piece in chunk.split(b"\n"):
                words = piece.split(b" ")
                for i in range(min(own, len(words))):
                    for n in range(1, 5):
                        if i + n <= len(words):
                            found[tuple(words[i : i + n])] += 1
                own -= min(own, len(words))
        assert found == sum((Counter(c) for c in brute_counts([(lang, text)], 4)[0].values()), Counter())


@pytest.mark.parametrize(("longest", "least", "within", "top"), [(4, 3, 80, 2000), (3, 1, 50, 7), (2, 5, 80, 3)])
def test_collocations(spark, longest, least, within, top, monkeypatch):
    ship(spark)
    monkeypatch.setattr(phrases, "HELD", 200)
    docs = texts(90, 6)
    table = spark.createDataFrame(spark.sparkContext.parallelize(docs, 5), "lang string, text string")
    table = table.selectExpr("lang", "text", "1 as Phrase", "2 as N")
    found = phrases.collocations(table, longest, least, within, top, trigger=3)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_collocations(docs, longest, least, within, top)


def test_no_phrases(spark):
    ship(spark)
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """With far too few bits nearly everything passes, and the counts are the same."""
    ship(spark)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    docs = texts(60, 8)
    table = spark.createDataFrame(docs, "lang string, text string")
    found = phrases.collocations(table, 4, 3, 80, 50)
    assert sorted(map(tuple, found.collect())) == brute_collocations(docs, 4, 3, 80, 50)


def test_products_beyond_64_bits(spark):
    """The score expression on counts whose products do not fit a long."""
    a, left, right = 9 * 10**14, 10**15, 2 * 10**15
    sql = (
        f"cast({phrases.SCALE}L * cast({a}L as decimal(20,0)) div "
        f"(cast({left}L as decimal(20,0)) + cast({right}L as decimal(20,0))) as bigint)"
    )
    assert spark.sql(f"select {sql}").first()[0] == 2_000_000 * a // (left + right)


# --- filter audit -------------------------------------------------------------


def brute_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    known = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            known[i][0] |= quality == 1
            known[i][1] |= toxic == 1
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mine = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        fails.append((source or "", mine, *(known[i] if i is not None else (False, False))))
    rows = []
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        removed = {}
        for order in permutations("ABCDE"):
            live = own
            for step, name in enumerate(order, 1):
                gone = [f for f in live if f[1][name]]
                live = [f for f in live if not f[1][name]]
                failing = [f for f in own if f[1][name]]
                removed["".join(order), name] = len(gone)
                rows.append(
                    [part, "".join(order), step, len(live), len(gone), len(failing) - len(gone),
                     sum(sum(f[1].values()) == 1 for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone), name]
                )
        for row in rows:
            if row[0] == part:
                row.append(sum(n for (_, name), n in removed.items() if name == row[9]))
    return sorted(tuple(r[:9] + r[10:]) for r in rows)


def test_audit(spark):
    long = " ".join(f"word{i}" for i in range(60))
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "a"), (None, long, "a"), (None, long, None), (3, long + " A#", "b"),
        (4, None, "b"), (5, "", None), (6, "", ""), (7, "same " * 80, "b"), (8, "LOUD " * 80, "b"), (0, "LOUD " * 80, "a"),
        (9, long.upper() + " %", "a"), (10, "é梦 " * 10, "b"), (1, long, "c"), (11, "  \t\n", "c"), (12, long + "|", "c"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (4, 1, None), (None, 1, 1), (8, 1, 1), (9, None, None), (12, 1, 0), (99, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as Mask")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(table, known)
    assert sorted(map(tuple, found.collect())) == brute_audit(docs, labels)
    assert audit.audit(table.limit(0), known).count() == 0
    none = audit.audit(table, known.limit(0))
    assert {(r.good_lost, r.toxic_lost) for r in none.collect()} == {(0, 0)}


@pytest.mark.parametrize("filters", [1, 2, 3, 5])
def test_shapley_weights_equal_the_mean_over_orders(filters):
    rng = random.Random(filters)
    value = [0] + [rng.randrange(1000) for _ in range((1 << filters) - 1)]
    weights, over = audit.shapley_weights(filters)
    for i in range(filters):
        total = 0
        for order in permutations(range(filters)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += value[before | 1 << i] - value[before]
        solved = sum(w * v for w, v in zip(weights[i], value, strict=True))
        assert solved * factorial(filters) == total * over


# --- pages --------------------------------------------------------------------

TEXT = "The old house on the hill was sold to a family that had come from the north, and they were to live in it for long."
ODD = "xq%%% zrr### qq&&& vv " * 8


def article_of(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    return " ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", body)).split())


def test_given_pages(spark):
    table = duckdb.sql(f"SELECT * FROM '{SF}/pages.parquet'").fetchall()
    want = {i: (url, article_of(page)) for i, url, page in table}
    found = registry.queries()["op13_main_text"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in found} == want and len(found) == len(table)
    assert all(r.n_chars == len(r.text) for r in found)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><ul><li><a href=1>Home</a><li><a href=2>About us</a></ul><h1>Head</h1><p>{TEXT}<p>Yes.<p>{TEXT}<p>© 2020</body>",
         f"Head {TEXT} Yes. {TEXT}"),
        (f"<div id=header><h1>Site</h1></div><div class='a has-sidebar'><h2>T</h2><p>{TEXT}</p><div class=sidebar><p>{TEXT}</p></div></div>"
         f"<div id=footer><p>{TEXT}</p></div>", f"T {TEXT}"),
        (f"<article><header><h1>T</h1><p>by me</p></header><p>{TEXT}</p><div class=ad>Buy the thing</div><aside><p>{TEXT}</p></aside>"
         f"<form><label>Name</label><button>Go</button></form><p>End.</p><p>{ODD}</p>"
         f"<section class=comments><article><p>{TEXT}</p></article></section></article><div class=notice><p>{TEXT}</p></div>",
         f"T {TEXT} End. {' '.join(ODD.split())}"),
        (f"<main><nav><a href=x>Crumb</a></nav><h1>M</h1><p>{TEXT}</p><p>Bye</p><div id=comments><p>{TEXT}</p></div></main>", f"M {TEXT} Bye"),
        (f"<div class=ad>Buy<article><h1>H</h1><p>{TEXT}</article><footer>x</footer>", f"H {TEXT}"),
        (f"<article><p>a&amp;b &lt;i&gt; &#233;&#0065;&nbsp;x&#99999999999;</p><script>var t='</p>';</script><style>p{{}}</style>"
         f"<!-- <p>no</p> --><p>3 < 4<br>5&copy</p></article>", "a&b <i> éA x� 3 < 4 5©"),
        (f"<div hidden><p>{TEXT}</p></div><p>{TEXT}</p><div role=navigation>Up</div>", TEXT),
        ("", ""), ("<", ""), ("<!--", ""), ("<article>", ""), ("plain", ""),
    ],
)
def test_layouts(page, want):
    assert pages.extract(page)[0] == want


def test_long_and_broken_pages_take_linear_time():
    for unit in ("<div>", "</p>", "<a href=x>", "<a ", '="', "<!", "&", "<li>x", '<a href="', "<svg>", "&#9", "<p " + " " * 50):
        pages.extract(unit * 20_000)
    assert pages.extract("<article>" + f"<p>{TEXT}</p>" * 20_000)[0] == " ".join([TEXT] * 20_000)


def test_page_edges(spark):
    ship(spark)
    rows = [(1, None, "x", "y"), (1, "", "x", "y"), (None, f"<p>{TEXT}", "x", "y"), (None, f"<p>{TEXT}", "x", "y")]
    table = spark.createDataFrame(rows, "page_id long, html string, Text string, N_CHARS string")
    found = pages.main_text(table)
    assert found.columns == ["page_id", "html", "text", "n_chars", "n_blocks", "n_kept"]
    assert sorted(r.text for r in found.collect()) == ["", "", TEXT, TEXT]
    assert pages.main_text(table.limit(0)).count() == 0
