"""Extraction, token counts, license scan and classifier."""
from collections import Counter

import numpy as np
import random

import pytest
from texts import SF, frame, pairs

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a = "</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for all of us.</div>
<article><header><h1>Ti&shy;tle&nbsp;one</h1></header><p>First <b>bo</b>ld
 text &lt;here&gt; &#233;.<p>Second<br>line</p><div class="ad">Buy this thing now, it is very good and cheap, really.</div>
<p>Short.</p><aside>Related things that nobody reads</aside><p>Last one.</p><form><label>Mail</label><input></form></article>
<div id="comments"><p>A reader says a lot of words about all of this, and more of them, and still more of them.</p></div>
<footer>&copy; nobody &middot; words</footer></body></html>"""


def test_main_text_of_a_marked_article():
    from logbraid.llm.html_extraction import main_text

    assert main_text(PAGE) == "Ti\xadtle one First bold text <here> é. Second line Short. Last one."


def test_main_text_by_line_blocks():
    """Without an article mark the surge of text decides; short lines inside stay."""
    from logbraid.llm.html_extraction import main_text

    body = ["A first long paragraph of the text that goes on for quite a while, as they do.", "Short.", "And one more paragraph that is long enough, with <a href=x>a link</a> inside it."]
    menu = "".join(f"<li><a href=/{i}>Item number {i}</a></li>" for i in range(12))
    page = f"<body><ul>{menu}</ul><div>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><ul>{menu}</ul><div>Imprint</div></body>"
    assert main_text(page) == " ".join(body).replace("<a href=x>", "").replace("</a>", "")


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("plain text only", "plain text only"), ("<article></article>", ""), ("<article>a<p", "a<p"), ("<article><p>a &am b &#x41;</article>", "a &am b A"), ("<script>never closed", ""), ("<!-- x", ""), ("<article>1 < 2 and <b>3</article>", "1 < 2 and 3")],
)
def test_main_text_of_odd_pages(page, text):
    from logbraid.llm.html_extraction import main_text

    assert main_text(page) == text


def test_main_text_outside_an_article_mark():
    """A mark adds weight to its lines, but takes none from the rest; what is in between goes on after the mark."""
    from logbraid.llm.html_extraction import main_text

    body = ["A first long paragraph of the text that goes on for quite a while, as they do, line after line.", "Short.", "And the end."]
    plain = [f"<div>{b}</div>" for b in body]
    card = "<article><h3>Read next</h3></article>"
    for at in range(len(plain) + 1):
        assert main_text("<body>" + "".join([*plain[:at], card, *plain[at:]]) + "</body>") == " ".join(body)
    assert main_text(f"<body>{''.join(plain)}<article><h2>Title</h2><p>Text.</p></article></body>") == " ".join([*body, "Title", "Text."])
    assert main_text(f"<body><div>By us</div><article>{''.join(plain)}</article><div>Imprint</div></body>") == " ".join(body)
    form = "<form>" + "<p>Mail</p>" * 5 + "</form>"
    assert main_text(f"<article>{plain[0]}{form}{plain[2]}</article>") == f"{body[0]} {body[2]}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>x</title><body><article>Text.</article>", "Text."),
        ("<head class=header><meta charset=utf-8><article>Text.</article>", "Text."),
        ("<head><title>x<body><article>Text.</article>", "Text."),
        ("<head><title>a <b> c</title></head><body>Text.", "Text."),
        ("<article>One <svg viewBox='0 0 1 1'/> two <math/> three <svg><text>no</text></svg>four.</article>", "One two three four."),
        ("<article>One <svg><svg><text>no</text></svg><text>no</text></svg>two.</article>", "One two."),
        ("<article>One <canvas>two <canvas>no</canvas> three.</article>", "One two three."),
        *((f"<article>One.<{tag}><p>Two.</article>", "One. Two.") for tag in ("noscript", "template", "svg", "iframe", "object", "canvas", "math")),
        ("<article>One.<!--> Two.</article><!-- x -->", "One. Two."),
        ("<article>One.<script>no</script > Two.<style>never closed", "One. Two."),
        ("<article>One.<script>var a = '<svg>'</script> Two.<svg>no</svg></article>", "One. Two."),
    ],
)
def test_main_text_without_end_tags(page, text):
    from logbraid.llm.html_extraction import main_text

    assert main_text(page) == text


@pytest.mark.parametrize(
    "inside",
    [
        '<section id="related-work"><h2 id="search-engines">One.</h2><p>Two.</p></section>',
        '<section id="social-impact"><p class="ad-hoc">One.</p></section><p>Two.</p>',
        '<p class="related-work">One.</p><div class="section" id="comments">Two.</div>',
        '<p>One.</p><p class="notice">No.<p>Two.',
        "<p>One.</p><div hidden><p class=ad>No.</div><div>Two.</div>",
        "<ul><li>One.<li class=ad>No.<li>Two.</ul>",
        "<dl><dt>One.<dd class=ad>No.<dt>Two.</dl>",
        "<table><tr><td>One.<td class=ad>No.<tr><td>Two.</table>",
        "<table><tr class=ad><td>No.<td>No.<tr><td>One.<tr><td>Two.</table>",
        "<table><tr><td>One.<tr class=ad><td><table><tr><td>No.<tr><td>No.</table>No.<tr><td>Two.</table>",
        "<p>One.<ul class=social-share><li><ul><li>No.</ul><li>No.</ul><p>Two.",
        "<p>One.<article class=comment-body><p>No.</article><article class='post has-comments'><p>Two.</article>",
        '<p>One.<div class="cookie-notice">No.</div><div class="related-posts">No.</div><div id="sidebar">No.</div>Two.',
    ],
)
def test_names_and_open_elements_inside_an_article(inside):
    from logbraid.llm.html_extraction import main_text

    assert main_text(f"<article>{inside}</article>") == "One. Two."


def test_open_canvases_take_linear_time():
    from logbraid.llm.html_extraction import main_text

    assert len(main_text("<article>" + "<canvas>word" * 50_000)) == 4 * 50_000


BROKEN = {
    "quotes": lambda n: '<p a="' * n, "links": lambda n: '<a b="' * n, "end tags": lambda n: "<div>" * n + "</p>" * n, "quoted ends": lambda n: '<p ">"' * n,
    "two quotes": lambda n: "<p '\">" * n + '"', "scripts": lambda n: "<script>" * n, "comments": lambda n: "<!--" * n + ">", "other end tags": lambda n: "<div>" * n + "</span>" * n,
    "drawings": lambda n: "<svg>" * n + "</svg" * n + ">", "starts": lambda n: "<p " * n + '">"', "attributes": lambda n: "<div " + "class='" * n + ">x",
    "script ends": lambda n: "<script>" + "</script " * n + ">x", "titles": lambda n: "<title>" * n + "x</title>" * n, "lists": lambda n: "<ul><li>" * n + "x",
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_markup_takes_linear_time(kind):
    import time

    from logbraid.llm.html_extraction import main_text

    def seconds(n):
        began = time.perf_counter()
        main_text(BROKEN[kind](n))
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(20_000), seconds(160_000)
    assert large < 24 * max(small, 0.05)  # eight times the page; quadratic time would be 64 times as long


def test_long_pages():
    from logbraid.llm.html_extraction import main_text

    assert len(main_text("<article>" + "<p>word " * 50_000)) == 5 * 50_000 - 1


def test_links_inside_the_main_text_stay():
    from logbraid.llm.html_extraction import main_text

    long, linked = "long text here and more of it " * 9, "all of this paragraph is a link text"
    menu = "<p><a>one</a></p><p><a>two</a></p><p><a>three</a></p>"
    page = f"<div>{menu}<p>{long}</p><h2><a>{linked}</a></h2><p><a>{linked}</a></p><p>{long}</p>{menu}</div>"
    assert main_text(page) == " ".join([long.strip(), linked, linked, long.strip()])


def test_quotes_that_do_not_close():
    from logbraid.llm.html_extraction import main_text

    assert main_text('<article><p>one <b x="a>b">two</b> <i y="z>three</i> <b x="4">four</b></article>') == "one two three four"


def test_surge_and_dive_equal_their_definition():
    from logbraid.llm.html_extraction import WINDOW, _text_lines

    rng = random.Random(5)
    for _ in range(500):
        weights = [rng.choice([0, 0, 1, 5, 40, 90]) for _ in range(rng.randint(0, 25))]
        surge = rng.choice([1, 10, 86])
        window = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
        want = []
        for i in range(len(weights)):
            # A line is inside if, at or before it, a line with text surges, and no window from there to it has dived to zero.
            begins = [b for b in range(i + 1) if weights[b] > 0 and window[b] >= surge]
            want.append(any(all(w > 0 for w in window[b : i + 1]) for b in begins))
        assert _text_lines(weights, surge) == want


def test_extract_text(spark):
    from logbraid.llm.html_extraction import extract_text

    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y"), (2, None, "", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(table).collect()
    assert sorted((r.page_id is None, r.n_chars) for r in got) == sorted([(False, len(got[0].text)), (False, len(got[0].text)), (True, 0), (False, 0)]) or len(got) == 4
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(table.where("false")).collect() == []


def test_articles_of_the_given_pages(spark):
    """The generator puts the article between its tags: nothing else is in the result, and all of it."""
    import html
    import re

    from logbraid.llm.html_extraction import main_text

    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)
        want = " ".join(html.unescape(re.sub(r"<(?:/?(?:p|h1|br|article)|!)[^>]*>", "\n", inner[1]).replace("<b>", "").replace("</b>", "")).split()) if inner else ""
        assert main_text(row.html) == want


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_section_tokens(spark, rule):
    import public_tokenizers
    from tokenizers import Tokenizer

    from logbraid.llm.token_counts import section_tokens

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = sorted((tuple(r) for r in section_tokens(frame(spark), path, public_tokenizers.PATTERN, rule).collect()), key=repr)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text in pairs():
        if not text:
            continue
        raw = text.encode()
        lines = text.splitlines(keepends=True) if all(c not in text for c in "\r\v\f\x1c\x1d\x1e\x85") else None
        lines = [x + "\n" for x in text.split("\n")]
        lines[-1] = lines[-1][:-1]
        lines = [x for x in lines if x]
        ends = np.cumsum([len(x.encode()) for x in lines]).tolist()
        of = [next(i for i, e in enumerate(ends) if b < e) for b in range(len(raw))]
        counts, crossing, at = Counter(), Counter(), 0
        for token in other.encode(text, add_special_tokens=False).tokens:
            own = Counter(of[at : at + len(token)])  # a character of this vocabulary's alphabet is one byte
            first, last = of[at], of[at + len(token) - 1]
            to = {"first": first, "last": last, "most": max(own, key=lambda s: (own[s], -s))}[rule]
            counts[to] += 1
            crossing[to] += first != last
            at += len(token)
        assert at == len(raw)
        begin = 0
        for i, line in enumerate(lines):
            want.append((d, i, begin, begin + len(line), len(line), counts[i], crossing[i]))
            begin += len(line)
    assert got == sorted(want, key=repr)
    assert section_tokens(frame(spark).where("false"), path, public_tokenizers.PATTERN).collect() == []


def test_attribution_rules():
    from logbraid.llm.token_counts import attribute

    tokens, sections = np.array([2, 9, 10]), np.array([4, 5, 10])
    assert [attribute(tokens, sections, rule)[0].tolist() for rule in ("first", "last", "most")] == [[2, 0, 1], [1, 0, 2], [1, 0, 2]]
    assert attribute(tokens, sections, "first")[1].tolist() == [1, 0, 0]


def test_scan_licenses(spark):
    import random

    from texts import sentence

    from logbraid.llm import license_scan as s

    rng = random.Random(5)
    docs = []
    for i in range(150):
        words = sentence(rng, rng.randint(0, 120)).split()
        for name in rng.sample(sorted(s.TEMPLATES), rng.randint(0, 3)):
            own = s.TEMPLATES[name].split()
            if rng.random() < 0.5 and len(own) > 12:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.1 else w for w in own]
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, s.TEMPLATES["MIT"]), (502, s.TEMPLATES["MIT"]), (None, s.TEMPLATES["BSD"]), (503, "word " * 9000 + s.TEMPLATES["GPL-3.0"])]
    rows = [(d, t, "en", "s", 0, 1, 2, "", "", "", "") for d, t in docs]
    known, want = s.Templates(s.TEMPLATES), []
    for d, text in docs:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        hashes, _ = s._shingles(raw, np.array([0, len(raw)]))
        for name, own in zip(known.names, known.sets, strict=True):
            want += [(d, name, *place) for place in s.places(hashes, own, 80)]
    got = [tuple(r) for r in s.scan_licenses(frame(spark, rows)).collect()]
    assert len(want) > 150 and sorted(got, key=repr) == sorted(want, key=repr)
    assert s.scan_licenses(frame(spark).where("false")).collect() == []
    assert s.scan_licenses(frame(spark), {}).collect() == []


def test_many_licenses_of_any_size(spark):
    """Several hundred made-up licences as a table: each is found where it stands, whole or with a few words changed, and nothing else is."""
    from texts import sentence

    from logbraid.llm import license_scan as s

    rng = random.Random(6)
    texts = {f"L{i}": sentence(rng, rng.choice([1, 2, 4, 5, 6, 8, 9, 11, 14, 20, 40, 90, 200, 450, 900])) + f" end{i}" for i in range(400)}
    table = spark.createDataFrame([*texts.items(), ("L0", texts["L0"]), ("L1", "a second text of the first license"), ("null", None)], "license string, text string")
    known = s.templates_of(table)
    assert len(known) == 401 and {known["L1"], known["L1#2"]} == {texts["L1"], "a second text of the first license"}
    templates = s.Templates(known)
    assert len(templates.classes) < 30 and sum(c[2].shape[1] for c in templates.classes) == 401
    docs = []
    for i in range(120):
        words = sentence(rng, rng.randint(0, 300)).split()
        for name in rng.sample(sorted(known), 4):
            own = known[name].split()
            for at in range(50, len(own), 100):
                own[at] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((i, " ".join(words), "en", "s", 0, 1, 2, "", "", "", ""))
    want = []
    for d, text, *_ in docs:
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes, _ = s._shingles(raw, np.array([0, len(raw)]))
        for name, own in zip(templates.names, templates.sets, strict=True):
            want += [(d, name, *place) for place in s.places(hashes, own, 80)]
    got = [tuple(r) for r in s.scan_licenses(frame(spark, docs), table).collect()]
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_a_table_of_too_much_template_text_is_refused(spark, monkeypatch):
    from logbraid.llm import license_scan as s

    monkeypatch.setattr(s, "MAX_TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError, match="10"):
        s.templates_of(spark.createDataFrame([("a", "more than ten bytes")], "license string, text string"))


def test_quality_scores(spark):
    from pyspark.sql import functions as F

    from logbraid.llm.quality_classifier import quality_scores

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_scores(docs, labels, held_out).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97


def test_quality_scores_without_labels(spark):
    from pyspark.sql import functions as F

    from logbraid.llm.quality_classifier import quality_scores

    labels = spark.createDataFrame([(1000, None), (999, 1), (999, 1), (998, 1), (5555, 0)], "doc_id long, quality int")
    rows = quality_scores(frame(spark), labels.where("false"), F.lit(False)).collect()
    assert len(rows) == len(pairs()) and {round(r.score, 6) for r in rows} == {0.495}
    rows = quality_scores(frame(spark), labels, F.col("doc_id") % 5 == 0).collect()
    assert len(rows) == len(pairs()) and all(r.score > 0.9 for r in rows)
    assert quality_scores(frame(spark).where("false"), labels, F.lit(False)).collect() == []


def test_fit_equals_a_direct_solution(spark):
    from logbraid.llm import quality_classifier as q

    rng = np.random.default_rng(4)
    x = rng.normal(0, [1, 50] + [3] * (q.N_STATISTICS - 2), (900, q.N_STATISTICS))
    y = (x[:, 0] + 0.02 * x[:, 1] + rng.normal(0, 0.5, len(x)) > 0).astype(float)
    table = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i long, x array<double>, y double").repartition(5)
    model = q.fit(table.where("i % 3 > 0").select("x", "y"), table.where("i % 3 = 0").select("x", "y"))
    one, two = np.arange(len(x)) % 3 > 0, np.arange(len(x)) % 3 == 0
    assert np.allclose(model.mean, x[one].mean(0)) and np.allclose(model.spread, x[one].std(0))
    z = model.features(x[one])
    penalty = q.RIDGE * one.sum() * np.eye(q.FEATURES + 1)
    penalty[0, 0] = 0
    # The whole matrix at once: least squares with the penalty as further rows.
    whole = np.concatenate([z, np.sqrt(penalty + 1e-9 * np.eye(q.FEATURES + 1))])
    direct = np.linalg.lstsq(whole, np.concatenate([y[one], np.zeros(q.FEATURES + 1)]), rcond=None)[0]
    assert np.abs(z @ (model.weights - direct)).max() < 1e-6
    # Calibration by its definition: the greatest least mean of bins around each bin, on rows that were not fitted.
    at = np.minimum((model.raw(x[two]) * q.BINS).astype(int), q.BINS - 1)
    used = np.unique(at)
    good, weight = np.array([y[two][at == b].sum() for b in used]), np.array([(at == b).sum() for b in used])
    share = [max(min(good[a : b + 1].sum() / weight[a : b + 1].sum() for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    assert np.allclose(model.at, (used + 0.5) / q.BINS) and np.allclose(model.share, share)


def test_bands_are_made_for_eighty_percent(spark):
    from logbraid.llm.license_scan import scan_licenses

    with pytest.raises(ValueError, match="80"):
        scan_licenses(frame(spark), percent=79)


def test_pooling_is_monotone():
    from logbraid.llm.quality_classifier import pool_adjacent

    assert pool_adjacent(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1])).tolist() == [0, pytest.approx(1 / 3), pytest.approx(1 / 3), 1]


def test_runs_of_white_space_of_any_length(spark):
    import public_tokenizers as P

    from logbraid.llm import token_counts as t

    path = P.path("byte_bpe_50k.tiktoken")
    encoding, _ = t._encoding(path, P.PATTERN)
    rng, old = random.Random(2), t._LONG_RUN
    t._LONG_RUN = __import__("re").compile(f"[{t._SPACES}]{{3,}}")
    try:
        for _ in range(3000):
            text = "".join(rng.choice([" ", "  ", "\n", "\u3000", "\x1c", "\xa0", "a", "é", "1", "'s", "!", "   ", " \t"]) for _ in range(rng.randint(0, 14)))
            assert t.encode(encoding, text, P.PATTERN) == encoding.encode_ordinary(text)
    finally:
        t._LONG_RUN = old
    for n in (9_999, 10_000, 50_000):
        text = "x" + " " * n + "y"
        assert t.encode(encoding, text, P.PATTERN) == encoding.encode_ordinary(text)
    docs = spark.createDataFrame([(1, "x" + " " * 1_000_000 + "y"), (2, "\n" * 30 + " " * 1_000_000)], "doc_id long, text string")
    got = t.section_tokens(docs, path, P.PATTERN).groupBy("doc_id").sum("n_chars").collect()
    assert {tuple(r) for r in got} == {(1, 1_000_002), (2, 1_000_030)}
