"""Quality rules, decontamination and URL filters against brute force, and their plans."""
import math
import re
from collections import Counter, defaultdict

import pytest
from texts import frame, pairs, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    places = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(places), n < 20 or 100 * len(places) > 30 * n


def test_quality_counts(spark):
    from logbraid.llm.quality_rules import quality_rules

    rows = quality_rules(frame(spark)).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert sorted(got, key=repr) == sorted(((d, *base_counts(t)) for d, t in pairs()), key=repr)
    assert quality_rules(frame(spark).where("false")).collect() == []


def test_quality_verdict(spark):
    """The distances equal a plain computation, junk is rejected and prose stays."""
    import random

    from logbraid.llm import quality_rules as q

    rng = random.Random(2)
    prose = ["The " + " ".join(rng.choice(["the", "of", "and", "table", "water", "stone", "walk", "is"]) for _ in range(90)) + "." for _ in range(40)]
    junk = [" ".join(w.upper() + "!!" for w in prose[0].split()), " ".join(w + "%%%" for w in prose[1].split())]
    rows = [(i, t, "en" if i % 9 else None, "s", 0, 1, 2, "", "", "", "") for i, t in enumerate(prose + junk)]
    got = {r.doc_id: r for r in q.quality_rules(frame(spark, rows)).collect()}

    def histograms(text):
        spaces, *rest = (len(re.findall(c, text)) for c in (q.SPACE, *q.CLASSES))
        characters = [spaces, *rest]
        words = WORD.findall(text)
        common = [words.count(w) for w in q.COMMON_WORDS]
        return (
            [*characters, len(text) - sum(characters), len(text.encode()) - len(text)],
            [*common, len(words) - sum(common)],
        )

    total = defaultdict(lambda: None)
    for row in rows:
        own = histograms(row[1])
        total[row[2]] = own if total[row[2]] is None else tuple([a + b for a, b in zip(x, y)] for x, y in zip(total[row[2]], own))

    def distance(p, q_):
        p, q_ = [x / sum(p) for x in p], [x / sum(q_) for x in q_]
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0
        return math.sqrt(sum(part(a, b) + part(b, a) for a, b in zip(p, q_)) / 2)

    for row in rows:
        own = histograms(row[1])
        assert got[row[0]].character_distance == pytest.approx(distance(own[0], total[row[2]][0]))
        assert got[row[0]].word_distance == pytest.approx(distance(own[1], total[row[2]][1]))
        assert got[row[0]].kept == (row[0] < len(prose))


def hits(docs, items, span):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for d, t in docs:
        w, taken, found = words(t), set(), set()
        for item, text in items:
            own = words(text)
            k = min(span, len(own))
            windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
            for i in range(len(w) - k + 1):
                if windows and tuple(w[i : i + k]) in windows:
                    taken.update(range(i, i + k))
                    found.add(str(item) if item is not None else None)
        ids = sorted(x for x in found if x is not None)
        out.append((d, len(w), len(taken), len(ids), ",".join(ids)))
    return sorted(out, key=repr)


def test_contamination(spark):
    from logbraid.llm.decontamination import contamination

    docs = pairs()
    text = dict(docs)
    long = text[1000].split("\n")[0]
    items = [
        (1, long), (2, " ".join(text[996].split()[3:16])), (3, " ".join(text[995].split()[:12])), (4, None), (5, ""), (6, "One"),
        (2, " ".join(text[990].split()[:14])), (None, " ".join(text[994].split()[:20])), (10, long.upper() + "!"), (7, "ab ab"), (8, sentence(__import__("random").Random(9), 30)),
    ]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    rows = contamination(frame(spark), table).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids)) for r in rows), key=repr)
    assert got == hits(docs, items, 13)
    none = contamination(frame(spark), table.where("false")).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)
    assert contamination(frame(spark).where("false"), table).collect() == []


def test_every_shared_span_has_a_shared_fingerprint(spark):
    from logbraid.llm.decontamination import _fingerprints

    import random

    rng = random.Random(4)
    rows = []
    for i in range(200):
        shared = [rng.choice("abcdef") for _ in range(13)]
        for side in "xy":
            rows.append((i, side, [rng.choice("ghijk") for _ in range(rng.randint(0, 9))] + shared + [rng.choice("lmnop") for _ in range(rng.randint(0, 9))]))
    frame_ = _fingerprints(spark.createDataFrame(rows, "i long, side string, words array<string>"), 6).select("i", "side", "fingerprints")
    found = defaultdict(dict)
    for r in frame_.collect():
        found[r.i][r.side] = set(r.fingerprints)
    assert all(sides["x"] & sides["y"] for sides in found.values())


URLS = [
    (1, "https://A.Example.org/es/5?x#y", True), (2, "http://example.org/en/12", False), (3, "http://example.org/en/2", True), (4, "http://m.tion.com/fr/1", True),
    (5, "http://com/de/", True), (6, "ftp://host.net", False), (7, None, True), (8, "no scheme/x", False), (9, "", False), (10, "x://", False),
    (11, "http://org?q=/", True), (12, "http://notexample.org/es/1", False), (13, "http://host.net:80/a b#://c", True), (1, "https://a.example.org/es/5", True),
    (14, "http://HOST.NET/É", False), (None, "https://é.com/de/x", False),
]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def judged(urls, listed):
    out = []
    for page, url, _ in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fit = [(len(r), r, a) for a, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule, action = (max(fit)[1], max(fit)[2]) if fit else (None, "block" if host in listed else "allow")
        out.append((page, host, path, rule, host in listed, action))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_judge_urls(spark, monkeypatch, limit):
    from logbraid.llm import url_filters as u

    monkeypatch.setattr(u, "MAX_KEYS", limit)  # three keys per cascade: several cascades
    pages = spark.createDataFrame(URLS, "page_id long, url string, key boolean").withColumn("host", u.F.lit("clash"))
    listed = ["host.net", "a.example.org", "host.net", None, "nowhere.at", "x1", "x2", "x3"]
    table = spark.createDataFrame([(h,) for h in listed], "host string")
    got = sorted((tuple(r) for r in u.judge_urls(pages, table, RULES).collect()), key=repr)
    assert got == judged(URLS, set(listed) - {None})
    assert sorted((tuple(r) for r in u.judge_urls(pages, table.where("false"), RULES).collect()), key=repr) == judged(URLS, set())
    assert u.judge_urls(pages.where("false"), table, RULES).collect() == []


def test_cascade_is_exact(spark):
    """Many keys in filters too small for them: mistakes on every level, none in the result."""
    from logbraid.llm import url_filters as u

    old = u.BITS_PER_KEY
    u.BITS_PER_KEY = 3
    try:
        universe = spark.range(3000).selectExpr("concat('h', id) as key", "id % 3 = 0 as listed")
        levels = u.cascade(universe)
        assert len(levels) > 3
        assert universe.where(u.member(u.F.col("key"), levels) != u.F.col("listed")).isEmpty()
    finally:
        u.BITS_PER_KEY = old


def test_filters_are_bounded_on_every_level(spark, monkeypatch):
    """Few listed hosts and very many others: what passes level 0 by mistake counts for the number of cascades."""
    from logbraid.llm import url_filters as u

    monkeypatch.setattr(u, "MAX_KEYS", 100)
    monkeypatch.setattr(u, "BLOCK", 16)
    sizes, build = [], u._level

    def built(keys, level, shards, count):
        sizes.append(count)
        return build(keys, level, shards, count)

    monkeypatch.setattr(u, "_level", built)
    pages = spark.range(30_000).selectExpr("id as page_id", "concat('http://h', id, '/') as url")
    table = spark.range(90).selectExpr("concat('h', id) as host")
    assert u.judge_urls(pages, table).where("listed != (page_id < 90) or listed != (verdict = 'block')").isEmpty()
    assert len(sizes) > 1 and max(sizes) <= 100


@pytest.mark.parametrize("broadcast", [256 << 20, 0])
def test_cascades_are_exact(spark, monkeypatch, broadcast):
    """Several cascades, of which one has no listed key, in filters too small for them; levels are broadcast or shuffled."""
    from logbraid.llm import url_filters as u

    monkeypatch.setattr(u, "BITS_PER_KEY", 3)
    monkeypatch.setattr(u, "MAX_BROADCAST", broadcast)
    universe = spark.range(3000).selectExpr("concat('h', id) as key", "id % 3 = 0 and id % 7 > 0 as listed", "id % 7 as shard")
    levels = u.cascades(universe, 7)
    assert len(levels) > 3
    twice = universe.union(universe).withColumnRenamed("listed", "truth")
    got = u._member_of(twice, u.F.col("key"), levels, 7)
    assert got.count() == 6000 and got.where("listed is null or listed != truth").isEmpty()


def test_pages_are_read_once_for_any_number_of_cascades(spark, monkeypatch, tmp_path):
    from logbraid.llm import url_filters as u

    monkeypatch.setattr(u, "MAX_KEYS", 100)
    spark.range(3_000).selectExpr("id as page_id", "concat('http://h', id, '/') as url").write.parquet(str(tmp_path / "pages"))
    pages, table = spark.read.parquet(str(tmp_path / "pages")), spark.range(900).selectExpr("concat('h', id) as host")
    df = u.judge_urls(pages, table)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert df.where("listed != (page_id < 900)").isEmpty()


def test_documents_are_read_three_times_for_items_of_all_lengths(spark, monkeypatch, tmp_path):
    from logbraid.llm import decontamination as d

    frame(spark).write.parquet(str(tmp_path / "docs"))
    docs, scans, cut = spark.read.parquet(str(tmp_path / "docs")), [], d.cut

    def counted(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return cut(df)

    monkeypatch.setattr(d, "cut", counted)
    text = dict(pairs())[1000].split()
    items = spark.createDataFrame([(n, " ".join(text[n : 2 * n])) for n in range(1, 16)], "item_id long, text string")
    df = d.contamination(docs, items)
    scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
    assert sum(scans) == 3
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids)) for r in df.collect()), key=repr)
    assert got == hits(pairs(), [tuple(r) for r in items.collect()], 13)


def test_plans_have_no_python(spark):
    from logbraid.llm.decontamination import contamination
    from logbraid.llm.quality_rules import quality_rules
    from logbraid.llm.url_filters import judge_urls

    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    hosts = spark.createDataFrame([("a",)], "host string")
    for df in (contamination(frame(spark), items), quality_rules(frame(spark)), judge_urls(pages, hosts)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
