"""The operators of this folder as registered queries over the given tables, with SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.packing import pack_documents

    packed = pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.drop("ids")


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_ngram_join",
    rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
    SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
    SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.ngram_join import similarity_classes

    return similarity_classes(read(spark, sf_dir, "documents"), k=4, percent=85)


#: The operators' contract fixes these rules.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Hosts with a page that holds this are listed.
JUNK = "***"

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
_FITTING = ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in URL_RULES)


@query(
    "op3_url_filters",
    f"""
WITH p AS (SELECT page_id, html, {_HOST} AS host, {_PATH} AS path FROM pages),
listed AS (SELECT DISTINCT host FROM p WHERE contains(html, '{JUNK}')),
rules(action, rule, rule_host, rule_path) AS (VALUES {_FITTING}),
fit AS (
    SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
    FROM (SELECT DISTINCT host, path FROM p), rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, listed.host IS NOT NULL AS listed,
    coalesce(action, CASE WHEN listed.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path LEFT JOIN listed ON p.host = listed.host
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.url_filters import host_of, judge_urls

    pages = read(spark, sf_dir, "pages")
    listed = pages.where(F.contains("html", F.lit(JUNK))).select(host_of(F.col("url")).alias("host")).distinct()
    return judge_urls(pages.select("page_id", "url"), listed, URL_RULES)


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.html_extraction import extract_text

    return extract_text(read(spark, sf_dir, "pages"))


def _quality_sql() -> str:
    from logbraid.llm.quality_rules import CHARACTER_LIMIT, CLASSES, COMMON_WORDS, MIN_WORDS, SYMBOLS, WORD_LIMIT

    found = lambda c: "len(regexp_extract_all(t, '" + c.replace("'", "''") + "'))"
    classes = [r"[\x20\x09-\x0D]", *CLASSES]
    rest = " - ".join(["length(t)", *map(found, classes)])
    characters = ", ".join([*map(found, classes), rest, "strlen(t) - length(t)"])
    common = ", ".join(f"len(list_filter(w, lambda x: x = '{word}'))" for word in COMMON_WORDS)
    limit = lambda pair: f"{pair[0]} + {pair[1]} / sqrt(greatest(n_words, 1))"
    return rf"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS language, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
grams AS (
    SELECT doc_id, unnest(range(0, len(w) - 7)) AS place, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram
    FROM d WHERE len(w) >= 8),
twice AS (SELECT doc_id, place FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(place, place + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
histograms AS (SELECT doc_id, language, [{characters}] AS characters, [{common}] AS common, len(w) AS n FROM d),
bins AS (
    SELECT doc_id, language, 'c' AS kind, unnest(characters) AS n, unnest(range(len(characters))) AS i FROM histograms
    UNION ALL
    SELECT doc_id, language, 'w', unnest(list_append(common, n - list_sum(common))), unnest(range(len(common) + 1)) FROM histograms),
shares AS (
    SELECT doc_id, kind, n / greatest(sum(n) OVER (PARTITION BY doc_id, kind), 1) AS p,
        sum(n) OVER (PARTITION BY language, kind, i) / greatest(sum(n) OVER (PARTITION BY language, kind), 1) AS q
    FROM bins),
distances AS (
    SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS x
    FROM shares GROUP BY doc_id, kind),
counted AS (
    SELECT doc_id, len(w) AS n_words, length(t) - {found(classes[0])} AS word_chars, {found(SYMBOLS)} AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT j.*, NOT base_failed AND (n_words < {MIN_WORDS} OR c.x <= {limit(CHARACTER_LIMIT)} AND w.x <= {limit(WORD_LIMIT)}) AS kept
FROM judged j JOIN distances c ON c.doc_id = j.doc_id AND c.kind = 'c' JOIN distances w ON w.doc_id = j.doc_id AND w.kind = 'w'
"""


@query("op5_quality_rules", _quality_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).drop("character_distance", "word_distance", "text_key")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GRAMS = "list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))"


@query(
    "op6_benchmark_decontamination",
    f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
spans AS (SELECT DISTINCT item_id, k, unnest({_GRAMS}) AS gram FROM b),
grams AS (
    SELECT doc_id, k, unnest({_GRAMS}) AS gram, unnest(range(0, len(w) - k + 1)) AS place
    FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
hits AS (SELECT doc_id, place, k, item_id FROM grams JOIN spans USING (k, gram)),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + k)) AS word FROM hits) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.decontamination import contamination

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.quality_classifier import quality_scores

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logbraid.llm.token_counts import section_tokens

    return section_tokens(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op13_warc",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31 AS INT), 1)), '') AS payload_digest
    FROM p),
first AS (SELECT payload_digest, max(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN first USING (payload_digest)
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.warc import round_trip

    return round_trip(read(spark, sf_dir, "pages")).drop("intact")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    "op11_ranked_search",
    f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
sums AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
found AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, sums GROUP BY term, n_docs),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM wanted JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), sums GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 50
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.lexical_search import build_index, search

    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), 50)


#: crc32 of the decimal doc_id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


@query(
    "op12_periodic_runs",
    rf"""
WITH d AS (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT doc_id, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS tail, len(w) AS n, w, (h // 10) % greatest(len(w), 1) AS a FROM d),
r AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
words AS (
    SELECT doc_id, i, CASE WHEN tail AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
    FROM (SELECT *, unnest(range(0, n)) AS i FROM r)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same),
stretches AS (
    SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(12, 2 * p)),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM stretches GROUP BY doc_id, start, length),
lists AS (
    SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
        first(period ORDER BY length DESC, start, period) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
    FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN texts USING (doc_id)
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logbraid.llm.periodic_runs import periodic_runs

    found = periodic_runs(with_periodic_tails(read(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The contract's input: in a tenth of the documents, by crc32 of the id, the words from one on repeat with a period. A null id changes nothing."""
    from logbraid.llm.native_words import split_words

    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, split_words(F.col("text"), r"[\x20\x09-\x0D]+")).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("long")
    docs = docs.withColumn("a", F.col("g") % F.greatest(n, F.lit(1)))
    docs = docs.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int(ceil((size(w) - a) / p)))), 1, int(size(w) - a))")
    return docs.select("doc_id", F.when(n > 0, F.concat_ws(" ", F.expr("slice(w, 1, int(a))"), tail)).otherwise(F.col("text")).alias("text"))
