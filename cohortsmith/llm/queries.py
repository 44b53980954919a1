"""One registered query per operator, over whole tables, and the SQL that checks it."""

from __future__ import annotations


from pyspark.sql import functions as F

from cohortsmith.llm import (
    exact_dedup,
    html_text,
    language,
    license_scan,
    mixing,
    packing,
    quality,
    ranked_search,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
    vector_codes,
)
from cohortsmith.llm.tables import register, table

TOKENIZER = "word_bpe_49k.json"
TOXIC = 0.5


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op3_mix_sources")
def op3_mix_sources(spark, folder):
    """Pareto order sampling is random by hash; a brute-force test checks it."""
    mixed = mixing.sample_copies(table(spark, folder, "documents"), appeal=mixing.substance)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@register(
    "op5_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id,
      CAST(count(*) OVER same AS BIGINT) AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    WINDOW same AS (PARTITION BY text)
    """,
)
def op5_exact_dedup(spark, folder):
    return exact_dedup.mark_copies(table(spark, folder, "documents"))


@register("op10_pack_windows")
def op10_pack_windows(spark, folder):
    """No SQL: a test compares ids with the tokenizer library and checks every place."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def toxicity_chain(docs, labels):
    """The chain of the labelled columns: poor quality first, then toxic."""
    return toxicity.fit(docs, labels, {
        "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1,
    })


@register("op4_toxicity")
def op4_toxicity(spark, folder):
    """A trained model has no SQL; a test measures it on labels it did not see."""
    docs = table(spark, folder, "documents")
    chain = toxicity_chain(docs, table(spark, folder, "labels"))
    scored = toxicity.classify(docs, chain)
    return scored.withColumn("toxic", F.col("p_toxic") >= TOXIC)


@register("op8_simhash")
def op8_simhash(spark, folder):
    """SQL would compare all pairs; a test does so on a fixture."""
    return simhash.near_copies(table(spark, folder, "documents"))


_FURNITURE = " OR ".join(
    f"contains(lower(line), '{phrase}')" for phrase in quality.BOILERPLATE
)
_CLOSING = quality.CLOSING.replace("'", "''")


@register(
    "op7_quality_rules",
    rf"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ),
    windows AS (
      SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
    ),
    repeated AS (
      SELECT doc_id, i FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows)
      WHERE n > 1
    ),
    covered AS (
      SELECT doc_id, count(*) AS n_repeat_words FROM (
        SELECT doc_id, i FROM repeated UNION SELECT doc_id, i + 1 FROM repeated
        UNION SELECT doc_id, i + 2 FROM repeated)
      GROUP BY doc_id
    ),
    split_lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
    lines AS (
      SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
        length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
        len(regexp_extract_all(line, '[|»•·>]')) AS separators,
        len(regexp_extract_all(line, '!!')) AS shouts,
        NOT contains('{_CLOSING}',
          right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1)) AS open_end,
        ({_FURNITURE}) AS furniture
      FROM split_lines
    ),
    per_doc AS (
      SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
        sum(CASE WHEN symbols * 100 > {quality.MAX_SYMBOLS} * n
          OR separators * 100 > {quality.MAX_SEPARATORS} * n
          OR shouts * 100 > {quality.MAX_SHOUTS} * n OR furniture
          OR (n <= {quality.SHORT_LINE} AND open_end) THEN n ELSE 0 END) AS words_removed,
        sum(CASE WHEN symbols * 100 > {quality.MAX_SYMBOLS} * n
          OR separators * 100 > {quality.MAX_SEPARATORS} * n
          OR shouts * 100 > {quality.MAX_SHOUTS} * n OR furniture
          OR (n <= {quality.SHORT_LINE} AND open_end) THEN 1 ELSE 0 END) AS n_lines_removed
      FROM lines WHERE n > 0 GROUP BY doc_id
    ),
    counted AS (
      SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
          '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed,
        CAST(coalesce(words_removed, 0) AS BIGINT) AS words_removed
      FROM d LEFT JOIN per_doc ON d.doc_id = per_doc.doc_id
        LEFT JOIN covered ON d.doc_id = covered.doc_id
    ),
    based AS (
      SELECT *, n_words < {quality.MIN_WORDS}
        OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed
      FROM counted
    )
    SELECT *, NOT base_failed
      AND 100 * words_removed <= {quality.MAX_LOST} * n_words AS kept
    FROM based
    """,
)
def op7_quality_rules(spark, folder):
    return quality.judge(table(spark, folder, "documents")).drop("clean_text")


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


@register("op1_language_id")
def op1_language_id(spark, folder):
    """A trained model has no SQL; a test measures it on the held-out fifth."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(~_held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


def list_events(pages):
    """Dated entries for the domains of the pages, drawn from a hash of the name.

    A quarter of the domains, and those with a tell-tale name, are on a block list
    that adds, removes and adds them again; an eighth is on an allow list by host.
    """
    start = F.lit("2024-01-01").cast("date")

    def number(name, first, digits, below):
        part = F.substring(F.md5(F.col(name).cast("binary")), first, digits)
        return F.conv(part, 16, 10).cast("int") % below

    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''")
    hosts = hosts.distinct()
    domains = hosts.select(
        F.regexp_replace("host", r"^(www|m|blog)\.", "").alias("domain")
    ).distinct()
    added = number("domain", 1, 4, 300)
    removed = added + 1 + number("domain", 5, 4, 60)
    again = removed + 1 + number("domain", 9, 4, 90)
    listed = F.col("domain").rlike("spam|casino|pills") | (number("domain", 13, 2, 256) < 64)
    blocked = domains.where(listed).select(
        F.lit("block").alias("list"), F.lit(True).alias("blocks"), "domain",
        F.explode(F.array(
            F.struct(F.lit(True).alias("added"), F.date_add(start, added).alias("day")),
            F.struct(F.lit(False).alias("added"), F.date_add(start, removed).alias("day")),
            F.struct(F.lit(True).alias("added"), F.date_add(start, again).alias("day")),
        )).alias("event"),
    ).select("list", "blocks", "domain", "event.added", "event.day")
    allowed = hosts.where(number("host", 15, 2, 256) < 32).select(
        F.lit("allow").alias("list"), F.lit(False).alias("blocks"),
        F.col("host").alias("domain"), F.lit(True).alias("added"),
        F.date_add(start, number("host", 1, 4, 200)).alias("day"),
    )
    return blocked.unionByName(allowed)


_URL_HOST = r"""regexp_replace(lower(regexp_extract(coalesce(url, ''),
        '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '[.]+$', '')"""


def _hashed(name, first, digits, below):
    return f"(CAST('0x' || substr(md5({name}), {first}, {digits}) AS BIGINT) % {below})"


@register(
    "op6_url_filter",
    f"""
    WITH seen AS (
      SELECT page_id, url, {_URL_HOST} AS host,
        DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched FROM pages
    ),
    hosts AS (SELECT DISTINCT host FROM seen WHERE host <> ''),
    names AS (
      SELECT DISTINCT regexp_replace(host, '^(www|m|blog)[.]', '') AS domain FROM hosts
    ),
    days AS (
      SELECT domain, CAST({_hashed("domain", 1, 4, 300)} AS INTEGER) AS a,
        CAST({_hashed("domain", 5, 4, 60)} AS INTEGER) + 1 AS b,
        CAST({_hashed("domain", 9, 4, 90)} AS INTEGER) + 1 AS c
      FROM names WHERE regexp_matches(domain, 'spam|casino|pills')
        OR {_hashed("domain", 13, 2, 256)} < 64
    ),
    intervals AS (
      SELECT 'block' AS list, TRUE AS blocks, domain, DATE '2024-01-01' + a AS valid_from,
        DATE '2024-01-01' + (a + b) AS valid_to FROM days
      UNION ALL
      SELECT 'block', TRUE, domain, DATE '2024-01-01' + (a + b + c), CAST(NULL AS DATE)
      FROM days
      UNION ALL
      SELECT 'allow', FALSE, host,
        DATE '2024-01-01' + CAST({_hashed("host", 1, 4, 200)} AS INTEGER),
        CAST(NULL AS DATE)
      FROM hosts WHERE {_hashed("host", 15, 2, 256)} < 32
    ),
    active AS (
      SELECT page_id, list, blocks, domain, valid_from,
        len(string_split(domain, '.')) AS labels
      FROM seen JOIN intervals ON (host = domain OR ends_with(host, '.' || domain))
        AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)
    ),
    decided AS (
      SELECT *, count(*) OVER (PARTITION BY page_id) AS n_active,
        row_number() OVER (PARTITION BY page_id
          ORDER BY labels DESC, blocks DESC, valid_from, list DESC, domain DESC) AS place
      FROM active
    )
    SELECT seen.page_id, url, host, fetched,
      CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, domain AS decided_by, list,
      valid_from AS listed_since, coalesce(blocks, FALSE) AS blocked
    FROM seen LEFT JOIN decided ON seen.page_id = decided.page_id AND place = 1
    """,
)
def op6_url_filter(spark, folder):
    pages = table(spark, folder, "pages")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url").withColumn(
        "fetched", F.date_add(start, (F.col("page_id") % 365).cast("int"))
    )
    return url_filter.evaluate(captures, list_events(pages))


@register("op2_html_text")
def op2_html_text(spark, folder):
    """HTML parsing has no SQL; tests hold the layout against written-out pages."""
    return html_text.extract(table(spark, folder, "pages"))


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark, folder):
    """SQL would need a row per byte; a test compares with brute force."""
    left = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return left.select(
        "doc_id", "n_bytes", "n_removed", "n_spans",
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def _wording(nodes) -> str:
    """A template as a regular expression over words that each end in a space."""
    out = ""
    for node in nodes:
        if isinstance(node, license_scan.Word):
            out += f"{node.text} "
        elif isinstance(node, license_scan.Optional):
            out += f"(?:{_wording(node.inner)})?"
        else:
            out += f"(?:{node.match or '[^ ]+'} ){{{node.low},{node.high}}}"
    return out


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, ws, "
    f"unnest(range(len(ws))) AS i FROM d) WHERE "
    + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
    for phrase, label in license_scan.PHRASES.items()
)
_ACCEPTED = " UNION ".join(
    f"SELECT doc_id, '{label}' AS label FROM d "
    f"WHERE regexp_matches(plain, ' {_wording(license_scan.parse(markup))}')"
    for label, markup in license_scan.TEMPLATES
)


@register(
    "op11_license_scan",
    rf"""
    WITH d AS MATERIALIZED (
      SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS plain FROM (
        SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)
    ),
    places AS ({_PHRASES}),
    base AS (
      SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM places GROUP BY doc_id
    ),
    accepted AS MATERIALIZED ({_ACCEPTED}),
    named AS (
      SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
        SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM accepted)
      GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
      first_word, last_word, coalesce(base_labels, '') AS base_labels,
      coalesce(labels, '') AS labels,
      CAST(CASE WHEN a.doc_id IS NOT NULL THEN {license_scan.SURE}
        WHEN n_base > 0 THEN {license_scan.HINT} ELSE 0 END AS DOUBLE) AS score
    FROM d LEFT JOIN base ON d.doc_id = base.doc_id
      LEFT JOIN named ON d.doc_id = named.doc_id
      LEFT JOIN (SELECT DISTINCT doc_id FROM accepted) a ON d.doc_id = a.doc_id
    """,
)
def op11_license_scan(spark, folder):
    return license_scan.digest(license_scan.scan(table(spark, folder, "documents")))


_TERMS = (
    r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@register(
    "op12_ranked_search",
    f"""
    WITH d AS (SELECT doc_id, {_TERMS.format(_LOWER.format("coalesce(text, '')"))} AS ws
      FROM documents),
    stats AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n_docs,
        CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
    wanted AS (
      SELECT item_id, term, count(*) AS repeats FROM (
        SELECT item_id, unnest({_TERMS.format(_LOWER.format("text"))}) AS term
        FROM benchmark)
      GROUP BY ALL
    ),
    posted AS (
      SELECT doc_id, term, n, count(*) AS tf FROM (
        SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
      WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
    ),
    weighed AS (
      SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE
        / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM posted, stats GROUP BY term
    ),
    scored AS (
      SELECT item_id, doc_id, CAST(sum(repeats * w * (1000000000 * tf
        // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms)))) AS BIGINT) AS score
      FROM wanted JOIN posted USING (term) JOIN weighed USING (term), stats
      GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM scored WHERE score > 0)
    WHERE rank <= {ranked_search.TOP}
    """,
)
def op12_ranked_search(spark, folder):
    return ranked_search.rank(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def _codebook_rounds() -> str:
    out = """
    e0 AS MATERIALIZED (
      SELECT part, entry, place, x AS c FROM points JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept)
        USING (vec_id) WHERE entry < 256)"""
    for k in range(vector_codes.ROUNDS + 1):
        out += f""",
    a{k} AS MATERIALIZED (
      SELECT vec_id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d
        FROM points JOIN e{k} USING (part, place) GROUP BY ALL)
      GROUP BY vec_id, part)"""
        if k < vector_codes.ROUNDS:
            out += f""",
    e{k + 1} AS MATERIALIZED (
      SELECT part, entry, place, coalesce((s - (s % n + n) % n) // n, c) AS c
      FROM e{k} LEFT JOIN (
        SELECT part, entry, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
        FROM a{k} JOIN points USING (vec_id, part) GROUP BY ALL)
        USING (part, entry, place))"""
    return out


@register(
    "op13_vector_codes",
    f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding,
        lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    points AS MATERIALIZED (
      SELECT vec_id, i // (len(v) // 4) AS part, i % (len(v) // 4) AS place, v[i + 1] AS x
      FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)
    ),
    {_codebook_rounds()},
    coded AS (
      SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code,
        CAST(sum(d) AS BIGINT) AS error
      FROM a{vector_codes.ROUNDS} GROUP BY vec_id
    ),
    books AS (
      SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) AS sha
      FROM e{vector_codes.ROUNDS}
    )
    SELECT vec_id, code, error,
      CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      sha AS codebooks_sha256
    FROM kept JOIN coded USING (vec_id), books
    """,
)
def op13_vector_codes(spark, folder):
    return vector_codes.compress(table(spark, folder, "embeddings"))
