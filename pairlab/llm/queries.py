"""One query per operator over its whole table, with the SQL it must agree with
where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    collocations,
    credentials,
    decontamination,
    jaccard_join,
    packing,
    prefix_trie,
    quality,
    repeats,
    toxicity,
    url_rules,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(call: Callable[[SparkSession, str], DataFrame]):
        QUERIES[call.__name__] = call
        if sql is not None:
            ORACLES[call.__name__] = sql
        return call

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a tokenizer's vocabulary lies, the byte-level one by default."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )


@query()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary())


URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@query(
    """
    WITH cut AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
      SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM cut
    ), rules(verdict, rule_host, rule_path) AS (VALUES
      ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
      ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
      ('block', 'com', '/de/')
    ), best AS (
      SELECT page_id, arg_max(rule_host || rule_path,
          length(rule_host) * 1000 + length(rule_path)) AS rule,
        arg_max(verdict, length(rule_host) * 1000 + length(rule_path)) AS verdict
      FROM parts JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host))
        AND starts_with(path, rule_path)
      GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN best USING (page_id)
    """
)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


@query(
    r"""
    WITH lines AS (
      SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
            WHERE doc_id IS NOT NULL)
    ), held AS (
      SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))
        AS line FROM lines
    ), windows AS (
      SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b,
        lead(line, 2) OVER w AS c, lead(pos, 2) OVER w AS last
      FROM held WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    ), later AS (
      SELECT doc_id, pos, last, row_number() OVER f AS n,
        first_value(doc_id) OVER f AS first_doc
      FROM windows WHERE c IS NOT NULL
      WINDOW f AS (PARTITION BY a, b, c ORDER BY doc_id, pos)
    ), gone AS (
      SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN later w
        ON l.doc_id = w.doc_id AND l.pos BETWEEN w.pos AND w.last AND w.n > 1
    ), docs AS (
      SELECT doc_id, list_sort(list(DISTINCT first_doc)) AS first_docs
      FROM later WHERE n > 1 GROUP BY doc_id
    ), texts AS (
      SELECT l.doc_id, count(g.pos) AS removed_lines,
        coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10)
          ORDER BY l.pos), '') AS text
      FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
      GROUP BY l.doc_id
    )
    SELECT doc_id, removed_lines, array_to_string(first_docs, ',') AS first_docs,
      text FROM texts JOIN docs USING (doc_id)
    """
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup_lines(read(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "aggregate(spans, 0L, (a, s) -> a + s.end - s.start) AS removed_lines",
        "array_join(transform(first_docs, x -> string(x)), ',') AS first_docs",
        "text",
    )


@query(
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
          lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM documents
    ), grams AS (
      SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d
    ), counted AS (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2])
        AS n FROM grams
    ), repeated AS (
      SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
      FROM counted, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id
    ), base AS (
      SELECT doc_id, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(string_split(text, chr(10))) AS n_lines,
        len(regexp_extract_all(text, '!!')) AS shouts,
        len(regexp_extract_all(text, '\p{L}')) AS letters, length(text) AS n_chars
      FROM d LEFT JOIN repeated USING (doc_id)
    ), failed AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM base
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      base_failed, NOT (base_failed OR 10 * n_symbols > n_words
        OR word_chars < 2 * n_words OR word_chars > 14 * n_words
        OR 100 * n_dup_lines > 30 * n_lines OR 5 * shouts > n_words
        OR 2 * letters < n_chars) AS kept
    FROM failed
    """
)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


@query()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup_sentences(read(spark, sf_dir, "documents"))


@query()
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(read(spark, sf_dir, "documents"))


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )


@query()
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        "urlkey",
        "captured",
    )


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


@query(
    r"""
    WITH pieces AS (
      SELECT doc_id, coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents
    ), said AS (
      SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), grams AS (
      SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2),
        lambda p: array_to_string(w[p:p + k - 1], ' '))) AS phrase
      FROM said, range(1, 6) AS t(k) WHERE len(w) >= k
    ), counts AS (
      SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
      HAVING count(*) >= 100
    ), totals AS (
      SELECT lang, sum(len(w))::HUGEINT AS n FROM said GROUP BY lang
    ), phrases AS (
      SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a
      FROM counts WHERE size > 1
    ), inside AS (
      SELECT DISTINCT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, a
      FROM phrases, range(2, 5) AS t(k), range(1, 5) AS u(s)
      WHERE k < size AND s + k - 1 <= size
    ), kept AS (
      SELECT p.* FROM phrases p ANTI JOIN inside i
        ON p.lang = i.lang AND p.phrase = i.phrase AND i.a >= p.a
    ), cuts AS (
      SELECT p.lang, p.phrase, p.a, n, k, l.f AS l, r.f AS r,
        1000 * p.a::HUGEINT * n // (l.f::HUGEINT * r.f) AS score
      FROM kept p JOIN totals t ON p.lang = t.lang
        JOIN range(1, 5) AS c(k) ON k < size
        JOIN counts l ON l.lang = p.lang AND l.phrase = array_to_string(w[1:k], ' ')
        JOIN counts r ON r.lang = p.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
    ), weakest AS (
      SELECT * FROM cuts
      QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    )
    SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n::BIGINT AS n,
      score::BIGINT AS score
    FROM weakest
    WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
    QUALIFY row_number() OVER o <= 2000
    """
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query(
    r"""
    WITH turns AS (
      SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '')
        || coalesce(text, '')) AS k, strlen(coalesce(text, ''))::BIGINT AS b
      FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
      SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS k,
        list(b ORDER BY turn NULLS FIRST, k) AS b,
        list_reduce(list_prepend(4294967295::BIGINT, list_transform(
          string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) AS crc
      FROM turns GROUP BY conv_id
    ), starts AS (
      SELECT o.conv_id, xor(o.crc, 4294967295) % 9 AS h, o.k, o.b,
        coalesce(s.k, []) AS sk, coalesce(s.b, []) AS sb
      FROM own o LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 5
    ), rebuilt AS (
      SELECT conv_id, list_concat(sk[1:h], k[h + 1:]) AS k,
        list_concat(sb[1:h], b[h + 1:]) AS b FROM starts
    ), members AS (
      SELECT conv_id, k, b, unnest(range(0, len(k) + 1)) AS depth FROM rebuilt
    ), nodes AS (
      SELECT k[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        max(CASE WHEN depth = 0 THEN 0 ELSE b[depth] END) AS n_bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
          FILTER (len(k) = depth), '')) AS ends_sha256
      FROM members GROUP BY ALL
    ), children AS (
      SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0
      GROUP BY ALL
    ), counted AS (
      SELECT nodes.*, coalesce(n, 0) AS n_children
      FROM nodes LEFT JOIN children USING (path)
    ), below AS (
      SELECT path[1:d] AS path, sum((n_children = 0)::INT) AS n_leaves,
        sum((n_convs - 1) * n_bytes) AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY ALL
    )
    SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs,
      c.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
      saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
    FROM counted c JOIN below b ON b.path = c.path
      LEFT JOIN counted p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
    """
)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


@query()
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")
    )
