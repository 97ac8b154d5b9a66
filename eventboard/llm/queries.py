"""Registered queries of the operators, each over its whole tables, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.llm import align, chat, contamination, gnat, near, pieces, pii, quality, secrets, shards, substrings, toxicity, urls

SHARDS = 40


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = "<|im_end|><|im_start|>assistant ok"
    fixed = spark.sql(
        f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{mark}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{mark}'"
    )
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.unionByName(fixed)))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(_read(spark, sf_dir, "documents"), substrings.PASSAGE_WORDS)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.containments(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: What the corpus itself tells about a finding: issued key formats and assigned credentials are secrets, plain
#: numbers and plain words are not; everything else is unlabelled and left to the forest.
FINDING_LABEL = """
    CASE WHEN candidate RLIKE '^AKIA[A-Z0-9]{16}$' THEN 1
         WHEN candidate RLIKE '^[0-9-]+$' OR candidate RLIKE '^[A-Za-z/_-]+$' THEN 0
         WHEN assigned = 1 AND telling_word = 1 AND candidate RLIKE '[0-9]' THEN 1 END"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"), F.col("source"), F.expr(FINDING_LABEL))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_read(spark, sf_dir, "documents"), SHARDS)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_read(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(_read(spark, sf_dir, "documents"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl of ``pages``; the fetch date follows from the page."""
    return _read(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id * 37, 360) AS int))").alias("fetched_on")
    )


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for three fifths of the domains that occur: listed, taken off again, listed again."""
    domains = (
        pages.select(urls.host_of(F.col("url")).alias("host"))
        .filter("host IS NOT NULL")
        .distinct()
        .select(F.explode(urls.domains_of(F.col("host"))).alias("domain"))
        .filter("instr(domain, '.') > 0")
        .distinct()
    )
    digit = "cast(conv(substr(md5(domain), {}, 4), 16, 10) AS int)"
    entry = "struct('{}' AS action, date_add(DATE'2024-01-01', {} % 360) AS listed_on)"
    listed = F.expr(
        f"slice(array({entry.format('block', digit.format(5))}, {entry.format('allow', digit.format(9))}, "
        f"{entry.format('block', digit.format(13))}), 1, greatest(0, least(3, {digit.format(1)} % 5 - 1)))"
    )
    return domains.select("domain", F.explode(listed).alias("e")).select("domain", "e.action", "e.listed_on")


def op10_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(captures(spark, sf_dir), list_entries(_read(spark, sf_dir, "pages")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = _read(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor")
    )
    return gnat.mine(rows)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_llr,
        op2_chat_windows,
        op3_repeated_substrings,
        op4_pieces,
        op5_contamination,
        op6_secrets,
        op7_shards,
        op8_pii,
        op9_near_duplicates,
        op10_url_list,
        op11_toxicity,
        op12_hard_negatives,
        op13_token_alignment,
    )
}

_SHINGLES = r"""
    SELECT {id}, unnest(list_distinct(CASE WHEN len(w) >= 5
             THEN list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
    FROM (SELECT {id}, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM {table})"""

_LOWER_ASCII = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_chat_windows": rf"""
    WITH RECURSIVE given AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
      UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    t AS (
      SELECT *, row_number() OVER o AS k, sum(cost) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
      FROM (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\x09-\x0D\x20]')) + 3 AS cost,
                   length(url_encode(role)) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars FROM given)
      WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
    c AS (
      SELECT conv_id, count(*) AS n, CAST(coalesce(bool_or(k = 1 AND role = 'system'), false) AS INT) AS s,
             coalesce(max(CASE WHEN k = 1 AND role = 'system' THEN cost END), 0) AS s_cost,
             coalesce(max(CASE WHEN k = 1 AND role = 'system' THEN chars END), 0) AS s_chars
      FROM t GROUP BY conv_id),
    r AS (
      SELECT t.conv_id, t.k, 0 AS w, t.k AS b, t.upto - t.cost AS base FROM t JOIN c USING (conv_id) WHERE t.k = c.s + 1
      UNION ALL
      SELECT t.conv_id, t.k,
             CASE WHEN over_ THEN r.w + 1 ELSE r.w END, CASE WHEN over_ THEN t.k ELSE r.b END,
             CASE WHEN over_ THEN t.upto - t.cost ELSE r.base END
      FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1 JOIN c ON c.conv_id = r.conv_id,
           LATERAL (SELECT t.upto - r.base > {chat.BUDGET} - c.s_cost - CASE WHEN r.w > 0 THEN {chat.HISTORY_TOKENS} ELSE 0 END AS over_)),
    b AS (SELECT DISTINCT conv_id, w, b, base FROM r),
    again AS (
      SELECT b.conv_id, sum(t.chars) AS chars
      FROM b JOIN c USING (conv_id) JOIN t ON t.conv_id = b.conv_id AND t.k < b.b AND t.k >= b.b - {chat.HISTORY_TURNS} AND t.k > c.s
      WHERE b.w > 0 AND b.base - t.upto + t.cost <= {chat.HISTORY_TOKENS} GROUP BY b.conv_id),
    n AS (SELECT conv_id, max(w) + 1 AS windows FROM b GROUP BY conv_id),
    d AS (
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss, sum(chars) AS chars
      FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
           CAST(d.chars + (coalesce(windows, 1) - 1) * c.s_chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars,
           CAST(coalesce(windows, 1) AS BIGINT) AS n_windows
    FROM d JOIN c USING (conv_id) LEFT JOIN n USING (conv_id) LEFT JOIN again USING (conv_id)""",
    "op5_contamination": rf"""
    WITH i AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
    -- Items of fewer than five words are looked for among all windows of their own length.
    short AS (SELECT DISTINCT len(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS k FROM benchmark WHERE len(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) BETWEEN 1 AND 4),
    v AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
    d AS ({_SHINGLES.format(id="doc_id", table="documents")}
      UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) FROM v, short WHERE len(w) >= k),
    n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS n_shared, n_item
    FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item""",
    "op9_near_duplicates": f"""
    WITH RECURSIVE d AS ({_SHINGLES.format(id="doc_id", table="documents").replace("lower(text)", _LOWER_ASCII)}),
    n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    -- Equal texts first: one of them stands for all in the join of shingles.
    c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS node FROM documents WHERE doc_id IN (SELECT doc_id FROM n)),
    r AS (SELECT d.* FROM d WHERE doc_id IN (SELECT node FROM c)),
    l AS (
      SELECT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
      HAVING 100 * count(*) >= 75 * (first((SELECT n FROM n WHERE n.doc_id = x.doc_id)) + first((SELECT n FROM n WHERE n.doc_id = y.doc_id)) - count(*))),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    w AS (SELECT DISTINCT node AS v, node AS o FROM c UNION SELECT e.b, w.o FROM w JOIN e ON e.a = w.v),
    m AS (SELECT v, min(o) AS component_id FROM w GROUP BY v)
    SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, t.doc_id) AS component_id,
           coalesce(m.component_id, t.doc_id) = t.doc_id AS kept
    FROM documents t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.v = c.node""",
    "op10_url_list": rf"""
    WITH p AS (
      SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') AS host,
             DATE '2024-01-01' + CAST((page_id * 37) % 360 AS INT) AS fetched_on FROM pages),
    h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL),
    a AS (SELECT host, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.'))) AS domain FROM h),
    x AS (
      SELECT domain, ('0x' || substr(md5(domain), 1, 4))::INT % 5 - 1 AS n, ('0x' || substr(md5(domain), 5, 4))::INT % 360 AS d1,
             ('0x' || substr(md5(domain), 9, 4))::INT % 360 AS d2, ('0x' || substr(md5(domain), 13, 4))::INT % 360 AS d3
      FROM (SELECT DISTINCT domain FROM a WHERE contains(domain, '.'))),
    e AS (
      SELECT domain, max(action) AS action, listed_on FROM (
        SELECT domain, 'block' AS action, DATE '2024-01-01' + d1 AS listed_on FROM x WHERE n >= 1
        UNION ALL SELECT domain, 'allow', DATE '2024-01-01' + d2 FROM x WHERE n >= 2
        UNION ALL SELECT domain, 'block', DATE '2024-01-01' + d3 FROM x WHERE n >= 3) GROUP BY domain, listed_on),
    v AS (SELECT *, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS ends FROM e),
    m AS (
      SELECT p.page_id, v.domain, v.action, v.listed_on
      FROM p JOIN a USING (host) JOIN v ON v.domain = a.domain AND v.listed_on <= p.fetched_on AND (v.ends IS NULL OR p.fetched_on < v.ends)
      QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.domain) DESC) = 1)
    SELECT p.page_id, p.host, p.fetched_on, m.domain AS matched, m.action, m.listed_on, coalesce(m.action, '') <> 'block' AS kept
    FROM p LEFT JOIN m USING (page_id)""",
    "op12_hard_negatives": """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
      FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
      SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
