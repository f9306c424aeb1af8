"""The registered queries of the training-data operators, with their DuckDB equivalents where SQL has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, budget_mix, decontaminate, disclosure, html_wrapper, line_quality, near_dedup, repeated_spans, sharding, token_align, token_pack, toxicity, url_filter
from .common import small_batches, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.page_outcomes(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repeated_spans.digest(table(spark, sf_dir, "documents"))


def op7_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_pack.round_trip(table(spark, sf_dir, "documents"))


def op8_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_wrapper.main_text(table(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.cluster(table(spark, sf_dir, "documents"))


def op10_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return budget_mix.mix(table(spark, sf_dir, "documents"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_align.alignment(table(spark, sf_dir, "documents"))


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return disclosure.detect(table(spark, sf_dir, "documents"))


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_url_filter, op3_toxicity, op4_line_quality, op5_decontaminate, op6_repeated_spans, op7_token_pack, op8_html_wrapper, op9_near_dedup, op10_budget_mix, op11_token_align, op12_disclosure, op13_ball_tree)}


def _sharding_sql() -> str:
    """Fills the table by turns, one claim a step, and places the documents."""
    slots = sharding.next_prime(sharding.SHARDS * sharding.SLOTS_PER_SHARD)
    number = lambda text, at: f"CAST('0x' || substr(md5({text}), {at}, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE n AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({sharding.SHARDS}) r(i)),
s AS (SELECT i, {number("name", 1)} % {slots} AS offset_, {number("name", 16)} % {slots - 1} + 1 AS skip FROM n),
f AS (
  SELECT 0 AS turn, bitstring('0', {slots}) AS taken, CAST(-1 AS BIGINT) AS slot
  UNION ALL
  SELECT turn + 1, set_bit(taken, CAST(claimed AS INTEGER), 1), claimed
  FROM (
    SELECT turn, taken, (offset_ + (list_position(list_transform(range({slots}), lambda k: get_bit(taken, CAST((offset_ + k * skip) % {slots} AS INTEGER))), 0) - 1) * skip) % {slots} AS claimed
    FROM f JOIN s ON s.i = turn % {sharding.SHARDS} WHERE turn < {slots}
  )
),
d AS (SELECT *, {number("coalesce(CAST(doc_id AS VARCHAR), '')", 1)} % {slots} AS slot FROM documents)
SELECT d.*, 'shard-' || lpad(CAST((turn - 1) % {sharding.SHARDS} AS VARCHAR), 3, '0') AS shard FROM d JOIN f USING (slot)"""


_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shrunk_sql(name: str, groups: str, parent: str) -> str:
    """A level of the reputation: the strength of its prior, then each group's posterior mean."""
    return f"""
{name}_level AS (
  SELECT coalesce(greatest({url_filter.MIN_STRENGTH}, least({url_filter.MAX_STRENGTH}, CASE WHEN rho > 0 THEN 1 / rho - 1 END)), {url_filter.MAX_STRENGTH}) AS strength FROM (
    SELECT CASE WHEN sum((n - 1) * {parent} * (1 - {parent})) > 0
      THEN greatest((sum(n * (bad / n - {parent}) * (bad / n - {parent})) - sum({parent} * (1 - {parent}))) / sum((n - 1) * {parent} * (1 - {parent})), 0.0) ELSE 0.0 END AS rho
    FROM {groups} WHERE n > 0)
),
{name}_post AS (SELECT g.*, strength AS {name}_strength, (bad + strength * {parent}) / (n + strength) AS {name}_mean FROM {groups} g, {name}_level)"""


def _url_filter_sql() -> str:
    two = ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES)
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        at, slash, rest = rule.partition("/")
        return f"(host = '{at}' OR ends_with(host, '.{at}'))" + (f" AND starts_with(path, '{slash}{rest}')" if slash else "")

    chain = lambda value: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{value(r)}'" for r in rules) + " END"
    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UP}', '{_DOWN}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
o AS (SELECT doc_id AS page_id, CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS DOUBLE) AS bad FROM labels),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0.0) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
named AS (
  SELECT h.*, two IN ({two}) AS double_suffix, two, regexp_extract(host, '[^.]*$') AS last, regexp_extract(host, '(?:[^.]*[.]){{0,2}}[^.]*$') AS three
  FROM (SELECT *, regexp_extract(host, '(?:[^.]*[.])?[^.]*$') AS two FROM h) h
),
hosts AS (SELECT host, n, bad, CASE WHEN double_suffix THEN three ELSE two END AS domain, CASE WHEN double_suffix THEN two ELSE last END AS suffix FROM named),
corpus AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0) AS corpus_mean FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, corpus_mean FROM hosts, corpus GROUP BY suffix, corpus_mean),
{_shrunk_sql("suffix", "suffixes", "corpus_mean")},
domains AS (SELECT domain, suffix, sum(h.n) AS n, sum(h.bad) AS bad, suffix_mean FROM hosts h JOIN suffix_post s USING (suffix) GROUP BY domain, suffix, suffix_mean),
{_shrunk_sql("domain", "domains", "suffix_mean")},
joined AS (SELECT h.*, domain_mean FROM hosts h JOIN domain_post d USING (domain)),
{_shrunk_sql("host", "joined", "domain_mean")},
known AS (SELECT host, host_mean, CASE WHEN host_mean - {url_filter.Z} * sqrt(host_mean * (1 - host_mean) / (n + host_strength + 1)) > {url_filter.CUTOFF} THEN 'block' ELSE 'allow' END AS reputation FROM host_post)
SELECT page_id, host, path, {chain(lambda r: r[1])} AS rule, coalesce({chain(lambda r: r[0])}, reputation) AS verdict, round(host_mean, 6) AS bad_rate
FROM p JOIN known USING (host)"""


def _line_quality_sql() -> str:
    word, blank = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    return rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
d AS (
  SELECT *, regexp_extract_all(text, '{word}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM t
),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
l AS (
  SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[1-9]', '0', 'g'), '{blank}', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM t)
),
frequent AS (SELECT source, line FROM l WHERE line != '' GROUP BY source, line HAVING count(DISTINCT doc_id) >= {line_quality.MIN_DOCS}),
gone AS (
  SELECT doc_id, sum(length(line) - length(replace(line, ' ', '')) + 1) AS n FROM l SEMI JOIN frequent ON l.line = frequent.line AND l.source IS NOT DISTINCT FROM frequent.source
  GROUP BY doc_id
),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '{line_quality.SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {line_quality.MIN_LEFT} * n_words AS kept
FROM base"""


def _ball_tree_sql() -> str:
    """The rounds written out: every vector against every centroid."""
    n, scale = ball_tree.COMPONENTS, ball_tree.SCALE
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = lambda r: f"near{r} AS MATERIALIZED (SELECT row, arg_min(struct_pack(c := c, d := d), struct_pack(d := d, c := c)) AS best FROM (SELECT row, c, {apart} AS d FROM kept k, at{r} c) GROUP BY row)"
    steps = [nearest(0)]
    for r in range(ball_tree.ROUNDS):
        steps += [
            f"sums{r} AS (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM near{r} JOIN kept USING (row), range(1, {n + 1}) t(i) GROUP BY best.c, i)",
            f"mean{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums{r} GROUP BY c)",
            f"at{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, a.v) AS v FROM at{r} a LEFT JOIN mean{r} m USING (c))",
            nearest(r + 1),
        ]
    last = ball_tree.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n}
),
at0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{ball_tree.SEED}:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {ball_tree.CENTROIDS}),
{", ".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(a.v, ',')) AS centroid_sha256
FROM near{last} JOIN kept USING (row) JOIN at{last} a ON a.c = best.c"""


SQL = {"op13_ball_tree": _ball_tree_sql(), "op1_sharding": _sharding_sql(), "op2_url_filter": _url_filter_sql(), "op4_line_quality": _line_quality_sql()}
