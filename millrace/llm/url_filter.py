"""URL filtering by host reputation, shrunk along host -> registered domain -> suffix.

Labelled pages are Bernoulli outcomes (bad or not). At each level the spread of the group rates around their
parents gives the strength of a beta prior by the method of moments; a host's counts update a prior centred on its
domain's posterior mean, the domain's one centred on its suffix's, the suffix's one on the corpus rate. A host is
blocked where the lower bound of its posterior bad rate lies above a cutoff, so few outcomes never block. Explicit
rules go first. Everything is built-in expressions; only per-host counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, lookup_join, table

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")
CUTOFF, Z = 0.25, 1.64
#: Strength of a prior where a level shows no spread beyond chance, and the least strength.
MAX_STRENGTH, MIN_STRENGTH = 1000.0, 1.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a domain above it) and path; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, rest = text.partition("/")
        fits = (host == at) | host.endswith("." + at)
        if slash:
            fits = fits & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _shrunk(groups: DataFrame, of: str, parent_mean: str) -> DataFrame:
    """Posterior of each group: prior Beta(strength * parent mean, strength * (1 - parent mean)) plus its counts."""
    rate, n = F.col("bad") / F.col("n"), F.col("n")
    within = F.col(parent_mean) * (1 - F.col(parent_mean))
    # Excess variance of the rates over binomial noise, weighted by outcomes: rho = 1 / (1 + strength).
    spread = F.sum(n * (rate - F.col(parent_mean)) * (rate - F.col(parent_mean)))
    chance, room = F.sum(within), F.sum((n - 1) * within)
    rho = F.when(room > 0, F.greatest((spread - chance) / room, F.lit(0.0))).otherwise(F.lit(0.0))
    level = groups.filter("n > 0").agg(rho.alias("rho")).select(
        F.coalesce(F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), F.when(F.col("rho") > 0, 1 / F.col("rho") - 1))), F.lit(MAX_STRENGTH)).alias(f"{of}_strength")
    )
    # One row: the level's strength.
    return groups.crossJoin(F.broadcast(level)).withColumn(f"{of}_mean", (F.col("bad") + F.col(f"{of}_strength") * F.col(parent_mean)) / (n + F.col(f"{of}_strength")))


def host_reputation(pages: DataFrame, outcomes: DataFrame, scratch: Scratch) -> DataFrame:
    """host, freq (pages), n, bad, posterior mean and bounds of every host of ``pages`` (page_id, url).

    ``outcomes`` has page_id and bad (0 or 1); pages without an outcome count for nothing, several outcomes of a
    page all count, null outcomes do not. A corpus without outcomes has the mean 0 everywhere. A suffix or domain
    that most hosts share is no hot key: its facts are broadcast.
    """
    labelled = pages.select("page_id", host_of(F.col("url")).alias("host")).join(outcomes.select("page_id", F.col("bad").cast("double").alias("bad")), "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("*").alias("freq"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    hosts = scratch.settle(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "freq", "n", "bad"), "hosts")
    total = hosts.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("corpus_mean"))
    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("freq"))
    domains = scratch.settle(hosts.groupBy("suffix", "domain").agg(*counts), "domains")  # freq: its hosts
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("freq"))  # freq: its domains
    suffixes = _shrunk(suffixes.crossJoin(F.broadcast(total)), "suffix", "corpus_mean").select("suffix", "suffix_mean", "freq")
    suffixes = scratch.settle(suffixes, "suffixes")
    known = lookup_join(domains.withColumnRenamed("freq", "hosts"), suffixes, "suffix", domains.count()).drop("freq")
    domains = scratch.settle(_shrunk(known, "domain", "suffix_mean").select("domain", "domain_mean", F.col("hosts").alias("freq")), "domain_means")
    known = lookup_join(hosts.withColumnRenamed("freq", "pages"), domains, "domain", hosts.count()).drop("freq").withColumnRenamed("pages", "freq")
    hosts = _shrunk(known, "host", "domain_mean")
    weight = F.col("n") + F.col("host_strength")
    sd = F.sqrt(F.col("host_mean") * (1 - F.col("host_mean")) / (weight + 1))
    return hosts.select("host", "domain", "suffix", "freq", "n", "bad", "host_mean", (F.col("host_mean") - Z * sd).alias("lower"), (F.col("host_mean") + Z * sd).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, cutoff: float = CUTOFF) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate of every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and is judged as the host ''. Repeated rows are
    judged alike and all returned; an empty table gives an empty result; extra columns are ignored.
    """
    with Scratch(pages.sparkSession, "url_filter") as scratch:
        known = host_reputation(pages, outcomes, scratch)
        known = known.select("host", "freq", F.when(F.col("lower") > cutoff, "block").otherwise("allow").alias("reputation"), F.round("host_mean", 6).alias("bad_rate"))
        known = scratch.settle(known, "reputation", keep=True)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = lookup_join(parsed, known, "host", known.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0])
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("reputation")).alias("verdict"), "bad_rate")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels, read as outcomes of the pages of the same number: bad is low quality or toxic.

    A stand-in, as the given tables label documents and not pages; ``judge`` takes any outcomes.
    """
    labels = table(spark, sf_dir, "labels")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
