"""URL filter: hand-written rules first, then an empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host. A host's bad rate is shrunk
towards that of its registered domain, the domain's towards its public suffix, the
suffix's towards the whole table: each level's prior is a beta distribution around the
mean of the level above, whose strength is fitted to all groups of the level by the
method of moments of the beta-binomial. A page is blocked if the lower posterior bound
of its host's bad rate is above ``max_bad``; hosts without labels carry the prior.

DataFrame functions only. Pages are parsed and joined once, by host; the statistics of
hosts, domains and suffixes come from partial sums, so a hot host or domain is summed
where it lies. No level is collected; each level's strength is one number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfuse.llm import shared

#: Public suffixes of two labels; all others count as one label (a fixed list; a table of rules takes its place).
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.cn", "co.za")

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.
    Path: from there up to ``?``, ``#`` or the end. Both empty for null and without ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(text, URL, 1), upper, upper.lower()), F.regexp_extract(text, URL, 2))


#: Addresses, which have no domain above them: four numbers, or anything in brackets.
ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"


def bare_host(host: Column) -> Column:
    """A host without user, port and the dot of a fully qualified name."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def domain_and_suffix(host: Column, two_labels=TWO_LABELS) -> tuple[Column, Column]:
    """Registered domain (suffix and one label) and public suffix of a host; port, user and a final dot are no
    part of them. A host without a dot and an address are their own domain and suffix."""
    bare = bare_host(host)
    last2, last3 = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    two, address = last2.isin(list(two_labels)), F.regexp_like(bare, F.lit(ADDRESS))
    return (F.when(address, bare).when(two, last3).otherwise(last2),
            F.when(address, bare).when(two, last2).otherwise(F.substring_index(bare, ".", -1)))


def with_suffix_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` (distinct host) with domain and suffix by a table of public suffix rules (column ``rule``): ``co.uk``;
    ``*.ck``, any label before it; ``!www.ck``, an exception, whose suffix starts after its first label. An exception
    wins, else the rule of most labels; a host that none fits has its last label as suffix.

    Each tail of a host is looked up by a join, so the table may be of any size and is not collected."""
    rule = F.lower(F.trim("rule"))
    known = rules.where(F.col("rule").isNotNull() & (F.trim("rule") != "")).select(
        F.regexp_replace(rule, r"^(!|\*\.)", "").alias("tail"),
        F.when(F.startswith(rule, F.lit("!")), -1).when(F.startswith(rule, F.lit("*.")), 1).otherwise(0).alias("more")).distinct()
    rows = hosts.withColumn("bare", bare_host(F.col("host")))
    rows = rows.withColumn("labels", F.when(F.regexp_like("bare", F.lit(ADDRESS)), 0).otherwise(F.size(F.split("bare", r"\."))))
    tails = rows.where("labels > 0").select("host", "labels", "bare", F.explode(F.sequence(F.lit(1), F.col("labels"))).alias("n"))
    tails = tails.withColumn("tail", F.expr("substring_index(bare, '.', -n)"))
    fits = tails.join(known, "tail").where("n + more between 1 and labels")
    best = fits.groupBy("host").agg(F.max(F.struct((F.col("more") < 0).alias("wins"), (F.col("n") + F.col("more")).alias("n"))).alias("best"))
    rows = rows.join(best.select("host", F.col("best.n").alias("n")), "host", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return rows.withColumns({"domain": F.expr("if(labels = 0, bare, substring_index(bare, '.', -(n + 1)))"),
                             "suffix": F.expr("if(labels = 0, bare, substring_index(bare, '.', -n))")}).drop("bare", "labels", "n")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule ``host/path`` fits its host
    and all subdomains if the path starts with the rule's, slash included."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last WHEN put around wins
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def strength(groups: DataFrame, least: float = 0.5, most: float = 10_000.0) -> float:
    """Prior strength (a + b) of a level from its groups (n, k, mean of the level above): the
    correlation within groups that makes the squared deviations what they are, as a + b."""
    spread = F.col("n") * F.col("above") * (1 - F.col("above"))
    row = groups.where(F.col("n") > 0).agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("above"), F.lit(2.0)) - spread).alias("over"),
        F.sum(spread * (F.col("n") - 1)).alias("scale")).first()
    rho = row.over / row.scale if row.scale else 0.0
    return most if rho <= 1 / (most + 1) else max(least, 1 / rho - 1)


def shrunk(groups: DataFrame, s: float) -> Column:
    return (F.col("k") + F.lit(s) * F.col("above")) / (F.col("n") + F.lit(s))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffix_rules: DataFrame | None = None) -> DataFrame:
    """One row per host of ``pages`` (page_id, url): host, n, k (labelled and bad pages), ``bad_rate``
    (posterior mean) and ``bad_bound`` (its lower bound at ``z`` standard deviations), both rounded.

    ``outcomes``: page_id, bad (0 or 1; null counts as no label). A page with several outcomes is
    bad if one is. ``suffix_rules``: public suffixes as a table (see ``with_suffix_rules``), else TWO_LABELS. Without any outcome every host has the rate 1/2 of an empty table, bound near 0.
    """
    host, _ = host_and_path(F.col("url"))
    seen = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = pages.select("page_id", host.alias("host")).join(seen, "page_id", "left")
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    if suffix_rules is None:
        hosts = shared.written(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    else:
        hosts = shared.written(hosts.withColumnRenamed("n", "__n"), "host-counts")
        hosts = shared.written(with_suffix_rules(hosts, suffix_rules).withColumnRenamed("__n", "n"), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    whole = hosts.agg(*sums).first()
    mean = ((whole.k or 0) + 0.5) / ((whole.n or 0) + 1)

    suffixes = suffixes.withColumn("above", F.lit(mean))
    suffixes = suffixes.select("suffix", shrunk(suffixes, strength(suffixes)).alias("above"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", shrunk(domains, strength(domains)).alias("above"))
    hosts = hosts.join(domains, "domain")
    s = strength(hosts)
    a = F.col("k") + F.lit(s) * F.col("above")
    b = F.col("n") - F.col("k") + F.lit(s) * (1 - F.col("above"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "k", F.round(a / (a + b), 6).alias("bad_rate"),
                        F.round(F.greatest(a / (a + b) - z * deviation, F.lit(0.0)), 6).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], max_bad: float = 0.5, z: float = 1.645,
          suffix_rules: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, bad_rate, bad_bound.

    The rule's verdict where one fits; else ``block`` if the host's lower bound is above ``max_bad``,
    ``allow`` otherwise. Null and malformed urls have an empty host, judged like any other host.
    Repeated rows are each judged; an empty table gives no row.
    """
    rows = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    reputation = host_reputation(rows, outcomes.select("page_id", "bad"), z, suffix_rules).drop("n", "k")
    parsed = rows.select("page_id", host.alias("host"), path.alias("path")).join(reputation, "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return parsed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "bad_rate", "bad_bound")


#: The rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

ORACLE = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
       FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_extract(bare, '([^.]*[.])?[^.]*$', 0) AS last2, regexp_extract(bare, '([^.]*[.])?([^.]*[.])?[^.]*$', 0) AS last3 FROM h0),
h AS (SELECT host, n, k, CASE WHEN two THEN last3 ELSE last2 END AS domain, CASE WHEN two THEN last2 ELSE regexp_extract(bare, '[^.]*$', 0) END AS suffix
      FROM (SELECT *, last2 IN ({", ".join(f"'{s}'" for s in TWO_LABELS)}) AS two FROM h1)),
g AS (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS mean FROM h),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, mean AS above FROM h, g GROUP BY suffix, mean),
sr AS (SELECT sum(pow(k - n * above, 2) - n * above * (1 - above)) / nullif(sum(n * above * (1 - above) * (n - 1)), 0) AS rho FROM s0 WHERE n > 0),
ss AS (SELECT CASE WHEN coalesce(rho, 0) <= 1 / 10001.0::DOUBLE THEN 10000.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1 / rho - 1) END AS s FROM sr),
s1 AS (SELECT suffix, (k + s * above) / (n + s) AS above FROM s0, ss),
d0 AS (SELECT domain, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, above FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix, above),
dr AS (SELECT sum(pow(k - n * above, 2) - n * above * (1 - above)) / nullif(sum(n * above * (1 - above) * (n - 1)), 0) AS rho FROM d0 WHERE n > 0),
ds AS (SELECT CASE WHEN coalesce(rho, 0) <= 1 / 10001.0::DOUBLE THEN 10000.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1 / rho - 1) END AS s FROM dr),
d1 AS (SELECT domain, (k + s * above) / (n + s) AS above FROM d0, ds),
h2 AS (SELECT host, n::DOUBLE AS n, k::DOUBLE AS k, above FROM h JOIN d1 USING (domain)),
hr AS (SELECT sum(pow(k - n * above, 2) - n * above * (1 - above)) / nullif(sum(n * above * (1 - above) * (n - 1)), 0) AS rho FROM h2 WHERE n > 0),
hs AS (SELECT CASE WHEN coalesce(rho, 0) <= 1 / 10001.0::DOUBLE THEN 10000.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1 / rho - 1) END AS s FROM hr),
ab AS (SELECT host, k + s * above AS a, n - k + s * (1 - above) AS b FROM h2, hs),
r AS (SELECT host, round(a / (a + b), 6) AS bad_rate,
             round(greatest(a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0.0::DOUBLE), 6) AS bad_bound FROM ab),
rules(rule, rhost, rpath, says) AS (VALUES {", ".join(f"('{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{v}')" for t, v in RULES)}),
m AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
      FROM (SELECT DISTINCT page_id, host, path FROM p) q JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.says, CASE WHEN r.bad_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, r.bad_rate, r.bad_bound
FROM p LEFT JOIN r ON p.host = r.host LEFT JOIN m ON p.page_id = m.page_id AND p.host = m.host AND p.path = m.path
"""
