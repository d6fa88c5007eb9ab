"""Host reputation from labelled pages, by empirical Bayes, and rule lists before it.

Each labelled page is an outcome of its host: bad or not. A host's bad rate has
a beta prior around the rate of its registered domain, that one around the rate
of its suffix, and that one around the rate of all pages. How strongly each level
holds to the one above it comes from the spread of the rates (moments of the
beta-binomial). A host is blocked if the lower bound of its posterior bad rate
is above a threshold.

Only aggregates with map-side combining and joins by host; what reaches the
driver is three numbers per level. Hosts are joined back to pages with a salt,
so that a host with a third of all pages is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rules of the registered query: verdict, then host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Fixed: suffixes of two labels under which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 8


@dataclass(frozen=True)
class Bound:
    """Block if mean - z * sd of the posterior bad rate exceeds ``most``."""

    z: float = 1.645
    most: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def site_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a host of one label is its own domain and suffix."""
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    long = two.isin(*LONG_SUFFIXES)
    suffix = F.when(long, two).otherwise(F.element_at(labels, -1))
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), suffix


def strength(level: DataFrame) -> float:
    """Pseudo-count that ties groups to their parent's rate, from the spread of their rates.

    ``level`` has ``n``, ``bad`` and ``mean`` (the parent's rate). Moments of the beta-binomial give the
    correlation of outcomes within a group; it is kept between 0.001 and 0.5, so the level above counts as one page at least.
    """
    p = F.col("bad") / F.col("n")
    row = level.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * (p - F.col("mean")) ** 2 / (F.col("mean") * (1 - F.col("mean")))).alias("spread")).first()
    if not row.n or row.spread is None:
        return 1.0
    room = row.n - row.squares / row.n - (row.k - 1)
    rho = (row.spread - (row.k - 1)) / room if room > 0 else 0.0
    rho = min(0.5, max(0.001, rho))
    return 1 / rho - 1


def reputation(outcomes: DataFrame, bound: Bound = Bound()) -> DataFrame:
    """Posterior bad rate of each host.

    ``outcomes`` has ``host``, ``n`` labelled pages (0 where none is) and ``bad`` ones. Returns host, n,
    bad, mean, low (the bound) and verdict. Without any labelled page every rate is one half.
    """
    domain, suffix = site_levels(F.col("host"))
    hosts = stored(outcomes.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((total.bad or 0) + 1) / ((total.n or 0) + 2)
    above = None
    for keys in (["suffix"], ["suffix", "domain"], ["suffix", "domain", "host"]):
        level = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if above is None:
            level = level.withColumn("mean", F.lit(rate))
        else:
            level = level.join(above, keys[:-1])
        level = stored(level, "level")
        s = strength(level)
        a, b = s * F.col("mean") + F.col("bad"), s * (1 - F.col("mean")) + F.col("n") - F.col("bad")
        level = level.select(*keys, "n", "bad", a.alias("a"), b.alias("b"))
        above = level.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
    size = F.col("a") + F.col("b")
    mean = F.col("a") / size
    low = mean - bound.z * F.sqrt(mean * (1 - mean) / (size + 1))
    return level.select("host", "n", "bad", mean.alias("mean"), low.alias("low"),
                        F.when(low > bound.most, "block").otherwise("allow").alias("verdict"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """Labelled pages and bad ones per host.

    The number that ends a page's path names the document it shows; the page is bad if that document's
    labels say low quality or toxic in any row. A label that is null in both columns is none.
    """
    host, path = host_and_path(F.col(url))
    number = F.regexp_extract("_path", r"/([0-9]+)[^/]*/?\z", 1)
    number = F.when(number != "", number).try_cast("bigint")
    named = pages.select(host.alias("host"), path.alias("_path")).select("host", number.alias("doc_id"))
    bad = F.max(F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0))
                + F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))) > 0
    known = (labels.where("doc_id is not null and (quality is not null or toxic is not null)")
             .groupBy("doc_id").agg(bad.cast("long").alias("bad")))
    # Pages of one host and document are counted first, so a hot document is one row per host.
    counted = named.groupBy("host", "doc_id").agg(F.count("*").alias("pages"))
    joined = counted.join(known, "doc_id", "left")
    return joined.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("bad") * F.col("pages")), F.lit(0)).alias("bad"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url",
          rules=RULES, bound: Bound = Bound()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's posterior mean and bound.

    Cases: a null url, or one without ``://``, has an empty host and path and is judged as the host "";
    repeated rows and null ids are judged one by one; other columns are ignored; empty tables give no
    rows or, for labels, the prior's verdict.
    """
    host, path = host_and_path(F.col(url))
    hosts = reputation(labelled_outcomes(pages, labels, url), bound).select(
        "host", "mean", "low", F.col("verdict").alias("_own"))
    salted = hosts.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    own = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn(
        "_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return own.join(salted, ["host", "_salt"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "_own").alias("verdict"), "mean", "low")


def oracle_sql(rules=RULES, bound: Bound = Bound()) -> str:
    """The registered query for DuckDB."""
    cases, verdicts = "", ""
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')"
        cases += f" WHEN {fits} THEN '{text}'"
        verdicts += f" WHEN {fits} THEN '{kind}'"
    twos = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)

    def level(name: str, keys: str, source: str) -> str:
        return f"""
{name}_s AS (SELECT CASE WHEN n IS NULL OR spread IS NULL THEN 1.0 ELSE
    1 / least(0.5, greatest(0.001, CASE WHEN n - squares / n - (k - 1) > 0
        THEN (spread - (k - 1)) / (n - squares / n - (k - 1)) ELSE 0 END)) - 1 END AS s
  FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS squares,
          sum(n * (bad / n - mean) ** 2 / (mean * (1 - mean))) AS spread FROM {source} WHERE n > 0)),
{name} AS (SELECT {keys}, s * mean + bad AS a, s * (1 - mean) + n - bad AS b FROM {source}, {name}_s)"""

    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
          WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad
      FROM p LEFT JOIN known
        ON known.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)[^/]*/?\z', 1), '') AS BIGINT)
      GROUP BY host),
l AS (SELECT host, n, bad, list_extract(string_split(host, '.'), -1) AS last1,
             array_to_string(string_split(host, '.')[-2:], '.') AS last2,
             array_to_string(string_split(host, '.')[-3:], '.') AS last3 FROM h),
hosts AS (SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, CASE WHEN last2 IN ({twos}) THEN last3 ELSE last2 END AS domain,
                 CASE WHEN last2 IN ({twos}) THEN last2 ELSE last1 END AS suffix FROM l),
sx0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad,
          (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS mean FROM hosts GROUP BY suffix),{level("sx", "suffix", "sx0")},
dm0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(a / (a + b)) AS mean
        FROM hosts JOIN sx USING (suffix) GROUP BY suffix, domain),{level("dm", "suffix, domain", "dm0")},
hs0 AS (SELECT host, n, bad, a / (a + b) AS mean FROM hosts JOIN dm USING (suffix, domain)),{level("hs", "host", "hs0")},
judged AS (SELECT host, CASE WHEN a / (a + b) - {bound.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {bound.most}
             THEN 'block' ELSE 'allow' END AS own FROM hs)
SELECT page_id, host, path, CASE{cases} END AS rule, CASE{verdicts} ELSE own END AS verdict
FROM p LEFT JOIN judged USING (host)"""
