"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's rate of bad outcomes is shrunk
towards the level above it through a beta prior whose strength is fitted to that level's spread by the method of
moments; a host is blocked when even the lower bound of its posterior rate lies above ``limit``. Hosts without labels
inherit their domain's or suffix's belief, and pages without a host the overall one.

Null urls and urls without ``://`` have an empty host and path and fit no rule. Repeated rows are judged alike, other
columns are ignored, and very long urls are read whole. Outcomes that are null don't count. With no outcomes at all
nothing but rules blocks. Rules of equal length that both fit cannot differ. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = 0.3
Z = 1.6448536269514722
STRENGTH = (1.0, 1000.0)
#: Public suffixes of two labels; all others have one. Another list may be given.
LONG_SUFFIXES = (
    "ac.jp", "ac.kr", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph",
    "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "github.io", "go.jp", "gov.au",
    "gov.br", "gov.cn", "gov.in", "gov.uk", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.uk", "nhs.uk", "or.jp", "or.kr",
    "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "plc.uk", "sch.uk", "web.id",
)

ADDRESS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$|^\[.*\]$"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and last dot, which domains and suffixes are taken from."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.$", "")


def is_address(name: Column) -> Column:
    """IP addresses have no labels to be cut at: they are their own domain and suffix."""
    return name.rlike(ADDRESS)


def suffix_of(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*long_suffixes), two).otherwise(F.substring_index(two, ".", -1))


def domain_of(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*long_suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, nulls where none fits."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return rule, verdict


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior strength that the spread of the groups' rates asks for (1/rho - 1 of the beta-binomial)."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = groups.agg(F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(n * n).alias("nn"), F.sum(bad * bad / n).alias("bb"))
    rate = F.try_divide(F.col("bad"), F.col("n"))
    noise = rate * (1 - rate)
    spread = F.col("bb") - F.col("n") * rate * rate
    rho = F.try_divide(spread - noise * (F.col("k") - 1), noise * (F.col("n") - F.try_divide(F.col("nn"), F.col("n")) - (F.col("k") - 1)))
    fitted = F.when(rho > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), 1 / rho - 1))).otherwise(F.lit(STRENGTH[1]))
    return sums.select(fitted.alias("strength"))


def _shrunk(level: DataFrame, prior: Column, strength: Column) -> Column:
    return (F.col("bad") + strength * prior) / (F.col("n") + strength)


def host_posteriors(outcomes: DataFrame, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """(host, domain, suffix) tables with mean and lower bound of the bad rate, and the overall pair.

    outcomes: host and bad (0/1) of every labelled page.
    """
    counted = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = written(counted.withColumn("domain", domain_of(F.col("host"), long_suffixes)).withColumn("suffix", suffix_of(F.col("host"), long_suffixes)), "url-hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-suffixes")
    total = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    n, bad = float(total[0] or 0), float(total[1] or 0)
    base = (bad + 0.5) / (n + 1)
    s_host, s_domain, s_suffix = ((_strength(x).first() or [STRENGTH[1]])[0] or STRENGTH[1] for x in (hosts, domains, suffixes))

    def bounded(df: DataFrame, prior: Column, strength: float) -> DataFrame:
        mean = _shrunk(df, prior, F.lit(strength))
        sd = F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(strength) + 1))
        return df.withColumn("mean", mean).withColumn("low", mean - F.lit(Z) * sd)

    top = bounded(suffixes, F.lit(base), s_suffix)
    middle = bounded(domains.join(top.select("suffix", F.col("mean").alias("above")), "suffix"), F.col("above"), s_domain)
    bottom = bounded(hosts.join(middle.select("domain", "suffix", F.col("mean").alias("above")), ["domain", "suffix"]), F.col("above"), s_host)
    overall_sd = (base * (1 - base) / (n + 2)) ** 0.5
    return bottom.select("host", "mean", "low"), middle.select("domain", "suffix", "mean", "low"), top.select("suffix", "mean", "low"), (base, base - Z * overall_sd)


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the bound that the reputation gives.

    outcomes: page_id and bad (0/1); several outcomes of one page count once, as bad if any is.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    once = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = parsed.where("page_id is not null").select("page_id", "host").join(once, "page_id").select("host", "bad")
    by_host, by_domain, by_suffix, overall = host_posteriors(labelled, long_suffixes)
    # Each host is resolved once, so the pages meet one narrow table.
    named = parsed.groupBy("host").agg(F.lit(1).alias("_one")).drop("_one")
    named = named.withColumn("domain", domain_of(F.col("host"), long_suffixes)).withColumn("suffix", suffix_of(F.col("host"), long_suffixes))
    known = (
        named.join(by_host.select("host", F.col("low").alias("l1")), "host", "left")
        .join(by_domain.select("domain", "suffix", F.col("low").alias("l2")), ["domain", "suffix"], "left")
        .join(by_suffix.select("suffix", F.col("low").alias("l3")), "suffix", "left")
        .select("host", F.coalesce("l1", "l2", "l3", F.lit(overall[1])).alias("low"))
    )
    known = written(known, "url-known")
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("low") > F.lit(limit), F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), F.round("low", 9).alias("bad_rate_low"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """The tables tie labels to pages by id; a page is bad if it is toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(1)).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), F.lit(0))
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
