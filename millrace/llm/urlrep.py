"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Labelled outcomes (1 bad, 0 good) are counted by host, registered domain and suffix. Each level's rate
is shrunk towards its parent's posterior mean through a beta prior whose strength comes from the spread
of the children's rates (method of moments); the suffixes shrink towards the overall rate. A page is
blocked if the lower bound (a quantile of the beta posterior) of its host's bad rate is above ``threshold``.

DataFrame operations only. Counting aggregates partially before any shuffle; a host of a third of all
rows joins one statistics row, so the adaptive skew join splits it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import support

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which countries register names (fixed values): co.uk, gov.au, com.br, ...
SECOND_LEVEL = ("ac", "asn", "co", "com", "edu", "gob", "gouv", "gov", "govt", "id", "info", "ltd", "me", "mil", "ne", "net", "nic", "nom", "or", "org", "plc", "sch")
#: A suffix of two labels: one of these, then the two letters of a country. Any other suffix is the last label.
TWO_LABELS = rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z])\z"
#: Addresses in numbers are their own domain and suffix.
NUMERIC = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[0-9a-f:.]*\])\z"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @staticmethod
    def parse(verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and a last dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(?::[0-9]*)?\z", "")


def suffix_of(host: Column, two_labels: str = TWO_LABELS) -> Column:
    """The public suffix: two labels as ``two_labels`` says, else the last one; a numeric address is its own."""
    name = name_of(host)
    two = F.regexp_extract(name, two_labels, 1)
    return F.when(name.rlike(NUMERIC), name).when(two != "", two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, two_labels: str = TWO_LABELS) -> Column:
    """The registered domain: the suffix and one label more; a host of fewer labels is its own domain."""
    name = name_of(host)
    return F.when(name.rlike(NUMERIC), name).when(F.regexp_extract(name, two_labels, 1) != "", F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


_GRID, _REACH = 400, 40.0


def beta_quantile(a: Column, b: Column, share: float) -> Column:
    """The ``share`` quantile of the beta distribution, to some 1e-3 of its width: over z = log(x / (1 - x)) the
    density is x^a (1 - x)^b, summed on a grid from -40 to 40; what lies below is an exponential tail."""
    step = _REACH / _GRID

    def log_density(i):
        z = i * F.lit(step)
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))  # log(1 + e^z)
        return a * z - (a + b) * soft

    grid = F.sequence(F.lit(-_GRID), F.lit(_GRID))
    top = a * F.log(a / (a + b)) + b * F.log(b / (a + b))  # the density's logarithm at its peak
    mass = F.transform(grid, lambda i: F.exp(log_density(i) - top) * F.when((i == -_GRID) | (i == _GRID), 0.5).otherwise(1.0) * step)
    below = F.exp(log_density(F.lit(-_GRID)) - top) / a
    above = F.exp(log_density(F.lit(_GRID)) - top) / b

    def find(m):
        goal = share * (F.aggregate(m, F.lit(0.0), lambda s, x: s + x) + below + above)
        start = F.struct(below.alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("z"))

        def add(s, x):
            here = s["sum"] + x
            at = (s["i"] - _GRID - 0.5 + (goal - s["sum"]) / x) * step  # a grid point's mass lies around it
            return F.struct(here.alias("sum"), (s["i"] + 1).alias("i"), F.when(s["z"].isNull() & (here >= goal), at).otherwise(s["z"]).alias("z"))

        z = F.aggregate(m, start, add, lambda s: s["z"])
        return F.when(below >= goal, F.lit(0.0)).otherwise(1 / (1 + F.exp(-F.coalesce(z, F.lit(_REACH)))))

    return F.transform(F.array(mass), find)[0]


def matched(rules: list[Rule], host: Column, path: Column) -> Column:
    """The text of the longest rule that fits, null if none does; among equally long ones the first by text."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def _strength(groups: DataFrame, least: float = 0.001, most: float = 0.5) -> float:
    """Prior strength (pseudo-outcomes) from groups (n, k, m: the parent's mean)."""
    g = groups.filter("n > 0")
    var = F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-9))
    r = g.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) / var).alias("x"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") - 1).alias("d")).first()
    rho = (r["x"] - r["g"]) / r["d"] if r["d"] else most
    rho = min(most, max(least, rho))
    return 1 / rho - 1


def reputation(hosts: DataFrame, share: float = 0.05) -> DataFrame:
    """hosts (host, n, k: labelled outcomes, bad ones) -> host, mean, bound: of the posterior beta distribution
    the mean and the ``share`` quantile. Hosts without outcomes get those of the bare prior around their
    domain's posterior mean."""
    named = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k")
    t = named.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = (t["k"] + 0.5) / (t["n"] + 1) if t["n"] else 0.5

    def posterior(rows: DataFrame, name: str) -> tuple[DataFrame, float]:
        s = _strength(rows)
        return rows.withColumn(name, (F.lit(s) * F.col("m") + F.col("k")) / (F.lit(s) + F.col("n"))), s

    suffixes = named.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(overall))
    suffixes, _ = posterior(suffixes, "post")
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains, _ = posterior(domains.join(suffixes.select("suffix", F.col("post").alias("m")), "suffix"), "post")
    per_host = named.join(domains.select("domain", F.col("post").alias("m")), "domain")
    s = _strength(per_host)
    a = F.lit(s) * F.col("m") + F.col("k")
    total = F.lit(s) + F.col("n")
    posteriors = per_host.select("host", a.alias("a"), (total - a).alias("b"))
    # hosts of one posterior share its quantile
    bounds = posteriors.select("a", "b").distinct().withColumn("bound", beta_quantile(F.col("a"), F.col("b"), share))
    return posteriors.join(bounds, ["a", "b"]).select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), "bound")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], threshold: float = 0.2, share: float = 0.05, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound of every page.

    outcomes: (page_id, bad), at most one row a page; pages without one count only as pages. A null url
    has empty host and path and shares the reputation of the empty host. Repeated pages and null ids stay; of
    several outcomes of a page a bad one counts. An empty table gives an empty result, without outcomes every
    host has the bare prior. Whole addresses are read; other columns are not.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    o = outcomes.filter(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    hosts = p.join(o, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts, _ = support.kept(hosts, "hosts")
    rep = reputation(hosts, share)
    out = p.join(rep, "host")
    by_text = {r.text: r.verdict for r in rules}
    out = out.withColumn("rule", matched(rules, F.col("host"), F.col("path")))
    named = F.lit(None).cast("string")
    for text, verdict in by_text.items():
        named = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(named)
    method = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(named, method).alias("verdict"), F.col("mean").alias("bad_rate"), "bound")
