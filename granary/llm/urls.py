"""URL filters: rules first, then the reputation of the host by empirical Bayes.

A host's share of bad pages is beta-binomial. Its prior has the mean of its registered domain's
posterior, which has the mean of its suffix's posterior, which has the mean of all labelled pages;
the strength of each level's prior comes from how much groups of that level differ, by moments. A
page is blocked where the lower quantile of its host's posterior passes the limit.

Null urls and urls without ``://`` have an empty host and path; they are judged as one host. For
reputation, what stands before ``@`` in a host and a port behind it don't count. With
no labelled outcomes everything that no rule fits is allowed. Of rules that fit, the longest wins,
then the greater by code point. Repeated rows each get the verdict. A very long url is a text as any
other; an empty table gives an empty one. Of the pages only ``page_id`` and ``url`` are read, whatever
other columns are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import stage

#: Suffixes of two labels under which names are registered, where no list is given.
TWO_LABELS = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za"]
#: A page is blocked if the share of bad pages is above the limit but for this much of the posterior.
LIMIT, TAIL = 0.5, 0.05
#: Points of the posterior's grid, and standard deviations that it spans.
POINTS, SPAN = 401, 20.0
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")


def suffix_of(host: Column, suffixes: list[str]) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(suffixes), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, suffixes: list[str]) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``(length, rule, verdict)`` of the longest rule that fits, or null; rules are a parameter
    list, not a table that grows with the pages."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        hit = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        fits.append(F.when(hit, F.struct(F.lit(len(rule_host + rule_path)).alias("length"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def _level(groups: DataFrame, key: str, parent: DataFrame | None, parent_key: str, mean: float) -> DataFrame:
    """Posterior of each group, ``(key, ..., m, strength)``; ``groups`` has n labelled, k bad."""
    joined = groups.withColumn("prior", F.lit(mean)) if parent is None else groups.join(parent.select(parent_key, F.col("m").alias("prior")), parent_key)
    p = F.col("prior") * (1 - F.col("prior"))
    spread = joined.agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("prior"), 2) - F.col("n") * p).alias("a"), F.sum(F.col("n") * (F.col("n") - 1) * p).alias("b")).first()
    rho = min(max((spread["a"] or 0.0) / spread["b"] if spread["b"] else 0.01, 0.001), 0.9)
    kappa = 1 / rho - 1
    return joined.withColumn("m", (F.col("k") + kappa * F.col("prior")) / (F.col("n") + kappa)).withColumn("strength", F.col("n") + kappa)


def lower_quantile(share: Column, strength: Column, tail: float = TAIL) -> Column:
    """Quantile of the beta distribution with this mean and sum of parameters.

    On the scale of log odds the density is smooth and has one top whatever the parameters, so it's
    summed over a grid of cells around the top, wide enough for both tails; sums need no beta
    function, as they are divided by the whole.
    """
    a, b = share * strength, (1 - share) * strength
    step = F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) * (SPAN / (POINTS - 1))
    return _bound(F.struct(a.alias("a"), b.alias("b"), F.log(a / b).alias("top"), step.alias("step")), lambda p: _quantile_on(p, tail))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it's named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _quantile_on(p: Column, tail: float) -> Column:
    log_density = lambda u: p["a"] * u - (p["a"] + p["b"]) * (F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))))
    place = lambda i: p["top"] + (i - POINTS // 2) * p["step"]
    cells = _bound(log_density(p["top"]), lambda most: F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.exp(log_density(place(i)) - most)))

    def add(seen: Column, w: Column) -> Column:
        here = (seen["at"] < 0) & (seen["sum"] + w >= seen["wanted"])
        at = F.when(here, seen["i"] + (seen["wanted"] - seen["sum"]) / w).otherwise(seen["at"])
        return F.struct((seen["sum"] + w).alias("sum"), at.alias("at"), (seen["i"] + 1).alias("i"), seen["wanted"].alias("wanted"))

    def found(ws: Column) -> Column:
        wanted = tail * F.aggregate(ws, F.lit(0.0), lambda total, w: total + w)
        return F.aggregate(ws, F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"), F.lit(0).alias("i"), wanted.alias("wanted")), add)["at"]

    return 1 / (1 + F.exp(-(place(_bound(cells, found)) - p["step"] / 2)))


def reputation(hosts: DataFrame, suffixes: list[str] = TWO_LABELS) -> DataFrame:
    """Posterior share of bad pages by host from ``(host, n, k)``. Each level is an aggregate of the
    one below, so hosts are grouped once over the pages and the upper levels read few rows."""
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    groups = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = groups.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    top = _level(groups, "suffix", None, "suffix", mean)
    middle = _level(domains, "domain", top, "suffix", mean)
    found = _level(hosts, "host", middle.select("domain", "m"), "domain", mean)
    return found.select("host", "n", F.col("m").alias("bad_share"), lower_quantile(F.col("m"), F.col("strength")).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], suffixes: list[str] = TWO_LABELS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_share, bad_bound)``. ``outcomes`` has
    ``(page_id, bad)``, 0 or 1, for the labelled pages, one row a page; ``suffixes`` are those of two
    labels under which names are registered."""

    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), site_of(host).alias("site"))
    marked = parsed.select("page_id", "site").join(outcomes.select("page_id", "bad"), "page_id", "left")
    hosts = stage(marked.groupBy(F.col("site").alias("host")).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")), "hosts")
    known = stage(reputation(hosts, suffixes), "reputation").select(F.col("host").alias("_host"), "bad_share", "bad_bound")
    chosen = parsed.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))
    own = F.when(F.col("bad_bound") > LIMIT, "block").otherwise("allow")
    return chosen.join(known, F.col("site") == F.col("_host"), "left").select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), own).alias("verdict"), "bad_share", "bad_bound")
