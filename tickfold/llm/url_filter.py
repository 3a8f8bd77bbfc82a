"""URL filters: rules by host suffix and path prefix, and for other urls an empirical-Bayes reputation.

Labelled pages (by default those that a rule judges) are outcomes of their host. A host's block rate has
a beta prior around its registered domain's rate, that one around its public suffix's, that one around the
rate of all; how strongly each level holds to the one above is estimated from the spread between groups
(moments of the beta-binomial). A url without a rule is blocked if the lower posterior bound of its host's
block rate reaches the limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

# The rules of the registered query.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
# Public suffixes of two labels; all others are a host's last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
#: Posterior standard deviations below the mean, and the limit that this bound must reach to block.
Z, LIMIT = 1.64, 0.8
#: A prior's weight in pages is held between these.
WEAKEST, STRONGEST = 1.0, 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return F.lit(None).cast("string") if found is None else found


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    two = last(2).isin(*TWO_LABEL_SUFFIXES)
    return F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def _weight(groups: DataFrame, above: str) -> float:
    """The beta prior's weight in pages: moments of beta-binomial groups (n, k) around the rates ``above``."""
    m = F.col(above)
    got = groups.where("n > 0").agg(
        F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.pow(F.col("k") - F.col("n") * m, 2) / F.col("n")), F.sum(m * (1 - m))
    ).first()
    g, n, squares, spread, binomial = (float(x or 0) for x in got)
    free = n - squares / n if n else 0.0
    if g < 2 or binomial <= 0 or free <= g - 1:
        return WEAKEST
    rho = (spread - binomial) / (binomial / g * (free - (g - 1)))
    return STRONGEST if rho <= 1 / (1 + STRONGEST) else min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocked: str | None = None) -> DataFrame:
    """Per row: id, host, path, rule (null if none fits), verdict (allow or block), block_rate (the
    host's posterior mean) and block_bound (its lower bound).

    blocked: a column of labelled outcomes (1 blocked, 0 allowed, null unknown); None: the rules'
    verdicts are the outcomes. Null urls and those without ``://`` have an empty host and path and are
    judged as one host. Repeated rows stay and count as often. Other columns are not looked at.
    """
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col), host.alias("host"), path.alias("path"), *([F.col(blocked).alias("outcome")] if blocked else []))
    pages = pages.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = reduce(lambda c, r: c.when(F.col("rule") == r[0], r[1]), rules, F.when(F.lit(False), ""))
    pages = pages.withColumn("by_rule", verdict)
    if not blocked:
        pages = pages.withColumn("outcome", F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "block").cast("int")))
    domain, suffix = domain_and_suffix(F.col("host"))
    counts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("k"))
    hosts = counts.withColumns({"domain": domain, "suffix": suffix})

    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    overall = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    level, above = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(overall)), "m"
    suffixes = _shrunk(level, _weight(level, above))
    level = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    level = level.join(suffixes.select("suffix", F.col("rate").alias("m")), "suffix")
    domains = _shrunk(level, _weight(level, above))
    level = hosts.join(domains.select("domain", "suffix", F.col("rate").alias("m")), ["domain", "suffix"])
    rated = _shrunk(level, _weight(level, above))
    p, all_n = F.col("rate"), F.col("weight") + F.col("n")
    rated = rated.withColumn("bound", p - Z * F.sqrt(p * (1 - p) / (all_n + 1)))
    reputation = rated.select("host", F.col("rate").alias("block_rate"), F.col("bound").alias("block_bound"))
    return pages.join(reputation, "host").select(
        id_col, "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("block_bound") >= LIMIT, "block").otherwise("allow")).alias("verdict"),
        "block_rate", "block_bound",
    )


def _shrunk(groups: DataFrame, weight: float) -> DataFrame:
    """Posterior means of groups (n, k) whose prior has the mean m and this weight."""
    w = F.lit(float(weight))
    return groups.withColumns({"weight": w, "rate": (w * F.col("m") + F.col("k")) / (w + F.col("n"))})


def oracle(rules=RULES) -> str:
    """The registered query as DuckDB SQL."""
    fits = "".join(
        f" when (host = '{r.split('/', 1)[0]}' or ends_with(host, '.{r.split('/', 1)[0]}')) and starts_with(path, '/{r.split('/', 1)[1]}') then '{r}'"
        for r, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    )
    verdicts = "".join(f" when '{r}' then '{v}'" for r, v in rules)
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

    def weight(groups: str) -> str:
        """The prior's weight, as ``_weight`` has it, of groups (n, k, m)."""
        return f"""(select case when g < 2 or b <= 0 or f <= g - 1 then {WEAKEST} when (s - b) / (b / g * (f - (g - 1))) <= {1 / (1 + STRONGEST)!r} then {STRONGEST}
        else least({STRONGEST}, greatest({WEAKEST}, 1 / ((s - b) / (b / g * (f - (g - 1)))) - 1)) end::double as w from
        (select count(*)::double as g, sum(n) - sum(n * n) / sum(n)::double as f, sum(pow(k - n * m, 2) / n) as s, sum(m * (1 - m)) as b from {groups} where n > 0))"""

    def level(name: str, source: str) -> str:
        return f"{name}_w as {weight(source)}, {name} as (select *, w as weight, (w * m + k) / (w + n) as rate from {source}, {name}_w)"

    return f"""
    with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
    r as (select *, case{fits} end as rule from p), v as (select *, case rule{verdicts} end as by_rule from r),
    o as (select *, case by_rule when 'block' then 1 when 'allow' then 0 end as outcome, string_split(host, '.') as l from v),
    d as (select *, case when array_to_string(l[-2:], '.') in ({two}) then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain,
      case when array_to_string(l[-2:], '.') in ({two}) then array_to_string(l[-2:], '.') else l[-1] end as suffix from o),
    hosts as (select host, domain, suffix, count(outcome) as n, coalesce(sum(outcome), 0) as k from d group by 1, 2, 3),
    total as (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2)::double as m from hosts),
    sg as (select suffix, sum(n) as n, sum(k) as k, any_value(total.m) as m from hosts, total group by 1), {level("sl", "sg")},
    dg as (select domain, hosts.suffix, sum(hosts.n) as n, sum(hosts.k) as k, any_value(sl.rate) as m from hosts join sl on sl.suffix = hosts.suffix group by 1, 2), {level("dl", "dg")},
    hg as (select host, hosts.n, hosts.k, dl.rate as m from hosts join dl on dl.domain = hosts.domain and dl.suffix = hosts.suffix), {level("hl", "hg")},
    b as (select host, rate, rate - {Z} * sqrt(rate * (1 - rate) / (weight + n + 1)) as bound from hl)
    select page_id, host, path, rule, coalesce(by_rule, case when bound >= {LIMIT} then 'block' else 'allow' end) as verdict, round(rate, 7) as block_rate, round(bound, 7) as block_bound from v join b using (host)"""
