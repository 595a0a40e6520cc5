"""Expiry, registrars, failure of operators, changes between snapshots, look-alike names."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perispark.operators.findings import pct
from perispark.sources.scratch import written

KEY = "k"


def expiring(whois: DataFrame, as_of: str) -> DataFrame:
    left = F.datediff("expires_at", F.lit(as_of).cast("date"))
    return whois.agg(F.count_if(left.between(0, 30)).alias("within_30"), F.count_if(left.between(0, 90)).alias("within_90"))


def registrars_expiring(whois: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    soon = whois.filter(F.datediff("expires_at", F.lit(as_of).cast("date")).between(0, 90))
    return soon.groupBy("registrar").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "registrar").limit(n)


def valuable_expiring(whois: DataFrame, subdomains: DataFrame, classes: DataFrame, as_of: str) -> DataFrame:
    subs = subdomains.groupBy(KEY).agg(F.countDistinct("subdomain").alias("subdomains"))
    soon = whois.filter(F.datediff("expires_at", F.lit(as_of).cast("date")).between(0, 90)).select(KEY, "expires_at")
    return soon.join(subs, KEY).join(classes.select(KEY, "sector"), KEY, "left")


def registrar_age(whois: DataFrame, as_of: str) -> DataFrame:
    return whois.groupBy("registrar").agg(F.round(F.avg(F.datediff(F.lit(as_of).cast("date"), "whois_created")), 4).alias("mean_days"))


def registrar_share(whois: DataFrame) -> DataFrame:
    n = whois.groupBy("registrar").agg(F.count("*").alias("n"))
    return n.select("registrar", "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def registrar_posture(whois: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score by registrar, and how the score goes with delegated signatures among its domains."""
    signed = F.col("dnssec_delegated").cast("int").cast("double")
    both = whois.join(scores.select(KEY, F.col("score").cast("double").alias("score")), KEY)
    return both.groupBy("registrar").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.corr("score", signed), 4).alias("corr")
    )


def registrar_dnssec(whois: DataFrame) -> DataFrame:
    return whois.groupBy("registrar").agg(F.count("*").alias("n"), F.count_if("dnssec_delegated").alias("delegated"))


def orphans(dns: DataFrame, names: DataFrame) -> DataFrame:
    """Alias rows whose target is no known name."""
    return dns.filter("cname IS NOT NULL").join(names.select(F.col("name").alias("cname")).distinct(), "cname", "left_anti")


def failed_domains(staging: DataFrame, down: DataFrame) -> DataFrame:
    """Domains all of whose operators are down."""
    hit = staging.join(down.select("operator", F.lit(1).alias("_d")).distinct(), "operator", "left")
    return hit.groupBy(KEY).agg(F.count("*").alias("all"), F.count("_d").alias("down")).filter("all = down").select(KEY)


def cascade(staging: DataFrame, down: DataFrame, classes: DataFrame) -> DataFrame:
    fallen = failed_domains(staging, down)
    return fallen.join(classes.select(KEY, "sector"), KEY, "left").groupBy("sector").agg(F.count("*").alias("n"))


SHARES = (0.10, 0.25, 0.50)


def operator_sets(staging: DataFrame) -> DataFrame:
    """(operators, n): each set of operators that domains hang on, and how many do. A domain has few operators, and many
    domains the same ones, so this is small beside staging; it is written once as a table."""
    each = staging.groupBy(KEY).agg(F.array_sort(F.collect_set("operator")).alias("operators"))
    return written(each.groupBy("operators").agg(F.count("*").alias("n")), "operator-sets")


def hub_removals(staging: DataFrame, shares: Sequence[float] = SHARES, most: int = 50) -> DataFrame:
    """(step, operator, fallen, share, least): operators taken one by one until the largest share of domains has none left up.

    Each step takes the operator that is the last one up for most domains, ties by reach and then name: greedy, as
    the smallest set is a hard problem. fallen counts the domains down after the step; share is the largest of
    shares that they make up, null before the first. least is what no smaller set of operators can do: a set
    brings down no more domains than it has of their weight, a domain's weight being dealt evenly to its operators.
    Ends after ``most`` steps even if a share isn't reached.

    A step is one aggregation over the sets of operators, which are a table, and names the operators taken
    before: plans don't grow from step to step, and all shares come from one run.
    """
    spark, sets = staging.sparkSession, operator_sets(staging)
    total = sets.agg(F.sum("n")).first()[0] or 0
    weight = sets.select(F.explode("operators").alias("operator"), (F.col("n") / F.size("operators")).alias("w"))
    largest = [r.w for r in weight.groupBy("operator").agg(F.sum("w").alias("w")).orderBy(F.col("w").desc()).limit(most).collect()]
    could, taken, out = list(itertools.accumulate(largest)), [], []
    gone = 0
    while len(out) < most and gone < max(shares) * total:
        up = F.array_except("operators", F.array(*map(F.lit, taken)).cast("array<string>"))
        each = sets.select("n", up.alias("up")).select("n", F.explode("up").alias("operator"), (F.size("up") == 1).alias("last"))
        sums = each.groupBy("operator").agg(F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)).alias("fall"), F.sum("n").alias("reach"))
        best = sums.orderBy(F.col("fall").desc(), F.col("reach").desc(), "operator").first()
        if best is None:
            break
        gone += best.fall
        taken.append(best.operator)
        reached = max((s for s in shares if gone >= s * total), default=None)
        enough = [k + 1 for k, w in enumerate(could) if w >= gone - 1e-6]
        out.append((len(out) + 1, best.operator, gone, reached, min(enough, default=most)))
    return spark.createDataFrame(out, "step int, operator string, fallen long, share double, least int")


def hub_removal(staging: DataFrame, share: float, most: int = 50) -> DataFrame:
    """(step, operator, fallen, reached): the steps of hub_removals() for one share."""
    steps = hub_removals(staging, (share,), most)
    return steps.select("step", "operator", "fallen", F.col("share").isNotNull().alias("reached"))


def change_log(old: DataFrame, new: DataFrame, cols: list[str], key: str = KEY) -> DataFrame:
    """(key, change, column, before, after, severity) between two snapshots; added and removed rows have no column.

    Removed domains and turns to error are high, other changes of status medium, the rest low.
    """
    o = old.select(key, F.lit(1).alias("_o"), *[F.col(c).cast("string").alias(f"o_{c}") for c in cols])
    n = new.select(key, F.lit(1).alias("_n"), *[F.col(c).cast("string").alias(f"n_{c}") for c in cols])
    both = o.join(n, key, "full_outer")
    none = F.lit(None).cast("string")

    def entry(when: Column, what: str, name: Column, a: Column, b: Column) -> Column:
        return F.when(when, F.struct(F.lit(what).alias("change"), name.alias("column"), a.alias("before"), b.alias("after")))

    same = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    entries = [entry(F.col("_o").isNull(), "added", none, none, none), entry(F.col("_n").isNull(), "removed", none, none, none)]
    for c in cols:
        a, b = F.col(f"o_{c}"), F.col(f"n_{c}")
        entries.append(entry(same & ~a.eqNullSafe(b), "changed", F.lit(c), a, b))
    log = both.select(key, F.inline(F.array_compact(F.array(*entries))))
    high = (F.col("change") == "removed") | ((F.col("column") == "status") & (F.col("after") == "error"))
    return log.withColumn("severity", F.when(high, "high").when(F.col("column") == "status", "medium").otherwise("low"))


def alerts(log: DataFrame, key: str = KEY) -> DataFrame:
    """The changes of a change_log() that need a look: all but the low ones."""
    return log.filter("severity != 'low'").select(key, "change", "severity")


def risk_alerts(snapshots: DataFrame, key: str = KEY, high: int = 20) -> DataFrame:
    """(key, seen, before, score, severity) where a domain's score falls from one snapshot (key, seen, score) to the next."""
    last = F.lag("score").over(Window.partitionBy(key).orderBy("seen"))
    fell = snapshots.select(key, "seen", last.alias("before"), "score").filter("score < before")
    return fell.withColumn("severity", F.when(F.col("before") - F.col("score") >= high, "high").otherwise("medium"))


def trend(snapshots: DataFrame, key: str = KEY) -> DataFrame:
    """Score changes and the mean of up to three snapshots, for rows (key, seen, score)."""
    w = Window.partitionBy(key).orderBy("seen")
    return snapshots.select(key, "seen", "score", (F.col("score") - F.lag("score").over(w)).alias("change"),
        F.round(F.avg("score").over(w.rowsBetween(-2, 0)), 4).alias("moving"))


def deletions(name: str = "name"):  # noqa: ANN201
    """Keys that names at most one substitution, insertion or deletion apart share."""
    n = F.col(name)
    return F.concat(F.array(n),
        F.transform(F.sequence(F.lit(1), F.length(n)),
        lambda i: F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n)))))


#: Names of one key that meet in one task; a key of more is split into parts, each of which meets all of the key's names.
TOGETHER = 500


def typosquats(names: DataFrame) -> DataFrame:
    """Pairs (a, b) one edit or one swap of neighbours apart, or alike once 1 is l and 0 is o.

    Names that may be such a pair share a key, what is left of them after a deletion or that folding. Keys of a
    single name go before anything meets, and a key of very many is spread over parts of TOGETHER names.
    """
    plain = F.translate(F.col("name"), "10", "lo")
    keyed = names.select("name", F.explode(F.array_distinct(F.concat(deletions(), F.array(plain)))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = keyed.join(sizes.select("key", F.ceil(F.col("_n") / TOGETHER).cast("int").alias("_parts")), "key")
    left = shared.select("key", F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int").alias("_part"), F.col("name").alias("a"))
    right = shared.select("key", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("name").alias("b"))
    p, q = F.translate(F.col("a"), "10", "lo"), F.translate(F.col("b"), "10", "lo")
    i = F.length(F.regexp_extract(F.concat_ws(" ", "a", "b"), r"^(.*).* \1", 1)) + 1
    swapped = F.concat(F.substring(F.col("a"), F.lit(1), i - 1), F.substring(F.col("a"), i + 1, F.lit(1)),
        F.substring(F.col("a"), i, F.lit(1)), F.substring(F.col("a"), i + 2, F.length("a")))
    near = (F.levenshtein("a", "b") <= 1) | (p == q) | (swapped == F.col("b"))
    return left.join(right, ["key", "_part"]).filter("a < b").filter(near).select("a", "b").distinct()


def with_lookalike(names: DataFrame) -> DataFrame:
    """The names that are in any pair of typosquats(), without the pairs, whose number grows faster than that of the names.

    What is left of a name without its i-th letter, and the whole name at place 0, are its rows. Names that share the
    rest are one edit apart if one of them is the rest or their letters stood at the same place, and one swap apart if
    the same letter stood at neighbouring places. A rest has no more names than it has places and letters there are.
    """
    n = F.col("name")
    own = F.struct(n.alias("rest"), F.lit(0).alias("at"), F.lit("").alias("letter"))
    without = F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.struct(
        F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n))).alias("rest"), i.alias("at"), F.substring(n, i, F.lit(1)).alias("letter")))
    each = names.select(F.inline(F.concat(F.array(own), F.when(F.length(n) > 0, without).otherwise(F.array().cast(
        "array<struct<rest:string,at:int,letter:string>>")))))
    sharing = each.groupBy("rest").agg(F.collect_set(F.struct("at", "letter")).alias("of")).filter(F.size("of") > 1)
    # the letters of rest between two neighbouring places: the same letter there makes it one name, not a swap
    between = lambda x, y: F.substring("rest", F.least(x["at"], y["at"]), F.lit(1))
    near = lambda x, y: (((x["at"] == y["at"]) & (x["letter"] != y["letter"]))
        | ((F.abs(x["at"] - y["at"]) == 1) & (x["letter"] == y["letter"]) & (between(x, y) != x["letter"])))
    whole = F.exists("of", lambda x: x["at"] == 0)
    found = F.when(whole, F.col("of")).otherwise(F.filter("of", lambda x: F.exists("of", lambda y: near(x, y))))
    edited = sharing.select("rest", F.inline(found)).select(F.when(F.col("at") == 0, F.col("rest")).otherwise(F.concat(
        F.substring("rest", F.lit(1), F.col("at") - 1), "letter", F.substring("rest", F.col("at"), F.length("rest")))).alias("name"))
    folded = names.select("name").distinct().withColumn("plain", F.translate("name", "10", "lo"))
    alike = folded.groupBy("plain").agg(F.count("*").alias("n")).filter("n > 1")
    return edited.unionByName(folded.join(alike, "plain").select("name")).distinct()


CONFUSABLE = ("асеорхуі01", "aceopxyiol")


def homoglyphs(names: DataFrame) -> DataFrame:
    """(name, skeleton, like, members) of the names that share a skeleton, look-alike letters folded, with others.

    like is the least name of the skeleton; a row for each name, so a skeleton of many names isn't squared.
    """
    s = names.select("name").distinct().withColumn("skeleton", F.translate(F.col("name"), *CONFUSABLE))
    groups = s.groupBy("skeleton").agg(F.min("name").alias("like"), F.count("*").alias("members")).filter("members > 1")
    return s.join(groups, "skeleton").select("name", "skeleton", "like", "members")


def blocklisted(domains: DataFrame, feed: DataFrame, key: str = KEY) -> DataFrame:
    return domains.join(feed.select(key).distinct(), key, "left_semi")
