"""Address validation: syntax, roles, disposable and catch-all domains, mail hosts, probes, score and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import listed
from ..refdata import CATCHALL_DOMAINS, ROLE_POINTS, ROLES, pairs, small
from . import domains as D

SYNTAX = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"


def email_syntax(addresses: DataFrame) -> DataFrame:
    """Lower-cases address and adds local, domain and valid."""
    rows = addresses.withColumn("address", F.lower("address"))
    return D.normalise_domain(rows.withColumns({"local": F.substring_index("address", "@", 1), "valid": F.col("address").rlike(SYNTAX)}), "address")


def email_role(addresses: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Adds role, role_exempt and role_points; addresses have local. A +tag is no part of the name."""
    table = small(addresses.sparkSession, pairs(ROLES), "bare, role")
    rows = addresses.withColumn("bare", F.split_part(F.lower("local"), F.lit("+"), F.lit(1))).join(F.broadcast(table), "bare", "left")
    spared = F.col("role").isNotNull() & F.col("bare").isin(*exempt) if exempt else F.lit(False)
    points = F.coalesce(*(F.when(F.col("role") == r, p) for r, p in ROLE_POINTS.items()))
    return rows.withColumn("role_exempt", spared).withColumn("role_points", F.when(F.col("role_exempt"), 0).otherwise(F.coalesce(points, F.lit(0)))).drop("bare")


def disposable_domain(addresses: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Adds disposable. blocklist (domain) may be long; Spark broadcasts it only if it is small."""
    known = blocklist.select("domain").distinct().withColumn("disposable", F.lit(True))
    return addresses.join(known, "domain", "left").withColumn("disposable", F.coalesce("disposable", F.lit(False)))


def catchall_provider(addresses: DataFrame) -> DataFrame:
    """Adds catchall, catchall_points: a known provider, else the mail host's; such addresses aren't probed. Needs domain and mx."""
    mx = F.col("mx")
    reason = (
        F.when(F.col("domain").isin(CATCHALL_DOMAINS), "known_catchall_provider")
        .when(mx.endswith(".google.com") | mx.endswith(".googlemail.com"), "google_workspace_mx")
        .when(mx.endswith("mail.protection.outlook.com") | mx.endswith(".protection.outlook.com"), "microsoft365_mx")
    )
    return addresses.withColumn("catchall", reason).withColumn("catchall_points", F.when(F.col("catchall") == "known_catchall_provider", -20).when(F.col("catchall").isNotNull(), -5).otherwise(0))


def _parent(host: Column) -> Column:
    return F.regexp_replace(host, r"^[^.]*\.", "")


def ptr_match(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """hosts (mx) -> (mx, ptr, ptr_points): the same host or parent domain +15, another +5, none 0, no address -5."""
    names = hosts.select("mx").filter("mx is not null").distinct()
    is_address = F.col("mx").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    rows = names.join(D.first_address(dns).withColumnRenamed("name", "mx"), "mx", "left").withColumn("address", F.when(is_address, F.col("mx")).otherwise(F.col("address")))
    pointers = dns.filter("rtype = 'PTR'").groupBy("name").agg(F.min(F.regexp_replace("value", r"\.$", "")).alias("pointer"))
    rows = rows.withColumn("name", F.concat(D.reverse_ipv4(F.col("address")), F.lit(".in-addr.arpa"))).join(pointers, "name", "left")
    same = (F.col("pointer") == F.col("mx")) | (_parent(F.col("pointer")) == _parent(F.col("mx")))
    ptr = F.when(F.col("address").isNull(), "unresolved").when(F.col("pointer").isNull(), "none").when(same, "match").otherwise("mismatch")
    return rows.select("mx", ptr.alias("ptr")).withColumn("ptr_points", F.when(F.col("ptr") == "match", 15).when(F.col("ptr") == "mismatch", 5).when(F.col("ptr") == "unresolved", -5).otherwise(0))


def email_checks(addresses: DataFrame, blocklist: DataFrame, dns: DataFrame) -> DataFrame:
    """All checks before the probe, one row for each address. Mail hosts are settled once for each domain."""
    rows = disposable_domain(email_role(email_syntax(addresses)), blocklist)
    hosts = D.mail_host(dns)
    hosts = hosts.join(ptr_match(hosts, dns), "mx", "left")
    return catchall_provider(rows.join(hosts, "domain", "left"))


def email_score(checks: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds score, score_log and hard_verdict. probes (address, rc, connected, banner, mail_from, tls, open_relay, fallback_alive).

    The log lists every step with points, in order, as `points step`.
    """
    rows = checks.join(probes, "address", "left")
    found = F.col("valid") & F.col("mx").isNotNull()
    probed = found & F.col("catchall").isNull() & F.col("rc").isNotNull()
    rc = F.col("rc")
    step = lambda test, points, name: F.when(test & (F.lit(points) != 0 if isinstance(points, int) else points != 0), F.struct(F.lit(points).alias("points") if isinstance(points, int) else points.cast("int").alias("points"), F.lit(name).alias("step")))
    talks = probed & (rc != 2)
    steps = listed(
        step(F.col("valid"), F.col("role_points"), "role address"),
        step(F.col("valid") & F.col("disposable"), -50, "disposable domain"),
        step(found, 20, "mx found"),
        step(found, F.col("catchall_points"), "catch-all provider"),
        step(found, F.coalesce("ptr_points", F.lit(0)), "ptr"),
        step(talks & F.col("connected"), 20, "connected"),
        step(talks & F.col("banner"), 15, "banner"),
        step(talks & F.col("mail_from") & (rc != 3), 10, "mail from accepted"),
        step(probed & rc.isin(0, 4, 5), 35, "recipient accepted"),
        step(probed & (rc == 0), 25, "catch-all probe rejected"),
        step(probed & (rc == 0) & F.col("tls"), 5, "tls"),
        step(probed & (rc == 1), -80, "recipient rejected"),
        step(probed & (rc == 2) & F.col("fallback_alive"), 5, "alive on fallback port"),
        step(probed & (rc == 2) & ~F.col("fallback_alive"), -20, "all ports blocked"),
        step(probed & (rc == 3), -10, "dialogue failed"),
        step(probed & (rc == 4), -50, "catch-all confirmed"),
        step(probed & (rc == 5), -5, "catch-all inconclusive"),
        step(probed & F.col("open_relay"), -70, "open relay"),
    )
    hard = (
        F.when(~F.col("valid") | F.col("mx").isNull(), "UNDELIVERABLE").when(probed & F.col("open_relay"), "UNVERIFIABLE")
        .when(probed & (rc == 0), "VERIFIED").when(probed & (rc == 1), "UNDELIVERABLE").when(probed & (rc == 4), "UNVERIFIABLE")
    )
    rows = rows.withColumn("steps", steps).withColumn("hard_verdict", hard)
    total = F.aggregate("steps", F.lit(0), lambda a, s: a + s["points"])
    log = F.array_join(F.transform("steps", lambda s: F.concat(s["points"].cast("string"), F.lit(" "), s["step"])), "; ")
    return rows.withColumns({"score": total, "score_log": log}).drop("steps")


def email_verdict(scores: DataFrame) -> DataFrame:
    """(address, score, verdict, passed): a hard verdict first, else by bands of the score."""
    score = F.col("score")
    verdict = F.coalesce("hard_verdict", F.when(score >= 60, "LIKELY DELIVERABLE").when(score >= 20, "PROBABLY DELIVERABLE").when(score >= -10, "INCONCLUSIVE").otherwise("PROBABLY UNDELIVERABLE"))
    passed = F.coalesce(F.col("hard_verdict") == "VERIFIED", score >= 20)
    return scores.select("address", "score", verdict.alias("verdict"), passed.alias("passed"))


def email_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("verdict") == "UNVERIFIABLE").alias("unverifiable"))
