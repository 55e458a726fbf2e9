"""Domain reputation from observation tables: DNS records, blocklist answers, WHOIS texts, relay probes.

dns_records (name, rtype, priority, value). Everything is computed once for each
domain; addresses join the verdicts afterwards.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..refdata import CREATED_FIELDS, DBL_CODES, DKIM_SELECTORS, DOMAIN_ZONES, IP_ZONES, SURBL_BITS, UNRELIABLE_CODES, ZEN_CODES, small


def normalise_domain(targets: DataFrame, column: str = "target") -> DataFrame:
    """Adds domain: what follows the first @, in lower case, without one trailing dot."""
    after = F.when(F.col(column).contains("@"), F.regexp_replace(column, "^[^@]*@", "")).otherwise(F.col(column))
    return targets.withColumn("domain", F.regexp_replace(F.lower(after), r"\.$", ""))


def reverse_ipv4(address: Column) -> Column:
    """The octets in reverse; null for what isn't IPv4."""
    return F.when(address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.array_join(F.reverse(F.split(address, r"\.")), "."))


def decode_surbl(code: Column) -> Column:
    bits = F.try_element_at(F.split(code, r"\."), F.lit(-1)).try_cast("int")
    names = F.filter(F.array(*(F.when(bits.bitwiseAND(F.lit(b)) > 0, F.lit(n)) for b, n in SURBL_BITS)), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise(F.concat(F.lit("listed (code: "), code, F.lit(")")))


def decode_dnsbl(answers: DataFrame) -> DataFrame:
    """Adds meaning to answers (zone, code, ...): by zone's code table, by bits for SURBL, else the code itself."""
    table = small(answers.sparkSession, [("dbl", k, v) for k, v in DBL_CODES.items()] + [("zen", k, v) for k, v in ZEN_CODES.items()], "book, code, words")
    book = F.when(F.col("zone").startswith("zen."), "zen").otherwise("dbl")
    rows = answers.withColumn("book", book).join(F.broadcast(table), ["book", "code"], "left")
    other = F.concat(F.lit("listed (code: "), F.col("code"), F.lit(")"))
    return rows.select(*answers.columns, F.when(F.col("zone").startswith("multi.surbl"), decode_surbl(F.col("code"))).otherwise(F.coalesce("words", other)).alias("meaning"))


def _listings(names: DataFrame, answers: DataFrame, zones: list[str]) -> DataFrame:
    """names (name, ...) held against every zone: (…, zone, code, result)."""
    rows = names.withColumn("zone", F.explode(F.array(*map(F.lit, zones))))
    found = rows.join(answers.select("name", "zone", "code"), ["name", "zone"], "left")
    result = F.when(F.col("code").isNull(), "clean").when(F.col("code").isin(UNRELIABLE_CODES), "unreliable").otherwise("listed")
    return found.withColumn("result", result)


def dnsbl_listings(domains: DataFrame, answers: DataFrame) -> DataFrame:
    """domains (domain) -> (domain, zone, code, result): listed, clean, or unreliable, which is ignored."""
    return _listings(domains.select("domain", F.col("domain").alias("name")), answers, DOMAIN_ZONES).select("domain", "zone", "code", "result")


def primary_mx(dns: DataFrame) -> DataFrame:
    """(domain, mx): the most preferred host, ties by name, without its trailing dot."""
    host = F.regexp_replace("value", r"\.$", "")
    return dns.filter("rtype = 'MX'").groupBy(F.col("name").alias("domain")).agg(F.min_by(host, F.struct(F.col("priority"), host)).alias("mx"))


def first_address(dns: DataFrame) -> DataFrame:
    return dns.filter("rtype = 'A'").groupBy("name").agg(F.min("value").alias("address"))


def mail_host(dns: DataFrame) -> DataFrame:
    """(domain, mx): the primary MX, or the domain's own address."""
    own = first_address(dns).select(F.col("name").alias("domain"), "address")
    return primary_mx(dns).join(own, "domain", "full").select("domain", F.coalesce("mx", "address").alias("mx"))


def ip_dnsbl_listings(domains: DataFrame, dns: DataFrame, answers: DataFrame) -> DataFrame:
    """(domain, address, zone, code, result): the address of each domain's primary MX held against the address zones."""
    hosts = domains.select("domain").join(primary_mx(dns), "domain").join(first_address(dns), F.col("mx") == F.col("name")).select("domain", "address", reverse_ipv4(F.col("address")).alias("name"))
    return _listings(hosts.filter("name is not null"), answers, IP_ZONES).select("domain", "address", "zone", "code", "result")


def _first_text(dns: DataFrame, marker: str) -> DataFrame:
    """(name, record): the first text record with a marker, in any case, without quotes."""
    rows = dns.filter((F.col("rtype") == "TXT") & F.lower("value").contains(marker))
    return rows.groupBy("name").agg(F.min(F.replace("value", F.lit('"'), F.lit(""))).alias("record"))


def spf_policy(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """(domain, spf, lookups, lookup_warning, policy, advisory)."""
    rows = domains.select("domain").join(_first_text(dns, "v=spf1").withColumnRenamed("name", "domain"), "domain", "left")
    counted = F.size(F.filter(F.split("record", r"\s+"), lambda t: t.rlike("^(include:|a:|mx:|ptr:|exists:)") | t.rlike(r"^[+\-~?]?(a|mx)$")))
    policy = F.when(F.col("record").contains("+all"), "+all").when(F.col("record").contains("~all"), "~all").when(F.col("record").contains("?all"), "?all").when(F.col("record").contains("-all"), "-all").when(F.col("record").isNotNull(), "none")
    lookups = F.when(F.col("record").isNotNull(), counted)
    return rows.select("domain", F.col("record").alias("spf"), lookups.alias("lookups"), F.coalesce(lookups >= 8, F.lit(False)).alias("lookup_warning"), policy.alias("policy"), (F.col("record").isNull() | (policy == "+all")).alias("advisory"))


def dmarc_policy(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """(domain, dmarc, policy): none, quarantine, reject, or unspecified; null without a record."""
    rows = domains.select("domain", F.concat(F.lit("_dmarc."), "domain").alias("name")).join(_first_text(dns, "v=dmarc1"), "name", "left")
    found = F.lower(F.regexp_extract("record", "(?i)p=(none|quarantine|reject)", 1))
    return rows.select("domain", F.col("record").alias("dmarc"), F.when(F.col("record").isNotNull(), F.coalesce(F.nullif(found, F.lit("")), F.lit("unspecified"))).alias("policy"))


def dkim_selector(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """(domain, selector): the first known selector with a key; informational."""
    known = small(dns.sparkSession, [(s, n) for n, s in enumerate(DKIM_SELECTORS)], "selector, n")
    keys = dns.filter((F.col("rtype") == "TXT") & F.lower("value").contains("v=dkim1") & F.col("name").contains("._domainkey."))
    keys = keys.select(F.split_part("name", F.lit("._domainkey."), F.lit(1)).alias("selector"), F.split_part("name", F.lit("._domainkey."), F.lit(2)).alias("domain")).join(F.broadcast(known), "selector")
    return domains.select("domain").join(keys.groupBy("domain").agg(F.min_by("selector", "n").alias("selector")), "domain", "left")


def nameserver_check(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """(domain, nameservers, n, hard): none is a hard flag, fewer than two only a note."""
    servers = dns.filter("rtype = 'NS'").groupBy(F.col("name").alias("domain")).agg(F.array_sort(F.collect_set(F.regexp_replace("value", r"\.$", ""))).alias("nameservers"))
    rows = domains.select("domain").join(servers, "domain", "left")
    n = F.coalesce(F.array_size("nameservers"), F.lit(0))
    return rows.select("domain", F.coalesce("nameservers", F.array().cast("array<string>")).alias("nameservers"), n.alias("n"), (n == 0).alias("hard"))


def whois_created(whois: DataFrame) -> DataFrame:
    """(domain, created, status): the first known field with a value; ok, date_not_found or date_parse_failed."""
    found = F.coalesce(*(F.nullif(F.trim(F.regexp_extract("raw", rf"(?mi)^[ \t]*{field}[ \t]*:[ ]*([^\r\n]*)", 1)), F.lit("")) for field in CREATED_FIELDS))
    rows = whois.withColumn("field", found)
    iso = F.nullif(F.regexp_extract("field", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    created = F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), F.try_to_timestamp("field", F.lit("dd-MMM-yyyy")), F.try_to_timestamp("field", F.lit("yyyy.MM.dd"))).cast("date")
    return rows.select("domain", created.alias("created"), F.when(F.col("field").isNull(), "date_not_found").when(created.isNull(), "date_parse_failed").otherwise("ok").alias("status"))


def domain_age(whois: DataFrame, as_of: datetime.date, min_age: int = 30, warn_age: int = 0) -> DataFrame:
    """(domain, created, age_days, status): hard_flagged under min_age, advisory under warn_age or three times min_age."""
    rows = whois_created(whois)
    age = F.datediff(F.lit(as_of), F.col("created"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(age < min_age, "hard_flagged").when(age < (warn_age or 3 * min_age), "advisory").otherwise("ok")
    return rows.select("domain", "created", age.alias("age_days"), status.alias("status"))


def open_relay(domains: DataFrame, probes: DataFrame) -> DataFrame:
    """(domain, relay): open, closed, inconclusive, or no_mx without any probe. probes (domain, port, reached, accepted)."""
    seen = probes.groupBy("domain").agg(F.bool_or("accepted").alias("accepted"), F.bool_or("reached").alias("reached"))
    rows = domains.select("domain").join(seen, "domain", "left")
    return rows.select("domain", F.when(F.col("accepted").isNull(), "no_mx").when(F.col("accepted"), "open").when(F.col("reached"), "closed").otherwise("inconclusive").alias("relay"))


def domain_checks(domains: DataFrame, dns: DataFrame, answers: DataFrame, whois: DataFrame, probes: DataFrame, as_of: datetime.date) -> DataFrame:
    """Everything that a verdict needs, one row for each domain."""
    listed = lambda df, name: df.groupBy("domain").agg(F.count_if(F.col("result") == "listed").alias(name))
    return (
        domains.select("domain").distinct()
        .join(nameserver_check(domains, dns).select("domain", F.col("hard").alias("no_ns")), "domain", "left").join(mail_host(dns), "domain", "left")
        .join(spf_policy(domains, dns).select("domain", F.col("advisory").alias("spf_advisory")), "domain", "left").join(dmarc_policy(domains, dns).select("domain", "dmarc"), "domain", "left")
        .join(listed(dnsbl_listings(domains, answers), "domain_hits"), "domain", "left").join(listed(ip_dnsbl_listings(domains, dns, answers), "ip_hits"), "domain", "left")
        .join(domain_age(whois, as_of).select("domain", F.col("status").alias("age")), "domain", "left").join(open_relay(domains, probes), "domain", "left")
    )


def domain_verdict(checks: DataFrame) -> DataFrame:
    """(domain, hard_flags, advisory_flags, verdict). A missing name server is a hard flag that leaves the verdict as it is."""
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    blocked, by_ip, relay = F.col("domain_hits") > 0, F.col("ip_hits") > 0, F.col("relay") == "open"
    young = F.col("age") == "hard_flagged"
    unknown_age = F.col("age").isin("advisory", "date_not_found", "date_parse_failed")
    hard = one(F.col("no_ns")) + one(blocked) + one(by_ip) + one(young) + one(relay)
    advisory = one(F.col("mx").isNull()) + one(F.col("spf_advisory")) + one(F.col("dmarc").isNull()) + one(unknown_age)
    verdict = F.when((one(blocked) + one(by_ip) + one(relay)) > 0, "FLAGGED").when(one(young) > 0, "SUSPICIOUS").otherwise("CLEAN")
    return checks.select("domain", hard.alias("hard_flags"), advisory.alias("advisory_flags"), verdict.alias("verdict"))


def domain_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hard_flags") == 0).alias("passed"), F.count_if(F.col("hard_flags") > 0).alias("failed"))
