"""Queries over domains and addresses."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from .. import refdata as R
from ..operators import domains as D
from ..operators import emails as E
from ..operators import identities as Q
from .registry import Registry

jobs = Registry()
lit = lambda x: R.literal(x, duck=True)
within = lambda items: "(" + ", ".join(map(lit, items)) + ")"
AS_OF = datetime.date(2025, 12, 31)

jobs.add("normalise_domain", lambda a: D.normalise_domain(a, "address").select("address", "domain"), "addresses", sql="SELECT address, regexp_replace(lower(CASE WHEN contains(address, '@') THEN substr(address, instr(address, '@') + 1) ELSE address END), '\\.$', '') AS domain FROM addresses")
LIST = f", zones AS (SELECT unnest({R.DOMAIN_ZONES}) AS zone), listing AS (SELECT d.domain, z.zone, code, CASE WHEN code IS NULL THEN 'clean' WHEN code IN {within(R.UNRELIABLE_CODES)} THEN 'unreliable' ELSE 'listed' END AS result FROM domains d CROSS JOIN zones z LEFT JOIN dnsbl_answers a ON a.name = d.domain AND a.zone = z.zone)"
jobs.add("dnsbl_listings", D.dnsbl_listings, "domains", "dnsbl_answers", sql=f"{LIST} SELECT * FROM listing")
_codes = R.values([("dbl", k, v) for k, v in R.DBL_CODES.items()] + [("zen", k, v) for k, v in R.ZEN_CODES.items()], "book, code, words")
_surbl = ", ".join(f"CASE WHEN b & {b} > 0 THEN {lit(n)} END" for b, n in R.SURBL_BITS).replace("b & ", "(b & ").replace(" > 0", ") > 0")
SURBL = f"CASE WHEN len(list_filter([{_surbl}], lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_filter([{_surbl}], lambda x: x IS NOT NULL), '+') ELSE 'listed (code: ' || code || ')' END"
jobs.add("decode_dnsbl", D.decode_dnsbl, "dnsbl_answers", sql=f"SELECT a.name, a.zone, a.code, CASE WHEN starts_with(zone, 'multi.surbl') THEN {SURBL.replace('code', 'a.code').replace('(a.code:', '(code:')} ELSE coalesce(words, 'listed (code: ' || a.code || ')') END AS meaning FROM (SELECT *, CAST(split_part(code, '.', 4) AS INT) AS b FROM dnsbl_answers) a LEFT JOIN (SELECT * FROM {_codes}) c ON c.code = a.code AND c.book = CASE WHEN starts_with(zone, 'zen.') THEN 'zen' ELSE 'dbl' END")
jobs.add("decode_surbl", lambda a: a.select("name", "code", D.decode_surbl(F.col("code")).alias("meaning")), "dnsbl_answers", sql=f"SELECT name, code, {SURBL} AS meaning FROM (SELECT *, CAST(split_part(code, '.', 4) AS INT) AS b FROM dnsbl_answers)")
REV = "split_part({0}, '.', 4) || '.' || split_part({0}, '.', 3) || '.' || split_part({0}, '.', 2) || '.' || split_part({0}, '.', 1)"
jobs.add("reverse_ipv4", lambda d: d.select("name", "value", D.reverse_ipv4(F.col("value")).alias("reversed")), "dns_records", sql=f"SELECT name, value, CASE WHEN rtype = 'A' THEN {REV.format('value')} END AS reversed FROM dns_records")
MX = ", mx AS (SELECT name AS domain, arg_min(rtrim(value, '.'), (priority, rtrim(value, '.'))) AS mx FROM dns_records WHERE rtype = 'MX' GROUP BY 1), addr AS (SELECT name, min(value) AS address FROM dns_records WHERE rtype = 'A' GROUP BY 1), host AS (SELECT coalesce(m.domain, a.name) AS domain, coalesce(mx, address) AS mx FROM mx m FULL JOIN addr a ON m.domain = a.name)"
jobs.add("primary_mx", D.primary_mx, "dns_records", sql=f"{MX} SELECT * FROM mx")
IPL = f"{MX}, ipz AS (SELECT unnest({R.IP_ZONES}) AS zone), iplist AS (SELECT h.domain, h.address, z.zone, code, CASE WHEN code IS NULL THEN 'clean' WHEN code IN {within(R.UNRELIABLE_CODES)} THEN 'unreliable' ELSE 'listed' END AS result FROM (SELECT m.domain, a.address, {REV.format('a.address')} AS rev FROM domains d JOIN mx m USING (domain) JOIN addr a ON m.mx = a.name) h CROSS JOIN ipz z LEFT JOIN dnsbl_answers x ON x.name = h.rev AND x.zone = z.zone)"
jobs.add("ip_dnsbl_listings", D.ip_dnsbl_listings, "domains", "dns_records", "dnsbl_answers", sql=f"{IPL} SELECT * FROM iplist")
SPF = r""", spfr AS (SELECT name AS domain, min(value) AS spf FROM dns_records WHERE rtype = 'TXT' AND contains(lower(value), 'v=spf1') GROUP BY 1), spf AS (SELECT domain, spf, lookups, coalesce(lookups >= 8, false) AS lookup_warning, policy, spf IS NULL OR policy = '+all' AS advisory FROM (SELECT d.domain, spf, CAST(len(list_filter(string_split(spf, ' '), lambda t: regexp_matches(t, '^(include:|a:|mx:|ptr:|exists:)') OR regexp_full_match(t, '[+~?-]?(a|mx)'))) AS INT) AS lookups,
 CASE WHEN contains(spf, '+all') THEN '+all' WHEN contains(spf, '~all') THEN '~all' WHEN contains(spf, '?all') THEN '?all' WHEN contains(spf, '-all') THEN '-all' WHEN spf IS NOT NULL THEN 'none' END AS policy FROM domains d LEFT JOIN spfr USING (domain)))"""
jobs.add("spf_policy", D.spf_policy, "domains", "dns_records", sql=f"{SPF} SELECT * FROM spf")
DMARC = ", dmarc AS (SELECT d.domain, r AS dmarc, CASE WHEN r IS NOT NULL THEN coalesce(nullif(lower(regexp_extract(r, '(?i)p=(none|quarantine|reject)', 1)), ''), 'unspecified') END AS policy FROM domains d LEFT JOIN (SELECT substr(name, 8) AS domain, min(value) AS r FROM dns_records WHERE rtype = 'TXT' AND starts_with(name, '_dmarc.') AND contains(lower(value), 'v=dmarc1') GROUP BY 1) USING (domain))"
jobs.add("dmarc_policy", D.dmarc_policy, "domains", "dns_records", sql=f"{DMARC} SELECT * FROM dmarc")
jobs.add("dkim_selector", D.dkim_selector, "domains", "dns_records", sql="SELECT domain, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'google' ELSE 's1' END END AS selector FROM domains")
NS = ", ns AS (SELECT d.domain, coalesce(array_to_string(list_sort(s), ','), '') AS nameservers, CAST(coalesce(len(s), 0) AS INT) AS n, s IS NULL AS hard FROM domains d LEFT JOIN (SELECT name AS domain, list(DISTINCT rtrim(value, '.')) AS s FROM dns_records WHERE rtype = 'NS' GROUP BY 1) USING (domain))"
jobs.add("nameserver_check", lambda d, r: D.nameserver_check(d, r).withColumn("nameservers", F.array_join("nameservers", ",")), "domains", "dns_records", sql=f"{NS} SELECT * FROM ns")
AGE = """, wh AS (SELECT domain, CAST(substr(domain, 2, length(domain) - 9) AS BIGINT) AS k FROM whois), cr AS (SELECT domain, CASE CAST(k % 7 AS INT) WHEN 0 THEN CAST('20' || CAST(10 + k % 16 AS VARCHAR) || '-03-04' AS DATE) WHEN 1 THEN CASE WHEN k % 2 = 0 THEN DATE '2007-01-05' ELSE DATE '2025-12-20' END WHEN 2 THEN DATE '2025-11-02' WHEN 5 THEN DATE '2025-10-15' WHEN 6 THEN DATE '2003-07-08' END AS created, CASE CAST(k % 7 AS INT) WHEN 3 THEN 'date_not_found' WHEN 4 THEN 'date_parse_failed' ELSE 'ok' END AS status FROM wh),
 age AS (SELECT domain, created, CAST(date_diff('day', created, DATE '2025-12-31') AS INT) AS age_days, CASE WHEN status <> 'ok' THEN status WHEN date_diff('day', created, DATE '2025-12-31') < 30 THEN 'hard_flagged' WHEN date_diff('day', created, DATE '2025-12-31') < 90 THEN 'advisory' ELSE 'ok' END AS status FROM cr)"""
jobs.add("whois_created", D.whois_created, "whois", sql=f"{AGE} SELECT * FROM cr")
jobs.add("domain_age", lambda w: D.domain_age(w, AS_OF), "whois", sql=f"{AGE} SELECT * FROM age")
RELAY = ", relay AS (SELECT domain, CASE WHEN a IS NULL THEN 'no_mx' WHEN a THEN 'open' WHEN r THEN 'closed' ELSE 'inconclusive' END AS relay FROM domains LEFT JOIN (SELECT domain, bool_or(accepted) AS a, bool_or(reached) AS r FROM relay_probes GROUP BY 1) USING (domain))"
jobs.add("open_relay", D.open_relay, "domains", "relay_probes", sql=f"{RELAY} SELECT * FROM relay")
VERDICT = f"""{LIST}{IPL}{SPF}{DMARC}{NS}{AGE}{RELAY}, checks AS (SELECT d.domain, ns.hard AS no_ns, host.mx, spf.advisory AS spf_advisory, dmarc.dmarc, coalesce(dh, 0) > 0 AS blocked, coalesce(ih, 0) > 0 AS by_ip, age.status AS age, relay FROM domains d JOIN ns USING (domain) LEFT JOIN host USING (domain) JOIN spf USING (domain) JOIN dmarc USING (domain) LEFT JOIN age USING (domain) JOIN relay USING (domain)
 LEFT JOIN (SELECT domain, count(*) AS dh FROM listing WHERE result = 'listed' GROUP BY 1) USING (domain) LEFT JOIN (SELECT domain, count(*) AS ih FROM iplist WHERE result = 'listed' GROUP BY 1) USING (domain)),
 verdict AS (SELECT domain, CAST(no_ns AS INT) + CAST(blocked AS INT) + CAST(by_ip AS INT) + CAST(age = 'hard_flagged' AS INT) + CAST(relay = 'open' AS INT) AS hard_flags, CAST(mx IS NULL AS INT) + CAST(spf_advisory AS INT) + CAST(dmarc IS NULL AS INT) + CAST(age IN ('advisory', 'date_not_found', 'date_parse_failed') AS INT) AS advisory_flags, CASE WHEN blocked OR by_ip OR relay = 'open' THEN 'FLAGGED' WHEN age = 'hard_flagged' THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict FROM checks)"""
TABLES = ("domains", "dns_records", "dnsbl_answers", "whois", "relay_probes")
_verdict = lambda d, r, a, w, p: D.domain_verdict(D.domain_checks(d, r, a, w, p, AS_OF))
jobs.add("domain_verdict", _verdict, *TABLES, sql=f"{VERDICT} SELECT * FROM verdict")
jobs.add("domain_summary", lambda *t: D.domain_summary(_verdict(*t)), *TABLES, sql=f"{VERDICT} SELECT count(*) AS total, count(*) FILTER (hard_flags = 0) AS passed, count(*) FILTER (hard_flags > 0) AS failed FROM verdict")

# --- addresses ---
ROLE_ROWS = R.values([(b, r, R.ROLE_POINTS[r]) for b, r in R.pairs(R.ROLES)], "bare, role, points")
SYN = r", syn AS (SELECT lower(address) AS address, k, split_part(lower(address), '@', 1) AS local, regexp_matches(lower(address), '^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$') AS valid, regexp_replace(substr(lower(address), instr(address, '@') + 1), '\.$', '') AS domain FROM addresses)"
EMAIL = f"""{SYN}{MX}, rol AS (SELECT s.*, role, CAST(coalesce(CASE WHEN s.bare NOT IN ('sales') THEN points END, 0) AS INT) AS role_points, coalesce(role IS NOT NULL AND s.bare = 'sales', false) AS role_exempt FROM (SELECT *, split_part(local, '+', 1) AS bare FROM syn) s LEFT JOIN (SELECT * FROM {ROLE_ROWS}) r USING (bare)),
 dis AS (SELECT *, domain = 'mailinator.example' AS disposable FROM rol), ptrs AS (SELECT mx, CASE WHEN regexp_full_match(mx, '[0-9.]+') OR mx IN (SELECT name FROM addr) THEN 'none' ELSE 'unresolved' END AS ptr FROM (SELECT DISTINCT mx FROM host WHERE mx IS NOT NULL)),
 chk AS (SELECT *, CAST(CASE catchall WHEN 'known_catchall_provider' THEN -20 WHEN 'google_workspace_mx' THEN -5 WHEN 'microsoft365_mx' THEN -5 ELSE 0 END AS INT) AS catchall_points FROM (SELECT d.*, h.mx, CASE WHEN ptr = 'unresolved' THEN -5 ELSE 0 END AS ptr_points, CASE WHEN d.domain IN {within(R.CATCHALL_DOMAINS)} THEN 'known_catchall_provider' WHEN ends_with(h.mx, '.google.com') OR ends_with(h.mx, '.googlemail.com') THEN 'google_workspace_mx' WHEN ends_with(h.mx, '.protection.outlook.com') THEN 'microsoft365_mx' END AS catchall FROM dis d LEFT JOIN host h ON d.domain = h.domain LEFT JOIN ptrs p ON h.mx = p.mx))"""
jobs.add("email_syntax", lambda a: E.email_syntax(a).select("address", "local", "domain", "valid"), "addresses", sql=f"{SYN} SELECT address, local, domain, valid FROM syn")
jobs.add("email_role", lambda a: E.email_role(E.email_syntax(a), ("sales",)).select("address", "role", "role_exempt", "role_points"), "addresses", sql=f"{EMAIL} SELECT address, role, role_exempt, role_points FROM rol", also=("dns_records",))
_block = lambda a: R.small(a.sparkSession, [("mailinator.example",), ("trash.example",)], "domain")
jobs.add("disposable_domain", lambda a: E.disposable_domain(E.email_syntax(a), _block(a)).select("address", "disposable"), "addresses", sql=f"{EMAIL} SELECT address, disposable FROM dis", also=("dns_records",))
jobs.add("catchall_provider", lambda a, r: E.catchall_provider(E.email_syntax(a).join(D.mail_host(r), "domain", "left")).select("address", "mx", "catchall", "catchall_points"), "addresses", "dns_records", sql=f"{EMAIL} SELECT address, mx, catchall, catchall_points FROM chk")
jobs.add("ptr_match", lambda r: E.ptr_match(D.mail_host(r), r), "dns_records", sql=f"{MX} SELECT mx, ptr, CASE WHEN ptr = 'unresolved' THEN -5 ELSE 0 END AS ptr_points FROM (SELECT mx, CASE WHEN regexp_full_match(mx, '[0-9.]+') OR mx IN (SELECT name FROM addr) THEN 'none' ELSE 'unresolved' END AS ptr FROM (SELECT DISTINCT mx FROM host WHERE mx IS NOT NULL))")
_scored = lambda a, r, p: E.email_score(E.email_checks(a, _block(a), r), p)
T = "(valid AND mx IS NOT NULL AND catchall IS NULL AND rc IS NOT NULL)"
SCORE = f"""{EMAIL.replace("CASE WHEN s.bare NOT IN ('sales') THEN points END", "points")}, j AS (SELECT c.*, p.* EXCLUDE (address), {T} AS probed FROM chk c LEFT JOIN smtp_probes p USING (address)),
 scr AS (SELECT *, CAST(CASE WHEN valid THEN role_points + CASE WHEN disposable THEN -50 ELSE 0 END ELSE 0 END + CASE WHEN valid AND mx IS NOT NULL THEN 20 + catchall_points + ptr_points ELSE 0 END + CASE WHEN probed THEN CASE WHEN rc <> 2 THEN CASE WHEN connected THEN 20 ELSE 0 END + CASE WHEN banner THEN 15 ELSE 0 END + CASE WHEN mail_from AND rc <> 3 THEN 10 ELSE 0 END ELSE 0 END
 + CASE rc WHEN 0 THEN 60 + CASE WHEN tls THEN 5 ELSE 0 END WHEN 1 THEN -80 WHEN 2 THEN CASE WHEN fallback_alive THEN 5 ELSE -20 END WHEN 3 THEN -10 WHEN 4 THEN -15 ELSE 30 END + CASE WHEN open_relay THEN -70 ELSE 0 END ELSE 0 END AS INT) AS score,
 CASE WHEN NOT valid OR mx IS NULL THEN 'UNDELIVERABLE' WHEN probed AND open_relay THEN 'UNVERIFIABLE' WHEN probed AND rc = 0 THEN 'VERIFIED' WHEN probed AND rc = 1 THEN 'UNDELIVERABLE' WHEN probed AND rc = 4 THEN 'UNVERIFIABLE' END AS hard_verdict FROM j),
 ev AS (SELECT address, score, coalesce(hard_verdict, CASE WHEN score >= 60 THEN 'LIKELY DELIVERABLE' WHEN score >= 20 THEN 'PROBABLY DELIVERABLE' WHEN score >= -10 THEN 'INCONCLUSIVE' ELSE 'PROBABLY UNDELIVERABLE' END) AS verdict, coalesce(hard_verdict = 'VERIFIED', score >= 20) AS passed FROM scr)"""
EMAILS = ("addresses", "dns_records", "smtp_probes")
jobs.add("email_score", lambda *t: _scored(*t).select("address", "score", "hard_verdict"), *EMAILS, sql=f"{SCORE} SELECT address, score, hard_verdict FROM scr")
jobs.add("email_verdict", lambda *t: E.email_verdict(_scored(*t)), *EMAILS, sql=f"{SCORE} SELECT * FROM ev")
jobs.add("email_summary", lambda *t: E.email_summary(E.email_verdict(_scored(*t))), *EMAILS, sql=f"{SCORE} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (verdict = 'UNVERIFIABLE') AS unverifiable FROM ev")

# --- publishers ---
IDENTITIES = """, pk AS (SELECT package_id, nullif(regexp_replace(trim(lower(author)), '\\s+', ' ', 'g'), '') AS author, nullif(trim(regexp_replace(lower(address), '^mailto:', '')), '') AS address, lower(domain) AS domain FROM publishers),
 ky AS (SELECT DISTINCT package_id, kind, value FROM (SELECT package_id, 'author' AS kind, author AS value FROM pk UNION ALL SELECT package_id, 'address', address FROM pk UNION ALL SELECT package_id, 'domain', coalesce(domain, nullif(regexp_extract(address, '@([^@]+)$', 1), '')) FROM pk) WHERE value IS NOT NULL),
 few AS (SELECT kind, value FROM ky GROUP BY ALL HAVING count(*) <= 50), ln AS (SELECT DISTINCT x.package_id AS a, y.package_id AS b FROM ky x JOIN ky y USING (kind, value) JOIN few USING (kind, value)),
 far(a, b) AS (SELECT package_id, package_id FROM pk UNION SELECT far.a, ln.b FROM far JOIN ln ON far.b = ln.a), pub AS (SELECT a AS package_id, min(b) AS publisher FROM far GROUP BY 1)"""
jobs.add("publisher_identities", Q.publisher_identities, "publishers", sql=f"{IDENTITIES} SELECT * FROM pub")
jobs.add("publisher_rollup", lambda p: Q.publisher_rollup(Q.publisher_identities(p), p.select("package_id", "verdict"), ("FLAGGED", "SUSPICIOUS", "CLEAN")), "publishers", sql=f"""{IDENTITIES}, v AS (SELECT package_id, CASE verdict WHEN 'FLAGGED' THEN 1 WHEN 'SUSPICIOUS' THEN 2 WHEN 'CLEAN' THEN 3 END AS o FROM publishers)
 SELECT publisher, count(*) AS packages, count(o) AS judged, CASE min(o) WHEN 1 THEN 'FLAGGED' WHEN 2 THEN 'SUSPICIOUS' WHEN 3 THEN 'CLEAN' END AS worst, count(*) FILTER (o < 3) AS doubtful FROM pub JOIN v USING (package_id) GROUP BY 1""")
for _name in ("publisher_identities", "publisher_rollup"):
    jobs.sql[_name] = jobs.sql[_name].replace("WITH ", "WITH RECURSIVE ", 1)
