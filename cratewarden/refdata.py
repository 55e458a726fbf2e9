"""The lists, tables, patterns and weights that results depend on, and how they become small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- files ---------------------------------------------------------------------------------------------

CATEGORY_ORDER = "code web markup config data docs images fonts media archives binaries secrets other".split()
TEXT_CATEGORIES = "code web markup config data".split()

#: Extensions by category; one that is in several belongs to the last.
CATEGORY_EXTENSIONS = {
    "code": "php js ts jsx tsx mjs cjs vue svelte py pyw rb pl pm sh bash zsh fish ksh csh go rs c cpp cc cxx h hpp hxx hh java kt kts scala clj cljs cljc groovy gradle swift m mm cs fs fsx vb r rmd lua zig nim v d ex exs erl hrl hs lhs ml mli ocaml sql plsql psql asm s nasm wasm wat dart coffee elm ino pde tf hcl nix bat makefile cmake rakefile gemfile",
    "web": "html htm xhtml css scss sass less styl svg",
    "markup": "md markdown mdx txt text asc rst tex latex adoc asciidoc org textile wiki log changelog license licence ftl",
    "config": "json json5 jsonc jsonl ndjson yaml yml toml ini conf cfg xml xsl xslt dtd xsd wsdl env properties plist htaccess htpasswd nginx editorconfig gitignore gitattributes gitmodules dockerignore browserslistrc babelrc eslintrc prettierrc stylelintrc npmrc nvmrc yarnrc flake8 pylintrc mypy isort bandit rubocop gemrc tsconfig lock neon dist pyml",
    "data": "csv tsv sql ndjson geojson graphql gql opml ics bru po pot catkeys",
    "docs": "pdf doc docx xls xlsx ppt pptx odt ods odp rtf epub mobi djvu",
    "images": "jpg jpeg png gif bmp webp avif ico tiff tif psd ai eps raw cr2 nef arw dng heic heif xcf",
    "fonts": "ttf otf woff woff2 eot",
    "media": "mp3 mp4 m4a m4v wav flac aac ogg opus wma avi mov mkv wmv webm mpg mpeg fla flv 3gp ogv",
    "archives": "zip tar gz bz2 xz zst lz4 7z rar tgz tbz2 txz jar war ear deb rpm pkg dmg iso img",
    "binaries": "o obj so dll dylib a lib exe com bin out elf msi appimage class pyc pyo pyd whl egg beam mo",
    "secrets": "pem key crt csr cer p12 pfx jks pub",
}

#: Names without an extension, in lower case.
KNOWN_NAMES = {
    "code": "makefile rakefile gemfile cakefile gruntfile gulpfile justfile taskfile",
    "config": "dockerfile vagrantfile procfile brewfile .gitkeep .imgbotconfig .eslintignore .prettierignore .stylelintignore .npmignore .dockerignore .hgignore .bzrignore",
    "markup": "license licence copying readme changelog changes authors contributors news history todo",
}

#: Conventional files: key, where it may lie (root, or two levels deep), name patterns in order of preference.
BEST_PRACTICES = [
    ("readme", "root", "readme.md readme.txt readme"),
    ("license", "root", "license license.md license.txt copying"),
    ("security", "root", "security.md security.txt"),
    ("contributing", "root", "contributing.md contributing.txt"),
    ("changelog", "root", "changelog.md changelog.txt changes.md history.md"),
    ("code_of_conduct", "root", "code_of_conduct.md code_of_conduct.txt"),
    ("notice", "root", "notice notice.md notice.txt"),
    ("maintainers", "root", "maintainers maintainers.md maintainers.txt"),
    ("governance", "root", "governance.md governance.txt"),
    ("codeowners", "deep", "codeowners"),
    ("sbom", "deep", "sbom.json sbom.xml bom.json bom.xml *.cdx.json *.spdx.json *.spdx *.spdx.txt"),
]

EXCLUDED_DIRS = ".git .svn .hg node_modules vendor venv .venv __pycache__".split()

# --- content -------------------------------------------------------------------------------------------

#: Extensions that the content scan never opens.
SKIPPED_EXTENSIONS = "jpg jpeg png gif bmp webp avif ico tiff tif psd raw cr2 nef heic mp3 mp4 m4a wav flac ogg avi mov mkv wmv webm mpg zip tar gz bz2 xz 7z rar tgz jar war deb rpm dmg iso ttf otf woff woff2 eot pdf doc docx xls xlsx ppt pptx odt ods odp rtf epub exe dll so dylib o obj class pyc pyo beam sqlite db".split()

SCAN_LIMIT = 10 * 1024 * 1024

#: Patterns 1 to 37, without regard to case, and the first and last number of each type with its severity.
PATTERNS = [
    r"bash\s+-i\s+>&\s+/dev/tcp/",
    r"/bin/(ba)?sh\s*-i\s*<\s*/dev/tcp",
    r"nc(\s+-(e|c)|\.traditional)\s.*/bin/(ba)?sh",
    r"perl\s.*Socket.*STDIN",
    r"python[23]?\s.*socket.*\bdup2\b",
    r"ruby\s.*TCPSocket.*(exec|system|spawn)",
    r"php\s.*fsockopen.*(exec|system|passthru)",
    r"\bsocat\b.*EXEC:",
    r"coinhive",
    r"cryptonight",
    r"monero.{0,20}(min|pool)",
    r"stratum\+tcp://",
    r"\bxmrig\b",
    r"cryptoloot",
    r"eval\s*\(\s*(base64_decode|atob)\s*\(",
    r"\bFunction\s*\(\s*atob\s*\(",
    r"exec\s*\(\s*(base64\.b64decode|bytes\.fromhex)",
    r"\bfromCharCode\s*\(.{80,}\)",
    r"(\\x[0-9a-fA-F]{2}\s*\.?\s*){8,}",
    r"(chr\s*\(\s*[0-9]+\s*\)\s*\.?\s*){6,}",
    r"gzinflate\s*\(\s*base64_decode",
    r"\bpreg_replace\s*\(.*/e['\"]",
    r"curl\b.+--data.*@",
    r"curl\b.+-d\s+@",
    r"wget\b.+--post-file",
    r"fetch\s*\(.+method.*POST.+document\.(cookie|location)",
    r"XMLHttpRequest.+send\s*\(.+document\.",
    r"system\s*\(\s*\$_(GET|POST|REQUEST|COOKIE|SERVER)",
    r"shell_exec\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)",
    r"passthru\s*\(\s*\$_(GET|POST|REQUEST)",
    r"\bpopen\s*\(\s*\$_(GET|POST|REQUEST)",
    r"proc_open\s*\(\s*\$_(GET|POST|REQUEST)",
    r"\bassert\s*\(\s*\$_(GET|POST|REQUEST)",
    r"create_function\s*\(.+\$_(GET|POST|REQUEST)",
    r"\bpreg_replace\s*\(.+/e.+\$_(GET|POST)",
    r"call_user_func(_array)?\s*\(\s*\$_(GET|POST)",
    r"\$\{?\$_(GET|POST|REQUEST)\s*\[.{0,30}\]\}?\s*\(",
]
#: Every text that meets a pattern holds one of these, in some case.
PATTERN_WORDS = r"/dev/tcp /bin/ socket fsockopen socat coinhive cryptonight monero stratum+tcp:// xmrig cryptoloot base64_decode atob b64decode fromhex fromcharcode \x chr gzinflate preg_replace curl --post-file document. $_".split()
PATTERN_TYPES = [("reverse_shell", "CRITICAL", 1, 8), ("crypto_miner", "CRITICAL", 9, 14), ("obfuscation", "HIGH", 15, 22), ("data_exfil", "HIGH", 23, 27), ("webshell", "MEDIUM", 28, 37)]

#: Script in markup, the vocabularies in which XML is scriptable, and program text where none belongs.
ACTIVE_MARKUP = r"(</?script[\s>]|\bon[a-z]+\s*=|javascript\s*:|<foreignObject)"
MARKUP_NAMESPACE = r"""xmlns[^=]*=\s*["'](http://www\.w3\.org/2000/svg|http://www\.w3\.org/1999/xhtml|http://www\.w3\.org/1999/XSL/Transform)"""
PROGRAM_TEXT = r"(<\?php|<%(eval|exec|system))"

#: Content types that an extension must have, whole.
STRICT_TYPES = {
    "jpg jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/(bmp|x-ms-bmp)",
    "ico": r"image/(x-icon|vnd\.microsoft\.icon)", "tiff tif": "image/tiff", "avif": "image/avif", "svg": r"image/svg\+xml",
    "pdf": "application/pdf", "doc": "application/msword", "docx xlsx pptx": r"application/(vnd\.openxmlformats-officedocument\..+|zip)",
    "xls": r"application/vnd\.ms-excel", "ppt": r"application/vnd\.ms-powerpoint", "odt ods": r"application/(vnd\.oasis\..+|zip)",
    "zip": "application/zip", "gz tgz": "application/(x-)?gzip", "bz2": "application/x-bzip2", "xz": "application/x-xz", "tar": "application/x-tar", "7z": "application/x-7z", "rar": r"application/(x-rar|vnd\.rar)",
    "ttf": "(font/sfnt|font/ttf|application/(x-font-ttf|font-sfnt|octet-stream))", "otf": r"(font/otf|application/(x-font-opentype|font-sfnt|vnd\.ms-opentype))",
    "woff": "(font/woff|application/(font-woff|x-font-woff))", "woff2": "(font/woff2|application/font-woff2)", "eot": r"application/vnd\.ms-fontobject",
    "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/(x-)?wav", "ogg": "(audio|video)/ogg", "webm": "video/webm",
}
#: Strict extensions for which an undetermined type (octet-stream) is a mismatch too.
UNFORGIVEN_EXTENSIONS = "jpg jpeg png gif bmp webp pdf".split()
TEXT_EXTENSIONS = "js mjs cjs jsx ts tsx vue svelte json json5 jsonc xml xsl xslt xsd html htm xhtml css scss sass less php phtml php5 php7 py pyw rb pl pm sh bash zsh go rs c cpp h hpp java kt scala groovy swift cs vb r lua sql md txt rst tex csv tsv yaml yml toml ini conf cfg rtf env log".split()
BINARY_TYPE = r"^(image/|audio/|video/|application/(octet-stream|x-executable|x-mach-binary|x-dosexec|x-sharedlib|x-archive|x-pie-executable|zip|gzip|pdf|msword|vnd\.))"
EXECUTABLE_TYPE = r"^(text/x-(php|python|ruby|perl|shellscript|javascript)|application/(x-php|x-python|x-ruby|x-perl|x-shellscript|x-executable|x-mach-binary|x-dosexec|x-sharedlib|x-pie-executable))"
SCRIPTABLE_EXTENSIONS = "svg xhtml xht xsl xslt".split()
CODELESS_EXTENSIONS = "jpg jpeg png gif bmp ico webp tiff tif pdf".split()
EXECUTABLE_EXTENSIONS = "php phtml php5 php7 phar js jsp jspx asp aspx py pl rb sh bash cgi exe bat cmd com scr msi ps1 vbs wsf".split()
SAFE_PAIRS = "tar.gz tar.bz2 tar.xz tar.zst tar.lz4 min.js min.css d.ts".split()
#: Extensions that look like data in the second-last place.
DATA_LIKE_EXTENSIONS = "jpg jpeg png gif bmp pdf doc docx xls xlsx txt csv zip mp3 mp4".split()
IMAGE_EXTENSIONS = "jpg jpeg png gif webp bmp ico tiff tif avif svg".split()

#: Leading bytes in hexadecimal, and the type that they give; the first that fits counts.
SIGNATURES = [
    ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("00000100", "image/x-icon"),
    ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2"), ("FD377A585A00", "application/x-xz"), ("377ABCAF271C", "application/x-7z"), ("526172211A07", "application/x-rar"),
    ("7F454C46", "application/x-executable"), ("4D5A", "application/x-dosexec"), ("CAFEBABE", "application/x-mach-binary"), ("774F4646", "font/woff"), ("774F4632", "font/woff2"), ("494433", "audio/mpeg"), ("4F676753", "audio/ogg"),
    ("3C3F706870", "text/x-php"), ("23212F62696E2F62617368", "text/x-shellscript"), ("23212F62696E2F7368", "text/x-shellscript"), ("23212F7573722F62696E2F707974686F6E", "text/x-python"), ("3C737667", "image/svg+xml"), ("3C21444F4354595045", "text/html"),
]

CONTENT_WEIGHTS = {
    "reverse_shell": 500, "crypto_miner": 500, "embedded_critical": 400, "mismatch_critical": 300, "deceptive": 300, "obfuscation": 200, "data_exfil": 200, "embedded_high": 150, "mismatch_high": 150, "hygiene_high": 150, "webshell": 100, "hygiene_medium": 75,
}

# --- permissions ---------------------------------------------------------------------------------------

NO_EXEC_EXTENSIONS = "jpg jpeg png gif bmp svg webp ico tiff tif psd ai eps pdf doc docx xls xlsx ppt pptx odt ods odp rtf txt md rst html htm css json xml xsl xslt yaml yml toml csv tsv sql sqlite db log lock pid bak env conf cfg ini htaccess gitignore gitattributes editorconfig dockerignore nvmrc npmrc eslintrc prettierrc ttf otf woff woff2 eot mp3 mp4 m4a wav flac ogg avi mov mkv wmv webm mpg mpeg zip tar gz bz2 xz 7z rar tgz tpl twig blade mustache hbs ejs jinja jinja2 j2 map min patch diff pem crt csr key pub asc license readme changelog php".split()
SENSITIVE_NAMES = ".env .env.local .env.production .env.staging .env.development .htpasswd shadow shadow- gshadow gshadow- id_rsa id_ed25519 id_ecdsa id_dsa credentials .netrc .pgpass".split()
SENSITIVE_EXTENSIONS = "pem key p12 pfx jks keystore secret".split()
ARTIFACT_DIRS = ".git .svn .hg .bzr .idea .vscode".split()
ARTIFACT_FILES = ".DS_Store Thumbs.db .gitignore .gitattributes desktop.ini".split()
SECURE_MODES = [400, 440, 444, 500, 550, 555, 600, 700]
#: issue, weight, whether it fails the package, whether it counts as an issue
PERMISSION_WEIGHTS = [
    ("world_writable_file", 10, True, True), ("world_writable_dir", 15, True, True), ("sticky_missing", 20, True, True), ("privilege_escalation", 20, True, True), ("inversion", 30, True, True), ("external_link", 25, True, True), ("sensitive_exposed", 25, True, True),
    ("internal_link", 5, False, False), ("dangling_link", 10, False, True), ("unneeded_exec", 3, False, True), ("orphan_owner", 10, False, True), ("deploy_artifact", 8, False, True), ("secure_permissions", 0, False, False),
]

# --- SBOMs, manifests ----------------------------------------------------------------------------------

#: Suffixes that a package's file name loses, in this order.
NAME_SUFFIXES = ".checksum.json .provenance.json .slsa-assessment.json .spdx.json .cdx.json .vuln.json .license.json .deps-audit.json .compare.json .discover.json .json .tar.gz .tar.bz2 .tgz .zip".split()
MANIFEST_TYPES = {
    "composer.json": "composer_metadata", "composer.lock": "composer_lockfile", "package.json": "npm_metadata", "package-lock.json": "npm_lockfile", "yarn.lock": "yarn_lockfile", "requirements.txt": "pip_requirements", "Pipfile": "pipenv_metadata", "Pipfile.lock": "pipenv_lockfile",
    "Gemfile": "bundler_metadata", "Gemfile.lock": "bundler_lockfile", "go.mod": "go_modules_metadata", "go.sum": "go_modules_lockfile", "pom.xml": "maven_pom", "build.gradle": "gradle_build", "Cargo.toml": "cargo_metadata", "Cargo.lock": "cargo_lockfile", "Podfile": "cocoapods_metadata", "Podfile.lock": "cocoapods_lockfile",
}
#: Endings of candidate paths and their rank; the last that fits counts, and 50 stands for none.
CANDIDATE_PRIORITY = [
    (".spdx.json", 1), (".cdx.json", 2), ("bom.json", 3), ("sbom.json", 4), (".spdx", 5), ("composer.lock", 10), ("package-lock.json", 11), ("yarn.lock", 12), ("Pipfile.lock", 13), ("Gemfile.lock", 14), ("go.sum", 15), ("Cargo.lock", 16),
]

# --- licenses ------------------------------------------------------------------------------------------

LICENSES = {
    "permissive": "MIT MIT-0 MIT-License BSD-2-Clause BSD-3-Clause BSD-4-Clause BSD-2-Clause-Patent BSD BSD-Style Apache-2.0 Apache-1.1 Apache-1.0 ISC Unlicense 0BSD Python-2.0 PSF-2.0 PSF Zlib zlib BSL-1.0 W3C X11 WTFPL CC0-1.0 Artistic-2.0 PHP-3.0 PHP-3.01 PostgreSQL Ruby curl Libpng libpng CC-BY-4.0 CC-BY-3.0 FTL Beerware HPND NTP Naumen",
    "weak_copyleft": "LGPL-2.0 LGPL-2.1 LGPL-3.0 LGPL-2.0-only LGPL-2.1-only LGPL-3.0-only LGPL-2.0-or-later LGPL-2.1-or-later LGPL-3.0-or-later LGPL-2.0+ LGPL-2.1+ LGPL-3.0+ MPL-2.0 MPL-1.1 MPL-1.0 EPL-1.0 EPL-2.0 CDDL-1.0 CPL-1.0 EUPL-1.1 EUPL-1.2 OSL-3.0 OSL-2.0 OSL-2.1 CPAL-1.0 CECILL-2.1 CC-BY-SA-4.0 CC-BY-SA-3.0",
    "strong_copyleft": "GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0+ GPL-2.0-with-autoconf-exception GPL-3.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0+ AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0+",
    "gpl_incompatible": "SSPL-1.0 Commons-Clause BUSL-1.1",
}
#: Informal spellings, as anchored patterns in order, and the identifier that each stands for.
LICENSE_SPELLINGS = [
    (r"^(GPLv1|GPL v1|GNU GPL v1)", "GPL-1.0-or-later"),
    (r"^(GPLv2 only|GPL-2 only)$", "GPL-2.0-only"),
    (r"^(GPLv2\+$|GPL-2\.0\+$|GPL v2\+|GPL v2 or later|GPL-2\+|GNU GPL-2\+|GNU GPLv2\+)", "GPL-2.0-or-later"),
    (r"^(GPLv2|GPL v2|GPL-2|GNU GPL v2|GNU GPLv2)$", "GPL-2.0"),
    (r"^(GPLv3\+$|GPL-3\.0\+$|GPL v3\+|GPL v3 or later|GNU GPLv3\+)", "GPL-3.0-or-later"),
    (r"^(GPLv3|GPL v3|GPL-3|GNU GPL v3|GNU GPLv3)$", "GPL-3.0"),
    (r"^(LGPLv2\+$|LGPL-2\.1\+$|LGPL v2\+|GNU LGPL.*2\+)", "LGPL-2.1-or-later"),
    (r"^(LGPLv2|LGPL v2|LGPL-2|GNU LGPL v2)$", "LGPL-2.1"),
    (r"^(LGPLv3\+$|LGPL-3\.0\+$|GNU LGPL.*3\+)", "LGPL-3.0-or-later"),
    (r"^(LGPLv3|LGPL v3|LGPL-3)$", "LGPL-3.0"),
    (r"^(Apache 2|Apache 2\.0|Apache License 2\.0|Apache-2)$", "Apache-2.0"),
    (r"^(2-Clause BSD|BSD 2-Clause|BSD-2)$", "BSD-2-Clause"),
    (r"^(3-Clause BSD|BSD 3-Clause|BSD-3)$", "BSD-3-Clause"),
]
PROPRIETARY = r"(?i)(commercial|proprietary|all.rights.reserved)"
#: category, severity, reason, risk
LICENSE_POLICY = [
    ("permissive", "INFO", "", 0),
    ("weak_copyleft", "INFO", "Weak copyleft — review linking and usage", 0),
    ("strong_copyleft", "INFO", "Strong copyleft — source disclosure required; GPL-compatible", 0),
    ("gpl_incompatible", "CRITICAL", "Not GPL-compatible — incompatible with GPL-licensed projects", 200),
    ("proprietary", "CRITICAL", "Proprietary license — verify usage rights; not GPL-compatible", 150),
    ("unknown", "WARNING", "Unrecognised or undeclared license — investigation required", 25),
]

# --- dependency audit ----------------------------------------------------------------------------------

POPULAR = "react vue angular express lodash axios webpack babel typescript jest eslint prettier moment jquery bootstrap next nuxt vite rollup chalk commander yargs dotenv cors requests numpy pandas django flask pytest setuptools boto3 sqlalchemy pillow scipy matplotlib urllib3 cryptography paramiko celery pydantic fastapi aiohttp tensorflow torch sklearn phpunit twig carbon predis junit slf4j jackson guava hibernate log4j commons mockito spring".split()
POPULAR_COMPOSER = "guzzlehttp/guzzle symfony/console symfony/http-kernel symfony/routing symfony/finder symfony/process laravel/framework doctrine/orm doctrine/dbal doctrine/inflector ramsey/uuid nesbot/carbon monolog/monolog league/flysystem league/csv spatie/laravel-permission spatie/laravel-media-library psr/log psr/container psr/http-client psr/http-message intervention/image vlucas/phpdotenv phpunit/phpunit".split()
INTERNAL_SCOPE = "^@(internal|private|corp|company|mycompany|our|team|local|dev|test)/"
INTERNAL_NAME = "^(internal|private)-|-(internal|private)$"
SUSPICIOUS_VERSION = r"^(99\.|999\.|0\.0\.0)"
TEST_NAME = r"(^|[-_.])(test|demo|example|temp|tmp|placeholder)([-_.]|$)"
AUDIT_WEIGHTS = {"dependency_confusion": 500, "typosquat": 400, "suspicious": 100}

SEVERITY_WEIGHTS = {"Critical": 100.0, "High": 25.0, "Medium": 5.0, "Low": 1.0, "Negligible": 0.1}
RISK_LEVELS = [(1000, "CRITICAL"), (500, "HIGH"), (100, "MEDIUM")]
PROVENANCE_BASE = {"public": 300, "custom": 150, "internal": 100, "prerelease": 100}

# --- domains and addresses -----------------------------------------------------------------------------

DOMAIN_ZONES = ["dbl.spamhaus.org", "multi.surbl.org", "dbl.nordspam.com", "rhsbl.abuse.ch"]
IP_ZONES = ["zen.spamhaus.org", "bl.spamcop.net"]
UNRELIABLE_CODES = ["127.255.255.252", "127.255.255.254", "127.255.255.255"]
DBL_CODES = {
    "127.0.1.2": "spam domain", "127.0.1.4": "phishing domain", "127.0.1.5": "malware domain", "127.0.1.6": "botnet C&C domain", "127.0.1.102": "abused legitimate spam domain", "127.0.1.103": "abused legitimate phishing domain", "127.0.1.104": "abused legitimate malware domain", "127.0.1.105": "abused legitimate botnet C&C domain",
    "127.255.255.252": "QUERY LIMIT EXCEEDED", "127.255.255.254": "QUERY LIMIT EXCEEDED", "127.255.255.255": "DNSBL zone misconfigured",
}
ZEN_CODES = {
    "127.0.0.2": "SBL — Spamhaus spam source", "127.0.0.3": "SBL CSS — spam-support service", "127.0.0.4": "XBL CBL — exploited/botnet IP", "127.0.0.9": "SBL DROP — hijacked/rogue network", "127.0.0.10": "PBL ISP — ISP policy block", "127.0.0.11": "PBL user — user-level policy block",
    "127.255.255.252": "QUERY LIMIT EXCEEDED", "127.255.255.254": "QUERY LIMIT EXCEEDED", "127.255.255.255": "DNSBL zone misconfigured",
}
SURBL_BITS = [(2, "SC (SpamCop)"), (4, "WS (jwSpamSpy)"), (8, "PH (phishing)"), (16, "MW (malware/cracked)"), (64, "AB (AbuseButler)"), (128, "CR (cred phishing)")]
DKIM_SELECTORS = "default dkim mail email k1 google selector1 selector2 s1 s2 smtp key1 mimecast mailjet sendgrid everlytickey1".split()
CREATED_FIELDS = ["Creation Date", "Registry Creation Date", "Created On", "created", "Domain Registration Date", "Registered on", "Registration Time", "domain_dateregistered", "created_date", "Crdate"]
CATCHALL_DOMAINS = "gmail.com googlemail.com outlook.com hotmail.com hotmail.co.uk hotmail.fr hotmail.de hotmail.es hotmail.it hotmail.nl live.com live.co.uk live.fr live.de live.nl live.com.au live.ca msn.com passport.com icloud.com me.com mac.com yahoo.com yahoo.co.uk yahoo.fr yahoo.de yahoo.es yahoo.it yahoo.ca yahoo.com.au yahoo.co.jp yahoo.co.nz yahoo.gr ymail.com rocketmail.com aol.com aim.com verizon.net proton.me protonmail.com protonmail.ch pm.me fastmail.com fastmail.fm fastmail.net fastmail.org fastmail.to fastmail.us fastmail.cn fastmail.es fastmail.de zoho.com zohomail.com yandex.com yandex.ru yandex.ua yandex.by yandex.kz ya.ru mail.ru inbox.ru list.ru bk.ru internet.ru gmx.com gmx.net gmx.de gmx.at gmx.ch web.de tutanota.com tutanota.de tutamail.com tuta.io keemail.me runbox.com posteo.de posteo.net posteo.eu mailfence.com".split()
ROLES = {
    "system": "postmaster hostmaster webmaster abuse root mailer-daemon mailerdaemon listmaster listserv bounce bounces ndr devnull",
    "automation": "noreply no-reply no_reply donotreply do-not-reply do_not_reply donot-reply notifications notification notify automated automailer autoreply auto-reply auto_reply daemon robot bot system",
    "departmental": "admin administrator info information contact contactus contact-us help support helpdesk help-desk service services billing accounts accounting finance hr humanresources human-resources legal compliance marketing sales press media pr publicrelations public-relations security spam phishing fraud report reports newsletter news subscribe unsubscribe feedback careers jobs recruitment recruiting team devteam ops devops sre it itsupport it-support",
    "distribution": "all everyone staff employees users members list lists dlist distribution general announce announcements internal company",
}
ROLE_POINTS = {"system": -15, "automation": -30, "departmental": -10, "distribution": -20}
PHP_VERSIONS = "5.2 5.3 5.4 5.5 5.6 7.0 7.1 7.2 7.3 7.4 8.0 8.1 8.2 8.3 8.4".split()


# --- as tables -----------------------------------------------------------------------------------------


def pairs(grouped: dict[str, str]) -> list[tuple[str, str]]:
    """(item, group) of a mapping from group to space-separated items; a later group wins."""
    return list({item: group for group, items in grouped.items() for item in items.split()}.items())


def literal(value: object, duck: bool = False) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int | float):
        return str(value)
    text = str(value).replace("'", "''")
    return f"'{text if duck else text.replace(chr(92), chr(92) * 2)}'"


def values(rows: list[tuple], columns: str, duck: bool = True) -> str:
    """A VALUES table with these columns, as SQL text."""
    body = ", ".join("(" + ", ".join(literal(v, duck) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(VALUES {body}) AS t({columns})"


def small(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A constant table inside the plan; each has under 200 rows, so Spark broadcasts it by its known size."""
    return spark.sql(f"SELECT * FROM {values(rows, columns, duck=False)}")
