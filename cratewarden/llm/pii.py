"""Personal data: fixed patterns, and candidates that gradient-boosted trees accept.

High-recall generators propose spans that the fixed patterns miss (local
telephone numbers, spelled-out addresses, other card layouts, IPv6). Trees
trained on labelled spans score their format and context; a threshold for each
generator, calibrated on held-out labels to PRECISION, selects what to redact.

The fitted trees become CASE expressions over a feature array, so after training
everything is one narrow stage of built-in functions.

Labelled samples. Spans of known kind are written into contexts made of the
words of a bounded sample of the documents (about SAMPLE_ROWS rows, SAMPLE_WORDS
distinct words): numbers after words that introduce a telephone or a card are
positive, the same shapes after words for orders, versions or pages negative.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, words
from .spans import as_text, free_of, merged, with_spans

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, and what their matches must hold. Lookbehinds only spare starts that an earlier one covers.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators: kind, pattern, and a cheap test that every text with a match passes.
GENERATORS = {
    "local_phone": ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])", r"[0-9][ .-][0-9]{3}"),
    "spelled_email": ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}+(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{2,63}+){1,126}+", r"(?i) at |[\[(]at[\])]"),
    "other_card": ("card", r"(?<![0-9.])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])", r"[0-9]{4}"),
    "ipv6": ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
}
#: Words before a span that features look for, in the languages of the corpus: those that introduce personal data, and those that introduce other numbers.
INTRODUCING = (
    r"(?i)(?<!\p{L})(?:call|phone|tel|telephone|mobile|cell|fax|contact|reach(?: me| us)?(?: at)?|whatsapp|sms|e-?mail|mail|write(?: to)?|card|visa|mastercard|amex|credit|debit|pay(?: with)?|ip|host|address|from"
    r"|telefon|handy|anruf(?:en)?|rufen sie|schreiben(?: an)?|karte|kreditkarte|adresse|t[ée]l[ée]phone|portable|appel(?:ez|er)|[ée]crire|courriel|carte|tel[ée]fono|m[óo]vil|llam(?:e|ar)|escrib(?:a|ir)|correo|tarjeta|direcci[óo]n)\W*$"
)
COUNTING = (
    r"(?i)(?<!\p{L})(?:order|invoice|version|page|isbn|item|ref(?:erence)?|total|room|id|serial|tracking|chapter|section|no|number|part|model|date|since|look(?:ing|s)?|time"
    r"|bestellung|rechnung|seite|nummer|teil|datum|kapitel|raum|commande|facture|num[ée]ro|chapitre|r[ée]f[ée]rence|salle|pedido|factura|p[áa]gina|n[úu]mero|cap[íi]tulo|referencia|fecha)\W*$"
)
#: Cues that labels are written with, by generator, one to each language at least: (of personal data, of other text). The first are among the words above, the second are not.
LISTED = {
    0: (("call", "phone:", "telefon", "appelez", "llame"), ("order", "rechnung", "page", "pedido")), 1: (("email", "schreiben an", "courriel", "correo:"), ("looking", "time")),
    2: (("card", "visa", "karte", "tarjeta"), ("tracking", "serial", "facture")), 3: (("ip", "host", "adresse"), ("time", "section")),
}
UNLISTED = {
    0: (("dial", "hotline", "durchwahl", "joignable au", "marque el"), ("batch", "ticket", "aktenzeichen", "dossier", "expediente", "score")), 1: (("questions to", "erreichbar unter", "joindre", "dudas a"), ("meet", "treffen", "rendez-vous", "vemos")),
    2: (("account", "konto", "compte", "cuenta"), ("parcel", "sendung", "colis", "paquete")), 3: (("server", "rechner", "serveur", "equipo"), ("elapsed", "dauer", "dur\u00e9e", "plazo")),
}
DOMAINS = r"(?i)[. ](?:com|org|net|edu|gov|io|info|eu|uk|de|fr|es|it|nl)$"
SAMPLE_ROWS, SAMPLE_WORDS = 200, 600
PRECISION = 0.95
TREES, DEPTH = 10, 3


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]++", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    value = lambda ch, i: F.when(i % 2 == 0, F.ascii(ch) - 48).otherwise((F.ascii(ch) - 48) * 2 - F.when(F.ascii(ch) > 52, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def features(span: Column, generator: Column) -> Column:
    """Format and context of a candidate, as an array of doubles."""
    text, before, after = span["text"], span["before"], span["after"]
    number = digits(text)
    flags = [
        generator, F.length(number), F.length(text), text.contains("("), F.length(F.regexp_replace(text, r"[^ .()\[\]:-]++", "")),
        before.rlike(INTRODUCING), before.rlike(COUNTING), text.rlike(DOMAINS), text.rlike(r"[\[(]"),
        F.when(F.length(number) >= 13, luhn(number)).otherwise(F.lit(False)), before.rlike(r"[#$€£=/]\s*$"), after.rlike(r"^\s*[%€$A-Za-z0-9]"), F.coalesce(F.ascii(F.substring(number, 1, 1)), F.lit(0)),
    ]
    return F.array(*(f.cast("double") for f in flags))


def labelled_samples(docs: DataFrame, *cues: dict[int, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """(label, generator, span, part): labelled spans in context, part 0 to 3 by hash, written with LISTED and UNLISTED cues or those given."""
    cues = cues or (LISTED, UNLISTED)
    sample = bounded_sample(docs.select("doc_id", "text"), SAMPLE_ROWS, "doc_id")
    word = sample.select(F.explode(words(F.col("text"))).alias("w")).select(F.regexp_replace(F.lower("w"), "[^a-z]++", "").alias("w")).filter(F.length("w") >= 2)
    word = word.groupBy("w").agg(F.xxhash64("w").alias("h")).orderBy("h").limit(SAMPLE_WORDS)
    n = F.concat(F.lpad(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(10**10)).cast("string"), 10, "7"), F.lpad(F.pmod(F.xxhash64("w", F.lit(2)), F.lit(10**10)).cast("string"), 10, "3"))
    m = F.md5(F.encode("w", "UTF-8"))
    rows = word.select("w", "h", n.alias("n"), m.alias("m"))
    d = lambda at, size: F.substring("n", at, size)
    x = lambda at: F.substring("m", at, 4)
    lit, w = F.lit, F.col("w")
    phones = [F.concat(lit("("), d(1, 3), lit(") "), d(4, 3), lit("-"), d(7, 4)), *(F.concat(d(1, 3), lit(s), d(4, 3), lit(s), d(7, 4)) for s in "-. ")]
    cards = [*(F.concat(lit("4"), d(1, 3), lit(s), d(4, 4), lit(s), d(8, 4), lit(s), d(12, 4)) for s in ".- "), F.concat(lit("37"), d(1, 2), lit(" "), d(3, 6), lit(" "), d(9, 5))]
    emails = [F.concat(w, lit(" at "), w, lit(" dot com")), F.concat(w, lit(" [at] "), w, lit(" [dot] org")), F.concat(w, lit("(at)"), w, lit(".net"))]
    prose = [F.concat(w, lit(" at "), w, lit(" dot "), w), F.concat(w, lit(" at "), w, lit(".the"))]
    six = [F.concat_ws(":", *(x(k) for k in range(1, 9)))]
    clock = [F.concat_ws(":", *(d(k, 2) for k in range(1, 9)))]
    yes, no = {0: phones, 1: emails, 2: cards, 3: six}, {0: phones[1:], 1: prose, 2: cards, 3: clock}
    made = [(g, label, cue, t) for some in cues for g, both in some.items() for label, spans, own in ((1, yes, both[0]), (0, no, both[1])) for t in spans[g] for cue in own]
    made += [(g, 1, "and", t) for g, t in ((0, phones[0]), *((1, e) for e in emails), (3, six[0]))] + [(g, 0, "and", t) for g, t in ((0, phones[2]), (0, phones[3]), (1, prose[0]), (2, cards[0]))]
    choices = F.array(*(
        F.struct(lit(label).alias("label"), lit(g).alias("generator"), F.struct(lit(0).alias("start"), lit(0).alias("stop"), t.alias("text"), F.concat(w, lit(f" {cue} ")).alias("before"), F.concat(lit(" "), F.substring("m", 1, 2), lit(" ")).alias("after")).alias("span"))
        for g, label, cue, t in made
    ))
    # each word takes every 12th choice, so a sample has at most SAMPLE_WORDS * len(made) / 12 rows
    picked = rows.select(F.posexplode(choices).alias("k", "c"), "h").filter(F.pmod(F.col("h") + F.col("k"), F.lit(12)) == 0)
    return picked.select("c.label", "c.generator", "c.span", F.pmod(F.xxhash64("h", "k"), F.lit(4)).alias("part"))


@dataclass
class Model:
    """Boosted trees as nested (feature, threshold, left, right) with leaves, their weights, and a threshold for each generator."""

    trees: list[tuple[float, object]]
    thresholds: list[float]

    def score(self, f: Column) -> Column:
        margin = sum((F.lit(w) * _as_column(tree, f) for w, tree in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _as_column(node: object, f: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(F.get(f, F.lit(feature)) <= threshold, _as_column(left, f)).otherwise(_as_column(right, f))


def _parsed(lines: list[str]) -> object:
    """The next node of a tree's debug string, whose lines it uses up."""
    line = lines.pop(0)
    if match := re.match(r"Predict: (\S+)", line):
        return float(match[1])
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _parsed(lines)
    lines.pop(0)  # Else
    return int(feature), float(threshold), left, _parsed(lines)


def train(docs: DataFrame) -> Model:
    samples = labelled_samples(docs).select(F.col("label").cast("double").alias("label"), "generator", "part", features(F.col("span"), F.col("generator")).alias("f")).cache()
    try:
        fitted = samples.filter("part > 0").select("label", array_to_vector("f").alias("features"))
        if samples.filter("part > 0").agg(F.countDistinct("label")).first()[0] < 2:
            return Model([], [2.0] * len(GENERATORS))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(fitted)
        trees = [(w, _parsed([x.strip() for x in t.toDebugString.splitlines()[1:]])) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        made = Model(trees, [2.0] * len(GENERATORS))
        held = samples.filter("part = 0").groupBy("generator", made.score(F.col("f")).alias("score")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
        falling = Window.partitionBy("generator").orderBy(F.col("score").desc())
        above = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # halfway to the next lower score
        line = (F.col("score") + F.coalesce(F.lead("score").over(falling), F.lit(0.0))) / 2
        exact = held.select("generator", line.alias("line"), (F.sum("good").over(above) / F.sum("n").over(above)).alias("precision")).filter(F.col("precision") >= PRECISION)
        for generator, threshold in exact.groupBy("generator").agg(F.min("line")).collect():
            made.thresholds[generator] = threshold
        return made
    finally:
        samples.unpersist()


def scan_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the base spans of each kind, and those that the trees add (`more`: kind, start, stop, score).

    Places are code points, end exclusive. An added span overlaps no base span;
    added ones that overlap are merged under the kind with the highest score,
    so that all of them is redacted. Null texts are empty; rows are
    scanned each for itself; other columns are ignored; without any text there
    is nothing to train on, and nothing is added.
    """
    model = train(docs)
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = {"email": (EMAIL, text.contains("@")), "ip": (IP, text.rlike(r"[0-9]\.[0-9]")), "card": (CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){15}")), "phone": (PHONE, text.contains("+"))}
    rows = with_spans(rows, base | {f"g{g}": (pattern, text.rlike(guard)) for g, (_, pattern, guard) in enumerate(GENERATORS.values())})
    rows = rows.withColumns({
        "ip": F.filter("ip", lambda s: s["text"].rlike(OCTETS)),
        "card": F.filter("card", lambda s: luhn(digits(s["text"]))),
        "phone": F.filter("phone", lambda s: F.length(digits(s["text"])).between(8, 15)),
    })
    rows = rows.drop("text").withColumns({"base": F.concat(*KINDS), "proposed": F.concat(*(_tagged(f"g{g}", g) for g in range(len(GENERATORS))))})
    rows = free_of(rows, "proposed", "base")
    rows = rows.withColumn("proposed", F.transform("proposed", lambda p: F.struct(p["span"].alias("span"), p["generator"].alias("generator"), features(p["span"], p["generator"]).alias("f"))))
    kinds, thresholds = F.array(*(F.lit(KINDS.index(x[0])) for x in GENERATORS.values())), F.array(*map(F.lit, model.thresholds))
    scored = F.transform("proposed", lambda p: F.struct(F.get(kinds, p["generator"]).alias("kind"), p["span"]["start"].alias("start"), p["span"]["stop"].alias("stop"), model.score(p["f"]).alias("score"), p["generator"].alias("generator")))
    rows = rows.withColumn("more", F.filter(scored, lambda s: s["score"] >= F.get(thresholds, s["generator"])))
    return merged(rows, "more").select("doc_id", *KINDS, "more")


def _tagged(name: str, generator: int) -> Column:
    return F.transform(name, lambda s: F.struct(s.alias("span"), F.lit(generator).alias("generator"), s["start"].alias("start"), s["stop"].alias("stop")))


def pii_report(docs: DataFrame) -> DataFrame:
    out = scan_pii(docs)

    def base(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(n).alias("n"), s["start"].alias("start"), as_text(kind, s).alias("t")))

    def joined(tagged: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(tagged), lambda x: x["t"]), ",")

    listed = F.concat(*(base(n, kind) for n, kind in enumerate(KINDS)))
    names = F.array(*map(F.lit, KINDS))
    more = F.transform("more", lambda s: F.struct(s["kind"].alias("n"), s["start"].alias("start"), as_text(F.get(names, s["kind"]), s).alias("t")))
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(listed), 256).alias("base_sha256"), joined(F.concat(listed, more)).alias("spans"), F.size("more").cast("long").alias("n_added"))

