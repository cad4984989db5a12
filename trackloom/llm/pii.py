"""Personal data: fixed base patterns, and weakly supervised further spans.  DataFrame functions only.

Base spans (email, ip, card, phone) are what the fixed patterns match.  Further candidates
(token-like secrets, grouped numbers, values given to a credential's name) are voted on by
regex, gazetteer and context labelers; expectation-maximisation over the table of vote
patterns estimates each labeler's reliability, and its posteriors are the soft labels of the
span classifier that decides.  The classifier sees the votes and what no labeler looks at:
the make-up of the span and the characters around it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of kinds in results; the last three are what the method adds.
KINDS = ["email", "ip", "card", "phone", "secret", "number", "credential"]
BASE = KINDS[:4]

# The base patterns, with the same matches as their plain forms but without backtracking: where
# a run of characters can only match from its start, the look-behind says so (\G: or from the
# end of the match before), and quantifiers that never give back are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+(?![A-Za-z0-9_])",
    "number": r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}+(?![0-9A-Za-z])",
    "credential": r"(?i)(?<=(?:key|token|secret|password|passwd|pwd|passphrase|credential|bearer|auth)[\"']?[\x20]?[=:]?[\x20]?[\"']?)(?<![A-Za-z0-9/+_.~-])(?=[A-Za-z/+=_.~-]*+[0-9])[A-Za-z0-9/+=_.~-]{8,}+",
}
#: Cheap tests that every text with a match passes.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": PATTERNS["card"], "phone": r"\+[0-9]", "secret": PATTERNS["secret"], "number": r"[0-9]{2}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2}", "credential": r"(?i)(?:key|token|secret|password|passwd|pwd|passphrase|credential|bearer|auth)[\"']?[\x20=:]"}

#: Words before a span that speak for and against it.
FOR_WORDS = "account api auth bearer call card cell contact credential fax iban id key login mobile passport password passwd phone pin pwd secret ssn tel telephone token whatsapp".split()
AGAINST_WORDS = "build chapter commit edition figure isbn issn no page pages part revision section sha table version vol volume year".split()
#: How tokens of known issuers begin.
ISSUERS = "AKIA ASIA AIza ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- sk_live_ sk_test_ rk_live_ pk_live_ sk- ya29. eyJ SG. npm_ pypi- dop_v1_ hf_ shpat_".split()
#: What stands in examples and never opens anything.
PLACEHOLDERS = "example sample dummy changeme placeholder your_ xxxx 00000000 12345678 abcdefgh deadbeef lorem".split()
#: National and toll-free prefixes of grouped numbers, and years, which are none.
CODES = "800 833 844 855 866 877 888 001 0044 0049 0033 0034".split()
LABELERS = ["shape", "gazetteer", "words", "punctuation", "checksum", "mix"]
FEATURES = ["rank", "size", "digits", "classes", "distinct", "lead"]
BEFORE = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    at = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,rank:int,end:int,match:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """The valid matches of one kind as (start, rank, end, match), in code points, leftmost and not overlapping.

    The gaps between matches and the matches themselves give the positions.
    """
    pattern = F.lit(PATTERNS[kind])
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("out"))

    def step(acc, x):
        a = acc["pos"] + F.length(x["gap"])
        z = a + F.length(F.coalesce(x["match"], F.lit("")))
        span = F.struct(a.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), z.alias("end"), x["match"].alias("match"))
        return F.struct(z.alias("pos"), F.when(x["match"].isNotNull(), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pairs, start, step)["out"]
    checked = F.filter(found, lambda s: _valid(kind, s["match"])) if kind in ("ip", "card", "phone") else found
    return F.when(text.rlike(GUARDS[kind]), checked).otherwise(F.array().cast(_SPANS))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (valid base spans in order) and ``candidates`` (further ones, which overlap no base span)."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("base", F.array_sort(F.concat(*(spans_of(body, k) for k in BASE))))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    docs = docs.withColumn("candidates", F.filter(F.concat(*(spans_of(body, k) for k in KINDS[4:])), free))
    # a credential that is a secret token from end to end is that
    same = lambda c: F.exists("candidates", lambda o: (o["rank"] == KINDS.index("secret")) & (o["start"] == c["start"]) & (o["end"] == c["end"]))
    return docs.withColumn("candidates", F.filter("candidates", lambda c: (c["rank"] != KINDS.index("credential")) | ~same(c)))


def _lead(text: Column, start: Column) -> Column:
    return F.lower(F.substring(text, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE))))


def votes(text: Column, span: Column) -> list[Column]:
    """Each labeler's vote on a span: 1 for personal or secret, -1 against, 0 abstains."""
    match, lead = span["match"], _lead(text, span["start"])
    word = F.regexp_extract(lead, r"([a-z]+)[^a-z0-9]{0,4}\z", 1)
    digits = _digits(match)
    size = F.length(match)
    kinds = F.size(F.array_distinct(F.split(match, "")))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    either = lambda conditions: reduce(lambda a, b: a | b, conditions)
    issued = either([match.startswith(x) for x in ISSUERS]) | either([F.regexp_replace(match, r"\(", "").startswith(x) for x in CODES])
    shown = either([F.lower(match).contains(x) for x in PLACEHOLDERS]) | match.rlike(r"^(?:19|20)[0-9]{2}[ .-]")
    return [
        vote(match.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|(?=.*[a-z])(?=.*[0-9])[0-9a-f]{16,}|(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9]).{16,})\z"), match.rlike(r"^(?:[0-9]{2,4}-[0-9]{2}-[0-9]{2,4}|[A-Za-z]+(?:_[A-Za-z]+)*_?[0-9]{1,3}|[0-9]{1,4}(?:\.[0-9]{1,4})+)\z") & ~match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z")),
        vote(issued, shown),
        vote(word.isin(FOR_WORDS), word.isin(AGAINST_WORDS)),
        vote(lead.rlike(r"[=:\"']\s?\z"), lead.rlike(r"(?:[0-9a-z/_.-]|#\s?)\z")),
        vote(F.length(digits).between(13, 19) & (F.length(digits) == size) & luhn(digits), F.length(digits).between(13, 19) & (F.length(digits) == size)),
        vote((kinds >= 8) & match.rlike("[A-Za-z]") & match.rlike("[0-9]"), kinds <= 3),
    ]


def features(text: Column, span: Column) -> list[Column]:
    """What the classifier sees besides the votes, each a small number: kind, length, share of digits, kinds of characters, different ones, what stands before."""
    match, lead = span["match"], _lead(text, span["start"])
    n = F.length(match)
    has = lambda pattern, bit: F.when(match.rlike(pattern), bit).otherwise(0)
    last = F.substring(lead, -1, 1)
    return [
        span["rank"],
        F.when(n < 12, 0).when(n < 20, 1).when(n < 33, 2).otherwise(3),
        F.floor(4 * F.length(_digits(match)) / F.greatest(n, F.lit(1))).cast("int"),
        has("[a-z]", 1) + has("[A-Z]", 2) + has("[0-9]", 4) + has("[^A-Za-z0-9]", 8),
        F.least(F.floor(F.size(F.array_distinct(F.split(match, ""))) / 4), F.lit(6)).cast("int"),
        F.when(last == "", 0).when(last.isin("'", '"'), 1).when(last.isin("=", ":"), 2).when(last == " ", 3).otherwise(4),
    ]


#: Prior beliefs on a labeler's votes -1, 0 and 1, given a positive and given a negative span.
PRIOR = {-1: (0.05, 0.45), 0: (0.5, 0.5), 1: (0.45, 0.05)}


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 25) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation on (votes, how often).

    Returns the share of positives and for each labeler P(vote | positive), P(vote | negative).
    The table has at most 3**labelers rows, whatever the size of the corpus.  The prior weighs
    a fifth of the spans: it keeps every labeler better than chance and the classes named.
    """
    k, total = len(patterns[0][0]) if patterns else len(LABELERS), sum(n for _, n in patterns)
    weight = 5 + 0.2 * total
    belief = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in patterns]
    prior, rates = 0.5, []
    for _ in range(rounds):
        pos = sum(b * n for b, (_, n) in zip(belief, patterns, strict=True))
        prior = (pos + 1) / (total + 2)
        rates = []
        for j in range(k):
            row = {}
            for v in (-1, 0, 1):
                a = sum(b * n for b, (x, n) in zip(belief, patterns, strict=True) if x[j] == v)
                c = sum((1 - b) * n for b, (x, n) in zip(belief, patterns, strict=True) if x[j] == v)
                row[v] = ((a + weight * PRIOR[v][0]) / (pos + weight), (c + weight * PRIOR[v][1]) / (total - pos + weight))
            rates.append(row)
        belief = [posterior(prior, rates, v) for v, _ in patterns]
    return prior, rates


def posterior(prior: float, rates: list[dict[int, tuple[float, float]]], v: tuple[int, ...]) -> float:
    log = math.log(prior / (1 - prior)) + sum(math.log(rates[j][x][0] / rates[j][x][1]) for j, x in enumerate(v))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, log))))


class SpanClassifier:
    """Log-odds per vote and per feature value of a span, from posteriors as soft labels.

    ``rows`` are (votes, feature, value, how often): one table for each feature, by vote pattern.
    """

    def __init__(self, rows: list[tuple[tuple[int, ...], str, int, int]]):
        table: dict[tuple[int, ...], int] = {}
        for v, name, _, n in rows:
            if name == FEATURES[0]:
                table[v] = table.get(v, 0) + n
        self.prior, self.rates = estimate(sorted(table.items()))
        soft = {v: posterior(self.prior, self.rates, v) for v in table}
        pos, total = sum(soft[v] * n for v, n in table.items()), sum(table.values())
        self.bias = math.log((pos + 1) / (total - pos + 1))

        def odds(counted: list[tuple[tuple[int, ...], int]], values: int) -> float:
            a = sum(soft[v] * n for v, n in counted)
            c = sum((1 - soft[v]) * n for v, n in counted)
            return math.log((a + 1) / (pos + values)) - math.log((c + 1) / (total - pos + values))

        self.vote = [{x: odds([(v, n) for v, n in table.items() if v[j] == x], 3) for x in (-1, 0, 1)} for j in range(len(LABELERS))]
        self.feature: list[dict[int, float]] = []
        for name in FEATURES:
            held: dict[int, list] = {}
            for v, other, value, n in rows:
                if other == name:
                    held.setdefault(value, []).append((v, n))
            # features of one span are not independent of each other: together they weigh as two
            self.feature.append({value: odds(own, len(held)) * 2 / len(FEATURES) for value, own in held.items()})

    def logit(self, text: Column, span: Column) -> Column:
        """The classifier as an expression."""
        pick = lambda x, table: reduce(lambda c, kv: c.when(x == kv[0], kv[1]), sorted(table.items()), F.when(F.lit(False), 0.0)).otherwise(0.0)
        terms = [pick(v, self.vote[j]) for j, v in enumerate(votes(text, span))]
        terms += [pick(x, self.feature[j]) for j, x in enumerate(features(text, span))]
        return reduce(lambda a, b: a + b, terms, F.lit(self.bias))


def fit(docs: DataFrame) -> SpanClassifier:
    """Counts vote patterns with each feature over all documents and fits the classifier.

    What reaches the driver has at most 3**labelers rows for each of some forty feature values,
    whatever the size of the corpus.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    found = with_spans(docs.select(F.col("text").cast("string").alias("text"))).where(F.size("candidates") > 0)
    # only what a labeler looks at goes on: the span and the characters before it
    near = lambda s: F.struct(F.least(s["start"], F.lit(BEFORE)).alias("start"), s["rank"].alias("rank"), s["match"].alias("match"), F.substring(body, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))).alias("lead"))
    spans = found.select(F.explode(F.transform("candidates", near)).alias("s"))
    columns = [v.alias(LABELERS[j]) for j, v in enumerate(votes(F.col("s.lead"), F.col("s")))]
    values = F.array(*(F.struct(F.lit(x).alias("feature"), v.cast("int").alias("value")) for x, v in zip(FEATURES, features(F.col("s.lead"), F.col("s")), strict=True)))
    voted = spans.select(*columns, F.explode(values).alias("f")).select(*LABELERS, "f.feature", "f.value")
    counts = voted.groupBy(*LABELERS, "feature", "value").count()
    return SpanClassifier([(tuple(r[x] for x in LABELERS), r["feature"], r["value"], r["count"]) for r in counts.orderBy(*counts.columns).collect()])


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(name, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def annotate(docs: DataFrame, classifier: SpanClassifier | None = None) -> DataFrame:
    """``docs`` (with text) plus ``base`` and ``spans`` (base and added spans, in order of start and kind).

    A null text counts as empty.  Every span of a text of any length is found; repeated rows
    are judged each for itself.  Without a classifier one is fitted on all of ``docs``; where
    there is no span at all it accepts what most labelers vote for.
    """
    classifier = classifier or fit(docs)
    body = F.coalesce(F.col("text"), F.lit(""))
    found = with_spans(docs)
    added = F.filter("candidates", lambda s: classifier.logit(body, s) > 0)
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("candidates")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = annotate(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    Texts without a span, nulls included, are unchanged; columns and their order are kept.
    """
    body = F.col("text")
    tag = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.array(F.substring(body, acc["pos"] + 1, s["start"] - acc["pos"]), F.element_at(tag, s["rank"] + 1)))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out"))

    own = {c: f"_of_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = annotate(docs.select(F.col("text").cast("string").alias("text"), *(F.col(c).alias(n) for c, n in own.items())))
    folded = F.aggregate("spans", start, step)
    clean = F.concat(F.array_join(folded["out"], ""), F.substring(body, folded["pos"] + 1, F.length(body)))
    found = found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(body))
    return found.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
