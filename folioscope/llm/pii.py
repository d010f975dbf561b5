"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from patterns: e-mail addresses, IP addresses, payment cards and phone
numbers (the base kinds, with their checks), and quoted secrets, IBANs and social
security numbers (added kinds).  Five labelers vote on every candidate, yes, no or
abstain: a strict form (grouping and number rules), check digits, a gazetteer of parts of
the value (top-level domains, countries, token prefixes), the words before it, and the
variety of its characters; no two of them read the same evidence.  Expectation-maximisation over the counts of vote patterns estimates how each
labeler votes on true and on false candidates; its posteriors train the final span
classifier, a logistic regression over votes, kind and length, which is applied as a SQL
expression.  Base spans always stay; added spans stay where the classifier says so.

Positions: a pattern cuts a text into pieces and matches, whose lengths in code points
add up to each match's start.  Patterns use possessive repeats wherever that accepts the
same strings, so no text is long enough to overflow the matcher.

Scale: spans are found in each row, without a shuffle, and kept in a checkpoint of narrow
rows so that texts are scanned once.  What reaches the driver is the count of each vote
pattern, a table bounded by kinds, votes and length classes.

Defined cases: null and empty texts have no spans; with no candidates the classifier
accepts nothing; added spans that overlap a base span are dropped; repeated rows each
give a row; extra columns pass through :func:`redact`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import cut

# The base patterns in possessive form, and the added ones.  A pattern that
# begins with a repeat may only begin where its run does, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<=[=:]\x20?[\"'])[A-Za-z0-9+/_-]{16,}+(?=[\"'])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, SECRET, IBAN, SSN)))
#: Cheap tests that a text must pass before its pattern is tried.
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None, "iban": None, "ssn": "-"}

# Words that announce each kind, and gazetteers.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "addr", "from"),
    "card": ("card", "visa", "pay", "account"),
    "phone": ("call", "phone", "tel", "fax", "mobile"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "credential"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
TOKEN_PREFIXES = ("sk", "pk", "rk", "ghp", "gho", "ghs", "glpat", "AKIA", "ASIA", "AIza", "xoxb", "xoxp", "eyJ", "SG", "npm", "hf")
IBAN_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
LABELERS = ("strict", "checksum", "gazetteer", "context", "variety")
LENGTH_CLASSES = 4
THRESHOLD = 0.5
PRIOR_VOTES = 20.0


def _none() -> Column:
    """An empty array of spans, of a type whose fields may be null."""
    return F.array_compact(F.array(F.lit(None).cast("struct<kind:string,start:bigint,end:bigint,value:string>")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _find(text: Column, kind: str) -> Column:
    """Every match of a kind as (kind, start, end, value), in order.

    Lengths of pieces and matches are added up in chunks of about the square root of
    their number, then over the chunks, as appending to one array would be quadratic.
    """
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), begin.cast("long").alias("start"), end.cast("long").alias("end"), x["m"].alias("value"))
        return F.when(x["m"].isNotNull(), F.struct(end.cast("long").alias("at"), F.array_append(acc["out"], span).alias("out"))).otherwise(acc)

    def chunked(all_pieces: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_pieces)))).cast("int")
        first = F.sequence(F.lit(1), F.size(all_pieces), size)
        return F.transform(first, lambda k: F.aggregate(F.slice(all_pieces, k, size), start, step))

    def shifted(chunks: Column) -> Column:
        begins = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + c["at"]))
        return F.flatten(
            F.zip_with(
                chunks,
                F.slice(begins, 1, F.size(chunks)),
                lambda c, o: F.transform(c["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["value"].alias("value"))),
            )
        )

    return _let(_let(pieces, chunked), shifted)


def _valid(span: Column, kind: str) -> Column:
    """The checks of the base kinds; a match that fails is dropped."""
    value = span["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(F.expr("0").cast("int") + F.nullif(part(x), F.lit("")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _validity(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(span, kind)


def _mod97(value: Column) -> Column:
    """The remainder by which account numbers are checked: first four characters last, letters as 10 to 35."""
    turned = F.split(F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return (acc * F.when(digit, 10).otherwise(100) + F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)) % 97

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step)


def _votes(span: Column) -> dict[str, Column]:
    """1 yes, 0 no, -1 abstain, from each labeler."""
    kind, value, before = span["kind"], span["value"], F.lower(span["before"])
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    variety = F.size(F.array_distinct(F.split(value, "")))
    strict = (
        F.when(kind == "secret", ((digits > 0) & (letters > 0) & (F.length(value) >= 20)).cast("int"))
        .when(kind == "iban", F.lit(-1))
        .when(kind == "ssn", (~value.rlike("^(000|666|9[0-9][0-9])|-00-|-0000$")).cast("int"))
        .when(kind == "email", value.rlike(r"\.[A-Za-z]{2,}$").cast("int"))
        .when(kind == "ip", (~value.rlike(r"(^|\.)0[0-9]")).cast("int"))
        .when(kind == "card", value.rlike(r"^(?:[0-9]{4}[ -]?){3,4}[0-9]{1,4}$").cast("int"))
        .otherwise((value.rlike(r"[ ().-]") | (digits >= 10)).cast("int"))
    )
    checksum = F.when(kind == "iban", (_mod97(value) == 1).cast("int")).when(kind == "card", 1).otherwise(-1)  # cards have passed theirs
    gazetteer = (
        F.when(kind == "email", F.when(F.regexp_extract(F.lower(value), r"\.([a-z0-9-]+)$", 1).isin(*DOMAINS), 1).otherwise(-1))
        .when(kind == "ip", F.when(value.rlike(r"^(0|127|255)\."), 0).otherwise(-1))
        .when(kind == "card", F.when(value.rlike("^[3-6]"), 1).otherwise(0))
        .when(kind == "phone", F.when(value.rlike(r"^\+(1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1246]|9[0-58])"), 1).otherwise(-1))
        .when(kind == "secret", F.when(value.rlike(f"^(?:{'|'.join(TOKEN_PREFIXES)})[_-]?"), 1).otherwise(-1))
        .when(kind == "iban", F.when(F.substring(value, 1, 2).isin(*IBAN_COUNTRIES), 1).otherwise(0))
        .otherwise(-1)
    )
    context = F.lit(-1)
    for k in KINDS:
        context = F.when((kind == k) & before.rlike("|".join(rf"\b{w}" for w in CONTEXT[k])), 1).otherwise(context)
    spread = F.when(variety >= 6, 1).when(variety <= 2, 0).otherwise(-1)
    return dict(zip(LABELERS, (strict, checksum, gazetteer, context, spread)))


def candidate_spans(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with ``pii_spans``: every valid base match and added candidate, with its votes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    has_digit = text.rlike("[0-9]")
    found = []
    for kind in KINDS:
        guard = F.contains(text, F.lit(GUARDS[kind])) if GUARDS[kind] else F.lit(True)
        guard = guard & (F.lit(True) if kind in ("email", "secret") else has_digit)
        found.append(F.filter(F.when(guard, _find(text, kind)).otherwise(_none()), _validity(kind)))
    spans = F.concat(*found)

    def voted(s: Column) -> Column:
        lead = F.greatest(F.lit(0), s["start"] - 30)
        with_context = F.struct(s["kind"].alias("kind"), s["value"].alias("value"), F.substring(text, (lead + 1).cast("int"), (s["start"] - lead).cast("int")).alias("before"))
        v = _votes(with_context)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *(v[k].cast("int").alias(k) for k in LABELERS), F.least(F.lit(LENGTH_CLASSES - 1), F.floor(F.length(s["value"]) / 12)).cast("int").alias("size"))

    return docs.withColumn("pii_spans", F.transform(spans, voted))


def estimate_reliability(patterns: list[tuple], rounds: int = 100) -> tuple[dict, list[float]]:
    """Expectation-maximisation over counted vote patterns.

    patterns: (kind, votes, size, count).  Gives P(vote | labeler, truth) and each
    pattern's posterior of being personal data.  Spans of the base kinds have passed their
    checks and count as certain.  Labelers start out as mostly right, and each estimate is
    smoothed by ``PRIOR_VOTES`` votes that fall that way, so the two classes cannot trade places.
    """
    labelers = range(max((len(x[1]) for x in patterns), default=0))
    first = {(j, y, v): (0.6 if v == y else 0.15 if v == 1 - y else 0.25) for j in labelers for y in (0, 1) for v in (-1, 0, 1)}
    vote = dict(first)
    prior = {k: 0.5 for k in KINDS}
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (kind, votes, _, _) in enumerate(patterns):
            like = [math.log(prior[kind] if y else 1 - prior[kind]) + sum(math.log(vote[j, y, v]) for j, v in enumerate(votes)) for y in (0, 1)]
            post[i] = 1.0 if kind in BASE_KINDS else 1 / (1 + math.exp(min(700, like[0] - like[1])))
        for j in labelers:
            for y in (0, 1):
                mass = {v: PRIOR_VOTES * first[j, y, v] for v in (-1, 0, 1)}
                for p, (_, votes, _, n) in zip(post, patterns):
                    mass[votes[j]] += n * (p if y else 1 - p)
                for v in mass:
                    vote[j, y, v] = mass[v] / sum(mass.values())
        for k in KINDS:
            n = sum(x[3] for x in patterns if x[0] == k)
            prior[k] = (5 + sum(p * x[3] for p, x in zip(post, patterns) if x[0] == k)) / (10 + n)
    return vote, post


def _features(kind: str, votes: tuple, size: int) -> list[str]:
    return ["bias", f"kind={kind}", f"size={size}", *(f"{labeler}={v}" for labeler, v in zip(LABELERS, votes))]


def train_classifier(patterns: list[tuple], rounds: int = 300) -> dict[str, float]:
    """Logistic regression on the posteriors, over kind, length class and votes."""
    _, post = estimate_reliability(patterns)
    weights: dict[str, float] = {}
    total = sum(x[3] for x in patterns) or 1
    names = [_features(*x[:3]) for x in patterns]
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for p, x, fs in zip(post, patterns, names):
            z = sum(weights.get(f, 0.0) for f in fs)
            g = (1 / (1 + math.exp(-max(-30, min(30, z)))) - p) * x[3] / total
            for f in fs:
                grad[f] = grad.get(f, 0.0) + g
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) * (1 - 1e-4) - 2.0 * g
    return weights


def train_on(spans: DataFrame) -> dict[str, float]:
    """The classifier, from the vote patterns of all spans of a table."""
    rows = spans.select(F.explode("pii_spans").alias("s")).groupBy("s.kind", *(f"s.{k}" for k in LABELERS), "s.size").count().collect()
    patterns = sorted((r["kind"], tuple(r[k] for k in LABELERS), r["size"], r["count"]) for r in rows)
    return train_classifier(patterns)


def classify(spans: str, weights: dict[str, float], threshold: float = THRESHOLD) -> Column:
    """The spans that count: all of the base kinds, and added ones the classifier accepts."""

    def logit(s: Column) -> Column:
        z = F.lit(weights.get("bias", 0.0))
        for name, w in sorted(weights.items()):
            field, _, value = name.partition("=")
            if value:
                z = z + F.when(s[field].cast("string") == value, F.lit(w)).otherwise(F.lit(0.0))
        return z

    least = math.log(threshold / (1 - threshold))
    base = F.filter(F.col(spans), lambda s: s["kind"].isin(*BASE_KINDS))
    added = F.filter(
        F.col(spans),
        lambda s: s["kind"].isin(*ADDED_KINDS) & (logit(s) >= least) & F.lit(bool(weights)) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return F.transform(F.concat(base, added), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id and ``spans``, by kind as listed, then start."""
    rows = cut(candidate_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), text_col="text").select("doc_id", "pii_spans"))
    return rows.select("doc_id", classify("pii_spans", train_on(rows)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in angle brackets.

    Texts are scanned once: rows and their candidates wait in a checkpoint for the classifier.
    """
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("document"), F.col(text_col).alias("pii_text"))
    found = cut(candidate_spans(held, text_col="pii_text"))
    weights = train_on(found)
    spans = F.array_sort(F.transform(classify("pii_spans", weights), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = found.withColumn("pii_spans", spans)
    text = F.col("pii_text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # of overlapping spans the first is named, and what the others add is dropped
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), 2147483647))
    clean = F.when(F.size("pii_spans") > 0, F.aggregate("pii_spans", start, step, rest)).otherwise(text)
    return rows.withColumn("pii_text", clean).select(*(F.col("pii_text").alias(c) if c == text_col else F.col("document")[c].alias(c) for c in docs.columns))
