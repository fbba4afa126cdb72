"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

DataFrame expressions only. Each generator is one regular expression that runs on its own over texts that hold its
marks; where a match lies follows from the lengths of what lies between the matches. The four base kinds have exact
checks and always stay. The other generators propose spans that may overlap each other and the base spans; boosted
trees score them by format and context (kind, share of digits, length, a key word before, the characters around,
overlap with base spans), and each kind has the least score that gives the wanted precision.

The trees need only counts: features are small integers, so one aggregate over all documents gives a table of at
most ``2 * prod(BINS)`` rows with weak labels, whatever the input. The weak labels are strict checks of the value
(checksums, number ranges, mixed characters), which no feature sees. Spans of one half of the texts, by the hash of the
text, train the trees; the thresholds come from the other half. A kind that the other half does not propose is
redacted from an even score on. Boosting runs on that table on the driver; the trees go back into the query as CASE
expressions. Apart from that aggregate nothing is shuffled.

Defined cases: null and empty texts have no spans (the digest of an empty string); a very long text, or a secret of any
length, is read whole and in linear time; repeated rows each get a result; an empty table gives no rows; columns of
the caller, whatever their names, keep their values. Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
EXTRA = ("spoken_email", "local_phone", "ssn", "iban", "password", "token", "key", "hex", "ipv6", "birth_date", "street", "person")
KINDS = BASE + EXTRA

#: The base patterns. Possessive loops and a start that is not inside a run find the same leftmost
#: matches as the plain patterns, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of further spans as (kind, marks of which a text holds one, pattern). Secrets have no upper
#: bound; their loops are possessive, so a long run is read once. A look behind stands after the first character, so
#: that most places are left at once.
GENERATORS = (
    ("spoken_email", ("[dot]", "(dot)", " dot "), r"[A-Za-z0-9._%+-](?<![A-Za-z0-9._%+-].)[A-Za-z0-9._%+-]{1,39}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,10}"),
    ("local_phone", (), r"[(0-9](?<![0-9+].)(?:(?<=\()[0-9]{3}\)\x20?|(?<=[0-9])[0-9]{2}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])"),
    ("ssn", (), r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", (), r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("password", ("assw", "ASSW", "pwd", "Pwd"), r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd)\x20?[=:]\x20?[\"']?[^\s\"']{6,}+"),
    ("token", ("oken", "OKEN", "ecret", "ECRET", "api", "Api", "API"), r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)\x20?[=:]\x20?[\"']?[A-Za-z0-9_./+-]{8,}+"),
    ("key", ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_", "xox"), r"[Agsx](?<![A-Za-z0-9].)(?:(?<=A)KIA[A-Z0-9]{16}|(?<=g)h[pousr]_[A-Za-z0-9]{20,}+|(?<=s)k[-_][A-Za-z0-9_-]{16,}+|(?<=x)ox[abp]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])"),
    ("hex", (), r"[0-9a-f](?<![A-Za-z0-9].)[0-9a-f]{31,}+(?![A-Za-z0-9])"),
    ("ipv6", (":",), r"[0-9A-Fa-f](?<![0-9A-Za-z:.].)(?:[0-9A-Fa-f]{0,3}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{0,3}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])"),
    ("birth_date", ("orn ", "irth", "DOB", "dob"), r"(?:[Bb]orn(?:\x20on)?|[Dd]ate\x20of\x20[Bb]irth|[Bb]irthday|DOB|dob)[:\x20]{1,3}(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})(?![0-9])"),
    ("street", ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Square", "Court"), r"[0-9](?<![0-9A-Za-z.,].)[0-9]{0,4}\x20(?:[A-Z][a-z]{2,}\x20){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square|Court)(?![A-Za-z])"),
    ("person", ("Mr", "Ms", "Mrs", "Dr.", "Prof.", "y name is "), r"(?:M(?:rs?|s)\.?|Dr\.|Prof\.|[Mm]y\x20name\x20is)\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?(?![A-Za-z])"),
)
KEY_WORDS = r"(?:password|passwd|pwd|token|secret|key|phone|tel|call|fax|mobile|mail|contact|ssn|social|iban|account|konto|cuenta|compte|address|name|lives)[^a-z]{0,6}$"
CONTEXT = 24

SPAN = "struct<kind:int,s:int,e:int,m:string>"
PRECISION, ROUNDS, RATE = 0.9, 24, 0.4
#: Values of each feature: kind, digits, length, key word, left, right, overlap with base spans.
BINS = (len(EXTRA), 5, 5, 2, 3, 3, 3)
FEATURES = ("kind", "digits", "long", "worded", "left", "right", "base")


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: str, guard: Column, kind: int) -> Column:
    """All leftmost non-overlapping matches with their places."""
    start = F.struct(F.lit(0).alias("pos"), none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def placed(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        return F.aggregate(F.zip_with(gaps, m, lambda a, b: F.struct(a.alias("gap"), b.alias("m"))), start, step)["out"]

    return F.when(guard, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none())


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.split(F.reverse(digits(m)), "")
    d = F.filter(d, lambda x: x != "")
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, 2 * x.cast("int") - 9).otherwise(2 * x.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(p == "", F.lit(0)).otherwise(F.substring(p, 1, 3).cast("int")), F.lit(0)) <= 255))


def in_order(spans: Column) -> Column:
    """By start, then kind, then end."""
    place = lambda x: F.struct(x["s"], x["kind"], x["e"], x["m"])
    back = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))
    return F.transform(F.array_sort(F.transform(spans, place)), back)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds that pass their checks."""
    email = matches(text, EMAIL, F.contains(text, F.lit("@")), 0)
    ip = F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]"), 1), lambda x: octets(x["m"]))
    card = F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), 2), lambda x: F.length(digits(x["m"])).between(12, 19) & luhn(x["m"]))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+")), 3), lambda x: F.length(digits(x["m"])).between(9, 15))
    return in_order(F.concat(email, ip, card, phone))


def proposed_spans(text: Column) -> Column:
    """What each of the other generators proposes; spans may overlap each other and the base spans."""

    def one(name: str, marks: tuple[str, ...], pattern: str) -> Column:
        guard = F.lit(False) if marks else text.rlike(pattern)
        for mark in marks:
            guard = guard | F.contains(text, F.lit(mark))
        return matches(text, pattern, guard, KINDS.index(name))

    return F.concat(*(one(*g) for g in GENERATORS))


def _side(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)


def features(text: Column, base: Column, x: Column) -> dict[str, Column]:
    """Format and context of a span as small integers."""
    before = F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    left = F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise(F.lit(""))
    right = F.substring(text, x["e"] + 1, F.lit(1))
    n, d = F.length(x["m"]), F.length(digits(x["m"]))
    return {
        "kind": x["kind"] - len(BASE),
        "digits": F.least(F.lit(4), F.floor(5 * d / n)).cast("int"),
        "long": F.when(n < 12, 0).when(n < 16, 1).when(n < 24, 2).when(n < 40, 3).otherwise(4),
        "worded": F.lower(before).rlike(KEY_WORDS).cast("int"),
        "left": _side(left),
        "right": _side(right),
        "base": F.when(F.exists(base, lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])), 2).when(F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])), 1).otherwise(0),
    }


def weak_label(x: Column) -> Column:
    """Strict checks of the value that stand in for labels when the trees are trained."""
    m, k = x["m"], x["kind"]
    is_ = lambda name: k == KINDS.index(name)
    value = F.regexp_extract(m, r"[=:]\x20?[\"']?(.*)$", 1)
    kinds_of_characters = lambda v: F.size(F.array_distinct(F.split(v, "")))
    # IBAN: the country's letters as numbers and the check digits go last; the whole leaves 1 when divided by 97.
    plain = F.regexp_replace(m, " ", "")
    moved = F.filter(F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    rest = F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    parts = F.transform(F.split(F.regexp_extract(m, r"([0-9]+[-/.][0-9]+[-/.][0-9]+)$", 1), "[-/.]"), lambda p: p.try_cast("int"))
    one = lambda i: F.get(parts, F.lit(i))
    middle, ends = one(1), F.when(one(0) > 31, one(2)).otherwise(one(0))
    return (
        F.when(is_("password"), (F.length(value) >= 8) & value.rlike("[0-9]") & (kinds_of_characters(value) >= 5))
        .when(is_("token"), (F.length(value) >= 12) & value.rlike("[0-9]") & (kinds_of_characters(value) >= 6))
        .when(is_("key"), m.rlike("[0-9]") & (kinds_of_characters(m) >= 8))
        .when(is_("ssn"), ~m.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$"))
        .when(is_("local_phone"), ~digits(m).rlike("^[01]|^(.)\\1*$"))
        .when(is_("iban"), rest == 1)
        .when(is_("hex"), m.rlike("[0-9]") & m.rlike("[a-f]") & (kinds_of_characters(m) >= 8))
        .when(is_("ipv6"), m.rlike("[0-9]"))
        .when(is_("birth_date"), (middle >= 1) & (ends >= 1) & (F.least(middle, ends) <= 12) & (F.greatest(middle, ends) <= 31))
        .when(is_("street"), ~m.rlike("^0"))
        .otherwise(F.lit(True))
    )


def training_table(docs: DataFrame) -> list[tuple[bool, tuple[int, ...], float, float]]:
    """(calibration half, features, positives, all) of the proposed spans of all documents: at most 2 * prod(BINS) rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(text.alias("text"), proposed_spans(text).alias("proposed")).where(F.size("proposed") > 0)
    spans = found.select("text", base_spans(F.col("text")).alias("base"), "proposed").select("text", "base", F.explode("proposed").alias("x"))
    f = features(F.col("text"), F.col("base"), F.col("x"))
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 1
    label = (weak_label(F.col("x")) & (f["base"] < 2)).cast("double")
    rows = spans.select(half.alias("half"), *(f[k].alias(k) for k in FEATURES), F.coalesce(label, F.lit(0.0)).alias("y")).groupBy("half", *FEATURES).agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    return sorted((bool(r.half), tuple(int(r[k]) for k in FEATURES), float(r.y), float(r.n)) for r in rows)


def _leaf(rows, grad, hess, chosen) -> float:
    return sum(grad[i] for i in chosen) / (sum(hess[i] for i in chosen) + 1.0)


def _best_split(rows, grad, hess, chosen):
    best = (1e-9, None)
    g, h = sum(grad[i] for i in chosen), sum(hess[i] for i in chosen)
    for f, bins in enumerate(BINS):
        tests = [("=", v) for v in range(bins)] if f == 0 else [("<=", v) for v in range(bins - 1)]
        for op, v in tests:
            left = [i for i in chosen if (rows[i][0][f] == v if op == "=" else rows[i][0][f] <= v)]
            if left and len(left) < len(chosen):
                a, b = sum(grad[i] for i in left), sum(hess[i] for i in left)
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, op, v, left))
    return best[1]


def _grow(rows, grad, hess, chosen, depth: int):
    split = _best_split(rows, grad, hess, chosen) if depth else None
    if split is None:
        return _leaf(rows, grad, hess, chosen)
    f, op, v, left = split
    inside = set(left)
    return f, op, v, _grow(rows, grad, hess, left, depth - 1), _grow(rows, grad, hess, [i for i in chosen if i not in inside], depth - 1)


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        f, op, v, yes, no = tree
        tree = yes if (x[f] == v if op == "=" else x[f] <= v) else no
    return tree


class Model:
    """Boosted trees over the feature table of one half, and the threshold of each kind from the other."""

    def __init__(self, table: list[tuple[bool, tuple[int, ...], float, float]], rounds: int = ROUNDS, precision: float = PRECISION):
        train = [(x, y, n) for half, x, y, n in table if not half]
        self.trees, score = [], [0.0] * len(train)
        for _ in range(rounds if train else 0):
            p = [1 / (1 + math.exp(-s)) for s in score]
            grad = [y - n * q for (_, y, n), q in zip(train, p, strict=True)]
            hess = [n * q * (1 - q) for (_, _, n), q in zip(train, p, strict=True)]
            tree = _grow(train, grad, hess, list(range(len(train))), 3)
            self.trees.append(tree)
            score = [s + RATE * _value(tree, x) for s, (x, _, _) in zip(score, train, strict=True)]
        other = [(self.score(x), x[0], y, n) for half, x, y, n in table if half]
        self.thresholds = [self._threshold([(s, y, n) for s, kind, y, n in other if kind == k], precision) for k in range(len(EXTRA))]

    @staticmethod
    def _threshold(rows: list[tuple[float, float, float]], precision: float) -> float:
        """The least score from which on the spans of a kind are precise enough; none: infinite; no spans: an even score."""
        if not rows:
            return 0.0
        best, hits, n = math.inf, 0.0, 0.0
        for s in sorted({r[0] for r in rows}, reverse=True):
            for _, y, m in (r for r in rows if r[0] == s):
                hits, n = hits + y, n + m
            if hits >= precision * n:
                best = s
        return best

    def score(self, x) -> float:
        return sum(RATE * _value(t, x) for t in self.trees)

    def column(self, f: dict[str, Column]) -> Column:
        """Whether a span with these features is selected: the trees as CASE expressions."""

        def compiled(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            k, op, v, yes, no = tree
            c = f[FEATURES[k]]
            return F.when(c == v if op == "=" else c <= v, compiled(yes)).otherwise(compiled(no))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + F.lit(RATE) * compiled(t)
        limit = F.lit(math.inf)
        for k, v in enumerate(self.thresholds):
            limit = F.when(f["kind"] == k, F.lit(v - 1e-9 if v < math.inf else math.inf)).otherwise(limit)
        return total >= limit

    def as_table(self) -> dict[tuple[int, ...], bool]:
        return {x: self.score(x) >= self.thresholds[x[0]] - 1e-9 for x in product(*(range(b) for b in BINS))}


def fit(docs: DataFrame) -> Model:
    return Model(training_table(docs.select("text")))


def find_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc`` (the row), ``text`` (null as empty), ``base`` (base spans) and ``spans`` (all spans by start, then kind);
    a span is (kind, s, e, m)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text.alias("text"))
    found = found.select("doc", "text", base_spans(F.col("text")).alias("base"), proposed_spans(F.col("text")).alias("proposed"))

    def selected(x: Column) -> Column:
        packed = F.struct(*(c.alias(k) for k, c in features(F.col("text"), F.col("base"), x).items()))
        return let(packed, lambda f: model.column({k: f[k] for k in FEATURES}))

    spans = F.when(F.size("proposed") > 0, in_order(F.concat("base", F.filter("proposed", selected)))).otherwise(F.col("base"))
    return found.select("doc", "text", "base", spans.alias("spans"))


def kind_name(k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in KINDS)), k + 1)


def listing(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", kind_name(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))))


def base_digest(found: DataFrame) -> list[Column]:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    return [*(count(k) for k in range(4)), F.sha2(listing(F.col("base")), 256).alias("base_sha256")]


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the contract."""
    docs = docs.select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    return found.select("doc.doc_id", *base_digest(found), listing(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one replacement of the first."""
    found = find_spans(docs, model)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.array(F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]), F.concat(F.lit("["), F.upper(kind_name(x["kind"])), F.lit("]")))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(x["s"] >= acc["pos"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    new = F.when(F.size("spans") > 0, done).otherwise(F.col("doc.text"))
    return found.select(*((new if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
