"""Personal data by candidate gradient boosting.

High-recall generators (patterns) propose overlapping spans of five kinds.  Boosted
trees score every candidate by its format and its surroundings, and a threshold per
kind, calibrated on candidates kept from training, selects the spans to redact.
Spans of the exact base patterns (email, ip, card, phone) are always selected.

There are no labels for personal data, so the trees learn at a distance.  Positive
examples are base spans, account numbers with right check digits, strings of IPv6 form,
phone-like numbers right behind a word for phone, and the base e-mails rewritten in
disguise ("name (at) host (dot) com").  Ambiguous candidates (part of a base span, a cue
word nearby, a disguised e-mail as found) are no examples; the others are negative.  The
marks that decide on labels (check digits, the plus sign, the exact form) are no
features, but for the cue words.  Training reads at most about ``TRAIN_DOCS`` documents,
chosen by a hash of the text; thresholds are set on the candidates of all documents that
training didn't see (a kind without a positive there: on all its candidates).  The trees
become one column expression, so that scoring takes place within each row.

All work on texts is DataFrame code.  Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; a corpus whose sample lacks positive
or negative examples adds no spans; a text may hold any number of spans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens.session import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account")
TRAIN_DOCS = 200_000
TREES, DEPTH = 12, 3
#: Share of selected held-out candidates of a kind that must be positive.
PRECISION = 0.9
CONTEXT = 24
#: Elements of an array that running results are built up over at once.
BLOCK = 128

#: The base patterns, in forms that read a text of any length in one pass.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: IBAN countries by the length of their numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC",
}
_IBANS = "|".join(rf"(?:{c})[0-9]{{2}}(?: ?+[A-Z0-9]){{{n - 4}}}(?![A-Z0-9])" for n, c in IBAN_LENGTHS.items())
_AT, _DOT = r"(?:\((?i:at)\)|\[(?i:at)\])", r"(?:\((?i:dot)\)|\[(?i:dot)\])"
#: An e-mail with blanks only beside spelt-out signs.
TIGHT_EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{{1,64}}+(?:@| ?{_AT} ?)[A-Za-z0-9-]++(?:(?:\.| ?{_DOT} ?)[A-Za-z0-9-]++)++"
#: How training rewrites the signs of an e-mail.
DISGUISES = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), (" @ ", "."))
#: What a text must hold for a generator to match.
EMAIL_SIGN = r"@|[(\[](?i:at)[)\]]"
ANY_SIGN = rf"[0-9]|{EMAIL_SIGN}"
#: The generators; they propose far more than the base patterns accept.
GENERATORS = {
    "email": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{{1,64}}+ ?(?:@|{_AT}) ?[A-Za-z0-9-]++(?: ?(?:\.|{_DOT}) ?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9A-Fa-f:.])|\G)(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3,5}+|[0-9A-Fa-f]{1,4}+(?::{1,2}+[0-9A-Fa-f]{1,4}+){4,7}+)",
    "card": r"(?:(?<![0-9])|\G)[0-9]{3,6}+(?:[ -]?+[0-9]{2,6}+){2,6}+",
    "phone": r"(?:(?<![0-9])|\G)[+(]{0,2}+[0-9]{1,4}+\)?+(?:[ ().-]{1,2}+[0-9]{2,5}+){2,5}+",
    "account": rf"(?:(?<![A-Z0-9])|\G)(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?: ?+[A-Z0-9]{{4}}){{3,7}}+)",
}
#: Words before a span that speak for a kind.
CUES = {
    "email": "mail|contact|write|kontakt|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|anruf",
    "account": "iban|account|konto|compte|cuenta|bank",
}
FEATURES = ("length", "digits", "letters", "blanks", "dots", "dashes", "colons", "brackets", "parts", "longest", "kind", "cue", "before", "after")


def bound(x: Column, made: Callable[[Column], Column]) -> Column:
    """``made(x)`` with x evaluated once, whatever number of times lambdas in it refer to it."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The running results of ``step`` over an array, each element included.

    Blocks of ``BLOCK`` elements run by themselves, then the blocks' last results, so that
    no array longer than a block, or than the number of blocks, grows by an element a time.
    """

    def run(part: Column, shifted: bool) -> Column:
        empty = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            new = step(acc["at"], x)
            return F.struct(new.alias("at"), F.concat(acc["out"], F.array(acc["at"] if shifted else new)).alias("out"))

        return F.aggregate(part, empty, add, lambda acc: acc["out"])

    def blocks(all_values: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / BLOCK).cast("int"))
        return F.transform(cuts, lambda i: run(F.slice(all_values, i * BLOCK + 1, F.lit(BLOCK)), False))

    def joined(parts: Column) -> Column:
        heads = run(F.transform(parts, lambda part: F.element_at(part, -1)), True)
        return F.flatten(F.zip_with(parts, heads, lambda part, head: F.transform(part, lambda x: step(head, x))))

    return bound(values, lambda v: F.when(F.size(v) > 0, bound(blocks(v), joined)).otherwise(F.array().cast("array<int>")))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of a pattern's matches, left to right.

    What lies between the matches comes from a split by the same pattern; ends are
    running sums of the lengths of both.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(values: Column) -> Column:
        sizes = F.zip_with(values, F.slice(F.split(text, pattern, -1), 1, F.size(values)), lambda v, gap: F.length(v) + F.length(gap))
        ends = running(sizes, lambda a, b: a + b, F.lit(0))
        return F.zip_with(values, ends, lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.when(F.size(v) > 0, placed(v)).otherwise(empty))


def uncovered(spans: Column, base: Column) -> Column:
    """(start, end, kind, value) of the spans that lie in no base span, by start.

    Both are sorted together, longer spans and base spans first: a span is covered if a
    base span before it reaches as far.
    """

    def mark(s: Column, more: int) -> Column:
        return F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(more).alias("more"), s["kind"].alias("kind"), s["value"].alias("value"))

    def chosen(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: F.when(x["more"] == 0, -x["back"]).otherwise(-1)), F.greatest, F.lit(-1))
        marked = F.zip_with(both, reach, lambda x, far: F.struct(x.alias("x"), far.alias("far")))
        kept = F.filter(marked, lambda m: (m["x"]["more"] == 1) & (m["far"] < -m["x"]["back"]))
        return F.transform(
            kept, lambda m: F.struct(m["x"]["kind"].alias("kind"), m["x"]["start"].alias("start"), (-m["x"]["back"]).alias("end"), m["x"]["value"].alias("value"))
        )

    both = F.concat(F.transform(base, lambda s: mark(s, 0)), F.transform(spans, lambda s: mark(s, 1)))
    return bound(F.sort_array(both), chosen)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    marks = F.transform(F.split(F.reverse(digits), "(?!^)(?=.)"), lambda d: d.cast("int"))
    doubled = F.transform(marks, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def iban(value: Column) -> Column:
    """Whether an account number has right check digits (mod 97)."""
    marks = F.replace(value, F.lit(" "), F.lit(""))
    codes = F.transform(F.split(F.concat(F.substring(marks, 5, 64), F.substring(marks, 1, 4)), "(?!^)(?=.)"), F.ascii)
    digits = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97)
    return digits == 1


def ipv6(value: Column) -> Column:
    """True for strings of IPv6 form, null for eight short groups (which other numbers
    have, too), else false."""
    gaps = F.size(F.split(value, "::", -1)) - 1
    groups = F.size(F.split(value, "::?", -1))
    short = ~value.rlike("[0-9A-Fa-f]{3}")
    whole = F.when(gaps == 0, F.when(groups == 8, F.when(~short, True)).otherwise(False))
    return F.when(gaps > 0, (gaps == 1) & (groups < 8)).otherwise(whole)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _if(has: Column, spans: Column) -> Column:
    """No pattern is tried on a text without the sign that it needs."""
    return F.when(has, spans).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>"))


def _if_present(text: Column, kind: str, spans: Column) -> Column:
    has = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    return _if(has & text.rlike("[0-9@]"), spans)


def _spans(text: Column, kind: str, pattern: str, check: bool) -> Column:
    hits = found(text, pattern)
    hits = F.filter(hits, lambda s: _valid(kind, s["value"])) if check else hits
    k = F.lit(KINDS.index(kind))
    return F.transform(hits, lambda s: F.struct(k.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,value>> of the base patterns; kind is a number."""
    return F.concat(*[_if_present(text, k, _spans(text, k, p, True)) for k, p in BASE.items()])


def candidates(text: Column) -> Column:
    """What the generators propose, overlapping spans and all kinds."""
    made = [_if(text.rlike("[0-9]"), _spans(text, k, p, False)) for k, p in GENERATORS.items() if k != "email"]
    loose = F.filter(_spans(text, "email", GENERATORS["email"], False), lambda s: ~s["value"].rlike(f"^{TIGHT_EMAIL}$"))
    tight = _spans(text, "email", TIGHT_EMAIL, False)
    return F.concat(_if(text.rlike(EMAIL_SIGN), F.concat(tight, loose)), *made)


def _count(value: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kept}]", "")).cast("double")


def _before(text: Column, span: Column, n: int = CONTEXT) -> Column:
    return F.substring(text, F.greatest(span["start"] - n, F.lit(0)) + 1, F.least(span["start"], F.lit(n)))


def _cue(text: Column, span: Column) -> Column:
    """2 for a cue word right before a span, 1 for one near, else 0."""
    before = F.lower(_before(text, span))

    def strength(k: str) -> Column:
        close = before.rlike(rf"\b(?:{CUES[k]})\b[^\p{{L}}\p{{N}}]*$")
        return F.when(close, 2).when(before.rlike(CUES[k]), 1).otherwise(0)

    return reduce(lambda rest, k: F.when(span["kind"] == KINDS.index(k), strength(k)).otherwise(rest), CUES, F.lit(0))


def features(text: Column, span: Column) -> Column:
    """struct of the features of a candidate."""
    value = span["value"]
    before = F.lower(_before(text, span))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    digits = F.split(value, "[^0-9]+")
    made = {
        "length": F.length(value).cast("double"),
        "digits": _count(value, "0-9"),
        "letters": _count(value, "A-Za-z"),
        "blanks": _count(value, " "),
        "dots": _count(value, "."),
        "dashes": _count(value, "-"),
        "colons": _count(value, ":"),
        "brackets": _count(value, r"()\[\]"),
        "parts": F.size(F.filter(digits, lambda p: p != "")).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(digits, lambda p: F.length(p))), F.lit(0)).cast("double"),
        "kind": span["kind"].cast("double"),
        "cue": _cue(text, span).cast("double"),
        "before": before.rlike(r"[\p{L}\p{N}]$").cast("double"),
        "after": after.rlike(r"[\p{L}\p{N}]").cast("double"),
    }
    return F.struct(*[made[f].alias(f) for f in FEATURES])


def _node(node, get) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    x = get(FEATURES[split.featureIndex()])
    return F.when(x <= F.lit(float(split.threshold())), _node(node.leftChild(), get)).otherwise(_node(node.rightChild(), get))


def margin(model, get) -> Column:
    """The boosted trees as a column expression over features."""
    return reduce(lambda a, b: a + b, [_node(t.rootNode(), get) * F.lit(float(w)) for t, w in zip(model._java_obj.trees(), model.treeWeights, strict=True)])


def probability(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * m))


class Detector:
    """Boosted trees and their thresholds per kind; None trees add no spans."""

    def __init__(self, model=None, thresholds: dict[str, float] | None = None):
        self.model, self.thresholds = model, thresholds or {}

    def selected(self, text: Column, spans: Column) -> Column:
        """The candidates over their kind's threshold."""
        if self.model is None or not self.thresholds:
            return F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
        limit = F.lit([self.thresholds.get(k, 2.0) for k in KINDS])
        scored = F.transform(spans, lambda s: F.struct(s.alias("s"), features(text, s).alias("f")))
        kept = F.filter(scored, lambda x: probability(margin(self.model, lambda name: x["f"][name])) >= F.get(limit, x["s"]["kind"]))
        return F.transform(kept, lambda x: x["s"])


def _disguised(text: Column, base: Column) -> Column:
    """array<struct<text,start,end>>: every base e-mail in disguise, with what is around it."""
    style = [F.lit([d[i] for d in DISGUISES]) for i in (0, 1)]

    def remade(s: Column) -> Column:
        at, dot = (F.get(x, F.pmod(F.xxhash64(s["value"]), F.lit(len(DISGUISES))).cast("int")) for x in style)
        before = _before(text, s, 2 * CONTEXT)
        value = F.concat(F.substring_index(s["value"], "@", 1), at, F.replace(F.substring_index(s["value"], "@", -1), F.lit("."), dot))
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT))
        start = F.length(before)
        return F.struct(F.concat(before, value, after).alias("text"), start.alias("start"), (start + F.length(value)).alias("end"))

    return F.transform(F.filter(base, lambda s: s["kind"] == KINDS.index("email")), remade)


def _label(text: Column, base: Column, c: Column) -> Column:
    """1, 0 or null (ambiguous) for a candidate of a text."""
    kind, value = c["kind"], c["value"]
    is_kind = {k: kind == i for i, k in enumerate(KINDS)}
    same = F.exists(base, lambda b: (b["kind"] == kind) & (b["start"] == c["start"]) & (b["end"] == c["end"]))
    touch = F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    within = F.exists(base, lambda b: (b["kind"] == kind) & (b["start"] >= c["start"]) & (b["end"] <= c["end"]))
    cue = _cue(text, c)
    number = F.length(F.regexp_replace(value, "[^0-9]", "")).between(7, 15)
    # A base e-mail and more, without any spelt-out sign, runs into the next sentence.
    email = F.when(within & ~value.rlike(r"[(\[]"), 0.0)
    six = F.when(ipv6(value), 1.0).when(~ipv6(value) & (cue == 0), 0.0)
    label = F.when(same, 1.0).when(is_kind["email"], email).when(is_kind["ip"] & F.contains(value, F.lit(":")), six)
    label = label.when(is_kind["account"] & iban(value), 1.0).when(is_kind["phone"] & ~touch & (cue == 2) & number, 1.0)
    return label.when(~touch & (cue == 0), 0.0)


def _labelled(rows: DataFrame) -> DataFrame:
    """label, fold, trained and features of the examples of texts (text, h, trained)."""
    text = F.col("text")
    whole = F.array(F.struct(text.alias("text"), F.lit(-1).alias("start"), F.lit(-1).alias("end")))
    views = rows.withColumn("base", base_spans(text)).select("h", "trained", "base", F.explode(F.concat(whole, _disguised(text, F.col("base")))).alias("v"))
    v = F.col("v")
    # In a rewritten text, only what reaches over the rewritten e-mail is an example.
    over = lambda c: (c["kind"] == KINDS.index("email")) & (c["start"] <= v["start"]) & (c["end"] >= v["end"])
    exact = lambda c: (c["start"] == v["start"]) & (c["end"] == v["end"])
    remade = lambda c: F.when(over(c), exact(c).cast("double"))
    made = F.transform(
        candidates(v["text"]),
        lambda c: F.struct(
            F.when(v["start"] < 0, _label(v["text"], F.col("base"), c)).otherwise(remade(c)).alias("label"),
            F.pmod(F.xxhash64("h", c["start"], v["start"]), F.lit(10)).alias("fold"),
            features(v["text"], c).alias("f"),
        ),
    )
    found = views.select("trained", F.explode(F.filter(made, lambda x: x["label"].isNotNull())).alias("x"))
    return found.select("x.label", "x.fold", "trained", "x.f.*")


def _texts(docs: DataFrame, train_docs: int) -> DataFrame:
    """text, h and whether a text is one of those that training reads."""
    share = max(1, -(-docs.count() // train_docs))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(ANY_SIGN)).withColumn("h", F.xxhash64("text"))
    return rows.withColumn("trained", F.pmod("h", F.lit(share)) == 0)


def examples(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """label, fold (2 of 10: calibration) and features of candidates of sampled texts."""
    return _labelled(_texts(docs, train_docs).where("trained")).drop("trained")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, precision: float = PRECISION) -> Detector:
    rows = materialize(examples(docs, train_docs), "pii-examples")
    counts = {(r.kind, r.label): r.n for r in rows.where("fold >= 2").groupBy("kind", "label").agg(F.count("*").alias("n")).collect()}
    if len({label for _, label in counts}) < 2:
        return Detector()
    # Rare kinds and labels weigh as much as frequent ones.
    total = sum(counts.values())
    weight = reduce(
        lambda rest, x: F.when((F.col("kind") == x[0][0]) & (F.col("label") == x[0][1]), total / (len(counts) * x[1])).otherwise(rest), counts.items(), F.lit(0.0)
    )
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("weight", weight))
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3, weightCol="weight", cacheNodeIds=False, checkpointInterval=-1)
    model = gbt.fit(data.where("fold >= 2").select("features", "label", "weight"))
    every = _labelled(_texts(docs, train_docs)).withColumn("seen", F.col("trained") & (F.col("fold") >= 2))
    every = every.withColumn("p", F.floor(probability(margin(model, F.col)) * 50) / 50)
    bins = every.groupBy("kind", "p", "seen").agg(F.sum("label").alias("hit"), F.count("*").alias("n")).collect()
    kept = {r.kind for r in bins if not r.seen and r.hit}
    return Detector(model, calibrated(_merged([r for r in bins if not r.seen or r.kind not in kept]), precision))


def _merged(bins: list) -> list[tuple[str, float, float, int]]:
    """(kind, score, positives, examples) by kind and score."""
    out: dict[tuple[str, float], tuple[float, int]] = {}
    for r in bins:
        key = KINDS[int(r.kind)], r.p
        hit, n = out.get(key, (0.0, 0))
        out[key] = hit + r.hit, n + r.n
    return [(*key, *x) for key, x in out.items()]


def calibrated(bins: list[tuple[str, float, float, int]], precision: float) -> dict[str, float]:
    """The least score per kind from which on the share of positives reaches ``precision``."""
    out: dict[str, float] = {}
    for kind in {b[0] for b in bins}:
        hit = n = 0.0
        for _, p, h, c in sorted((b for b in bins if b[0] == kind), reverse=True, key=lambda b: b[1]):
            hit, n = hit + h, n + c
            if hit >= precision * n:
                out[kind] = p
    return out


def find_pii(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of struct<kind,start,end>, by start and kind, kinds
    by name; ``spans`` holds the base spans and what the trees select besides."""
    detector = detector or train(docs)
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(text))
    if detector.model is not None:
        chosen = detector.selected(text, candidates(text))
        chosen = uncovered(chosen, F.col("base"))
        rows = rows.withColumn("more", F.when(text.rlike(ANY_SIGN), chosen).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")))
        rows = rows.withColumn("all", F.concat("base", "more"))
    else:
        rows = rows.withColumn("all", F.col("base"))
    names = F.lit(list(KINDS))

    def named(spans: str) -> Column:
        ordered = F.sort_array(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("k"), s["end"].alias("end"))))
        once = bound(ordered, lambda o: F.filter(o, lambda s, i: (i == 0) | (s != F.get(o, i - 1))))
        return F.transform(once, lambda s: F.struct(F.get(names, s["k"]).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))

    return rows.select("doc_id", named("base").alias("base"), named("all").alias("spans"))
