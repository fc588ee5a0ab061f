"""Personal data: patterns with checks, and boosted trees over candidate spans. DataFrame functions and Spark's own trees only.

Base spans come from four patterns with a check each (email, ip, card, phone).
Generators with high recall then propose further spans, which may overlap:
national phone numbers, spelled-out addresses, keys, account numbers, card-like
numbers. Boosted trees score each candidate by its format and by the text
around it. They are fitted on the candidates of all texts, where a candidate
that covers a base span, or is named by the words before it, is taken as
personal; neither of the two is a feature. A threshold per kind is
calibrated on the third of them kept from the fit, so that at least
``PRECISION`` of what it selects is personal; a kind that never gets there adds nothing.

The trees become one SQL expression, applied to the array of candidates of each
row: no text is shuffled, and a document is scored where it is read.

Patterns are possessive, and start where a run starts or the last match ended:
the same matches as their plain forms, without repeated scans of long runs.

Defined cases: a null text is empty and has no span; without candidates of
both classes none is added; rows equal in id and text have equal spans.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import land

#: Base patterns in the order of the digest.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates.
MORE = {
    "national_phone": r"(?<![0-9+])\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?)[A-Za-z0-9-]++)++",
    "key": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{24,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card_like": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{2,7}(?![0-9])",
}
#: Words before a span that name it.
NAMED = r"(?i)(?:token|secret|password|passwd|api.?key|key|tel|phone|fax|mobile|mail|iban|account|card)\W{0,4}\z"
#: Trees and their depth, least share of personal spans among the selected.
TREES, DEPTH, PRECISION = 12, 3, 0.95
AROUND = 24
FEATURES = ["kind", "size", "digits", "letters", "upper", "breaks", "parts", "distinct", "luhn", "octets", "space_before", "space_after", "plus_before", "quote_before", "equals_before", "letters_around"]


#: Doubling steps of the scans over the matches of one text.
STEPS = [1 << k for k in range(31)]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(entries: Column, step, finish) -> Column:
    """Scan an array in place by doubling: ``step(entry, earlier)`` takes in the entry ``s`` places before (null at the front)."""
    def scan(p):
        needed = F.filter(F.array(*[F.lit(s) for s in STEPS]), lambda s: s < F.size(p))
        return F.aggregate(needed, p, lambda acc, s: F.transform(acc, lambda x, i: step(x, F.get(acc, i - s))), finish)

    return _bound(entries, scan)


def spans(body: Column, pattern: str, around: bool = False) -> Column:
    """``array<struct<start, end, text>>`` of all matches, in code points, with the text before and after if asked for.

    Ends are running sums of the lengths of gaps and matches, so a text with
    many matches takes little longer than one with few of the same length.
    """
    sides = lambda g: [F.left(g, F.lit(AROUND)).alias("head"), F.right(g, F.lit(AROUND)).alias("tail")] if around else []
    kept = ["text", "head", "tail"] if around else ["text"]

    def step(x, earlier):
        return F.struct((x["end"] + F.coalesce(earlier["end"], F.lit(0))).alias("end"), *[x[c].alias(c) for c in kept])

    def placed(acc):
        def one(x, i):
            fields = [(x["end"] - F.char_length(x["text"])).alias("start"), x["end"].alias("end"), x["text"].alias("text")]
            if around:
                # Candidates have at least eight characters, so three of them and the gaps between fill a side.
                none = F.lit("")
                part = lambda k, c: F.coalesce(F.get(acc, i + k)[c], none)
                before = F.concat(*[y for k in (-3, -2, -1) for y in (part(k, "tail"), F.right(part(k, "text"), F.lit(AROUND)))], x["tail"])
                after = F.concat(*[y for k in (1, 2, 3) for y in (part(k, "head"), F.left(part(k, "text"), F.lit(AROUND)))], part(4, "head"))
                fields += [F.right(before, F.lit(AROUND)).alias("before"), F.left(after, F.lit(AROUND)).alias("after")]
            return F.struct(*fields)

        return F.filter(F.transform(acc, one), lambda s: s["text"].isNotNull())

    def located(found):
        # The last gap has no match behind it. Texts without a match are not cut at all.
        gap = lambda g, m: F.struct((F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0))).alias("end"), m.alias("text"), *sides(g))
        scanned = _scan(F.zip_with(F.split(body, pattern, -1), found, gap), step, placed)
        fields = ["start", "end", "text", "before", "after"] if around else ["start", "end", "text"]
        none = F.array().cast("array<struct<" + ",".join(f"{c}:{'int' if c in ('start', 'end') else 'string'}" for c in fields) + ">>")
        return F.when(F.size(found) > 0, scanned).otherwise(none)

    return _bound(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), located)


def meeting(base: Column, found: Column) -> Column:
    """``array<struct<c, meets>>``: each candidate of ``found``, in order, and whether it overlaps a span of ``base``.

    Among the base spans that begin before a candidate ends, one reaches into
    it exactly if the furthest end of them does: a running maximum over both,
    sorted together.
    """
    return _bound(F.struct(base.alias("base"), found.alias("found")), lambda p: _meeting(p["base"], p["found"]))


def _meeting(base: Column, found: Column) -> Column:
    marks = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("top"), F.lit(-1).alias("i")))
    asks = F.transform(found, lambda c, i: F.struct(c["end"].alias("at"), F.lit(0).alias("base"), F.lit(0).alias("top"), i.alias("i")))

    def step(x, earlier):
        return F.struct(x["at"].alias("at"), x["base"].alias("base"), F.greatest(x["top"], F.coalesce(earlier["top"], F.lit(0))).alias("top"), x["i"].alias("i"))

    def tops(acc):
        answers = F.filter(acc, lambda x: x["base"] == 0)
        return F.transform(F.array_sort(F.transform(answers, lambda x: F.struct(x["i"].alias("i"), x["top"].alias("top")))), lambda x: x["top"])

    reach = _scan(F.array_sort(F.concat(marks, asks)), step, tops)
    return F.zip_with(found, reach, lambda c, top: F.struct(c.alias("c"), (top > c["start"]).alias("meets")))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a short string of digits is right."""
    turned = F.reverse(digits)
    each = F.transform(F.regexp_extract_all(turned, F.lit("[0-9]"), F.lit(0)), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _valid(kind: str, s: Column) -> Column:
    text = s["text"]
    count = F.char_length(digits_of(text))
    if kind == "ip":
        return octets(text)
    if kind == "card":
        return F.when(count.between(16, 19), luhn(digits_of(text))).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(8, 15)
    return F.lit(True)


def base_spans(body: Column) -> dict[str, Column]:
    """Checked spans of each kind; the cheap test for a needed sign comes first."""
    out = {}
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    for kind, pattern in BASE.items():
        found = F.filter(spans(body, pattern), partial(_valid, kind))
        sign = {"email": "@", "phone": "+"}.get(kind)
        out[kind] = F.when(F.contains(body, F.lit(sign)), found).otherwise(none) if sign else found
    return out


def candidates(body: Column) -> Column:
    """All proposed spans with the text around them: ``array<struct<kind, name, start, end, text, before, after>>``."""
    tagged = lambda i, name, c: F.struct(F.lit(i).alias("kind"), F.lit(name).alias("name"), *[c[x].alias(x) for x in ("start", "end", "text", "before", "after")])
    return F.concat(*[F.transform(spans(body, pattern, around=True), partial(tagged, i, name)) for i, (name, pattern) in enumerate(MORE.items())])


def feature_values(c: Column) -> dict[str, Column]:
    text, size = c["text"], F.char_length(c["text"])
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    values = {
        "kind": c["kind"], "size": size, "digits": share("[0-9]"), "letters": share("[a-z]"), "upper": share("[A-Z]"),
        "breaks": F.regexp_count(text, F.lit(r"[^A-Za-z0-9]")), "parts": F.size(F.split(text, r"[^A-Za-z0-9]+")),
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / size, "luhn": luhn(digits_of(text)), "octets": octets(text),
        "space_before": c["before"].rlike(r"\s\z"), "space_after": c["after"].rlike(r"\A\s"), "plus_before": c["before"].rlike(r"\+[0-9]{0,3}\s?\z"),
        "quote_before": c["before"].rlike(r"[\"'`]\z"), "equals_before": c["before"].rlike(r"=\s*[\"'`]?\z"),
        "letters_around": F.regexp_count(F.concat(c["before"], c["after"]), F.lit("[A-Za-z]")),
    }
    return {k: values[k].cast("double").alias(k) for k in FEATURES}


def _personal(c: Column, meets: Column) -> Column:
    """The label of the fit: it meets a base span, or the words before it name it."""
    return meets | c["before"].rlike(NAMED) | c["before"].rlike(r"(?i)(?:token|secret|key)\s*[=:]\s*[\"'`]?\z")


def _tree_expression(node, values: list[Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(values[split.featureIndex()] <= F.lit(float(split.threshold())), _tree_expression(node.leftChild(), values)).otherwise(_tree_expression(node.rightChild(), values))


class Scorer:
    """Fitted trees and the calibrated threshold of each kind."""

    def __init__(self, roots: list, weights: list[float], thresholds: dict[int, float]):
        self.roots, self.weights, self.thresholds = roots, weights, thresholds

    def score(self, c: Column) -> Column:
        values = [feature_values(c)[k] for k in FEATURES]
        margin = reduce(lambda a, b: a + b, [_tree_expression(r, values) * w for r, w in zip(self.roots, self.weights, strict=True)])
        return 1 / (1 + F.exp(-2 * margin))

    def selected(self, c: Column) -> Column:
        least = F.lit(2.0)
        for kind, t in self.thresholds.items():
            least = F.when(c["kind"] == kind, F.lit(t)).otherwise(least)
        return self.score(c) >= least


def train(docs: DataFrame) -> Scorer | None:
    """Fit on the candidates of all documents; candidates alike in every feature and in label count as one row with a weight."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_base = docs.select(body.alias("body")).select(F.concat(*base_spans(F.col("body")).values()).alias("base"), candidates(F.col("body")).alias("c"))
    spans_of = with_base.select(F.explode(meeting(F.col("base"), F.col("c"))).alias("m")).select("m.c", "m.meets")
    held = F.pmod(F.xxhash64(F.xxhash64("c")), F.lit(3)) == 0
    alike = [*FEATURES, "label", "held"]
    rows = spans_of.select(*feature_values(F.col("c")).values(), _personal(F.col("c"), F.col("meets")).cast("double").alias("label"), held.alias("held"))
    rows = land(rows.groupBy(*alike).agg(F.count(F.lit(1)).cast("double").alias("weight")), "pii-candidates")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    fit_rows = assembler.transform(rows.where("NOT held"))
    if {r[0] for r in fit_rows.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.2, maxBins=32, weightCol="weight").fit(fit_rows)
    scorer = Scorer([t._call_java("rootNode") for t in model.trees], list(model.treeWeights), {})
    # Calibration: for each kind the lowest score at and above which enough of the held-out spans are personal.
    held = rows.where("held").select("label", "weight", "kind", F.struct(*FEATURES).alias("f"))
    values = [F.col("f")[k] for k in FEATURES]
    margin = reduce(lambda a, b: a + b, [_tree_expression(r, values) * w for r, w in zip(scorer.roots, scorer.weights, strict=True)])
    scored = held.select(F.col("kind").cast("int").alias("kind"), "label", "weight", F.floor(100 / (1 + F.exp(-2 * margin))).cast("int").alias("level"))
    counts = scored.groupBy("kind", "level").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).collect()  # at most 101 levels a kind
    for kind in {r["kind"] for r in counts}:
        n = good = 0
        for r in sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["level"]):
            n, good = n + r["n"], good + r["good"]
            if r["level"] >= 50 and good >= PRECISION * n:
                scorer.thresholds[kind] = r["level"] / 100
    return scorer


def _listed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find_pii(docs: DataFrame, scorer: Scorer | None = None, fit: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and ``n_added``."""
    if scorer is None and fit:
        scorer = train(docs)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body)
    rows = rows.select("doc_id", "body", *(v.alias(k) for k, v in base_spans(F.col("body")).items()))
    none = F.array().cast("array<string>")
    added = none
    if scorer is not None and scorer.thresholds:
        # A candidate that meets a base span is left out: the base span stays as it is.
        rows = rows.withColumn("picked", F.filter(candidates(F.col("body")), scorer.selected))
        free = F.filter(meeting(F.concat(*[F.col(k) for k in BASE]), F.col("picked")), lambda m: ~m["meets"])
        added = F.transform(free, lambda m: F.concat(m["c"]["name"], F.lit(":"), m["c"]["start"].cast("string"), F.lit(":"), m["c"]["end"].cast("string")))
    base_list = F.concat(*[_listed(k, F.col(k)) for k in BASE])
    rows = rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), base_list.alias("base"), added.alias("added"))
    return rows.select(
        "doc_id", *(f"n_{k}" for k in BASE), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base", "added"), ",").alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
