"""Personal data (operator 5, DataFrame functions only): generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Spans of the four base kinds that pass their format test are always kept. Generators of further kinds propose candidates in the same texts; each candidate
has format features (lengths, digits, separators, its kind's own format test) and context features (neighbouring characters, words before it that speak for
or against personal data). The trees are fitted by Spark ML and are then written out as one column expression, so that the whole scan is a narrow
projection without a shuffle.

No spans are labelled, so training rows are made: values of each kind, well and badly formed, are set into places of sampled documents after personal, other
or no cue words, cleanly or glued to their neighbours. A row's label is drawn with the chance that PRIORS gives its kind, cue and form, so that no feature
alone is the label. Each kind's threshold is the least score from which on that share of the held-out rows is personal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import discard, let, table, text_or_empty, written

#: Documents that the trees are fitted on, at most about so many, and places in each.
SAMPLE_DOCS, PLACES = 4000, 4
#: The share of personal rows among those that a kind's threshold selects, held-out rows.
PRECISION = 0.9
FEATURES = ("length", "digits", "letters", "separators", "groups", "check", "left_edge", "right_edge", "cue", "other", "kind")
SPAN = "struct<kind:string,start:int,end:int,value:string>"
CUES = ("email", "contact", "phone", "tel", "call", "mobile", "fax", "card", "visa", "account", "iban", "bank", "ssn", "social security", "reach", "write to")
OTHER = ("version", "part", "order", "invoice", "ref", "serial", "model", "lot", "item", "sku", "size", "page", "isbn", "build", "batch", "room")
_BEFORE = "(?i)(?<![A-Za-z])({})[^A-Za-z0-9]*(?:(?:no|nr|id|number|is|at|me|us|to|my|our|on|of)[^A-Za-z0-9]*){{0,2}}$"
#: The chance that a well formed value is personal: after a personal cue, with no cue, after another cue; and the same for a badly formed one.
PRIORS = {
    "obfuscated_email": ((0.99, 0.95, 0.40), (0.50, 0.10, 0.02)),
    "national_phone": ((0.99, 0.80, 0.03), (0.70, 0.10, 0.01)),
    "social_number": ((0.99, 0.60, 0.03), (0.60, 0.05, 0.01)),
    "iban": ((0.99, 0.95, 0.40), (0.20, 0.05, 0.01)),
    "short_card": ((0.99, 0.90, 0.20), (0.20, 0.04, 0.01)),
}
#: What is left of that chance if the value is glued to its neighbours.
GLUED = 0.2

# Each pattern tries a run of its first class only at the run's start (or where the last match ended) and never steps back into it, so that long runs cost
# time in proportion to their length. The matches are those of the plain patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MORE = {
    "obfuscated_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]++)++",
    "national_phone": r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "social_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "short_card": r"(?<![0-9-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9-])",
}
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def sums_before(lengths: Column, chunk: int = 64) -> Column:
    """The sum of the elements before each of an array of integers, in chunks, so that long arrays take little more than time in proportion."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    last = lambda n: F.floor((n - 1) / chunk).cast("int")
    whole = lambda a: F.transform(F.sequence(F.lit(0), last(F.size(a))), lambda c: total(F.slice(a, c * chunk + 1, chunk)))
    above = lambda a: let(whole(a), lambda w: F.transform(w, lambda _, c: total(F.slice(w, F.lit(1), c))))
    each = lambda a: let(above(a), lambda w: F.transform(a, lambda _, i: F.get(w, F.floor(i / chunk).cast("int")) + total(F.slice(a, i - i % chunk + 1, i % chunk))))
    return F.when(F.size(lengths) > 0, each(lengths)).otherwise(F.array().cast("array<int>"))


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points: the pieces between matches, and the matches, laid end to end."""

    def placed(pairs: Column) -> Column:
        ends = sums_before(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["value"])))
        begin = lambda x, at: at + F.length(x["gap"])
        return F.zip_with(pairs, ends, lambda x, at: F.struct(F.lit(kind).alias("kind"), begin(x, at).alias("start"), (begin(x, at) + F.length(x["value"])).alias("end"), x["value"].alias("value")))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(values, lambda v: F.zip_with(v, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(v)), lambda a, g: F.struct(g.alias("gap"), a.alias("value"))))
    return let(pairs, lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(no_spans()))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + doubled(i)) % 10


def luhn(digits: Column) -> Column:
    return luhn_sum(digits) == 0


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _mod97(value: Column) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))

    def put(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (acc * 100 + n - 55) % 97).otherwise((acc * 10 + n - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), put)


def check_of(kind: str) -> Callable[[Column], Column]:
    """The format test of a kind."""
    n = lambda v: F.length(digits_of(v))
    return {
        "email": lambda v: F.lit(True),
        "ip": _octets,
        "card": lambda v: n(v).between(16, 19) & luhn(digits_of(v)),
        "phone": lambda v: n(v).between(8, 15),
        "obfuscated_email": lambda v: v.rlike("[A-Za-z]{2,}$"),
        "national_phone": lambda v: v.rlike(r"^\(?[2-9]") & v.rlike(r"[2-9][0-9]{2}[\x20.-][0-9]{4}$"),
        "social_number": lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"),
        "iban": lambda v: _mod97(v) == 1,
        "short_card": lambda v: luhn(digits_of(v)),
    }[kind]


def passes(s: Column, kinds: list[str]) -> Column:
    """The format test of a span of any of these kinds."""
    tests = F.lit(False)
    for kind in reversed(kinds):
        tests = F.when(s["kind"] == kind, check_of(kind)(s["value"])).otherwise(tests)
    return tests


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind; texts without a character that every match needs are not searched."""
    needed = {"email": "@", "phone": "+", "ip": ".", "card": ""}[kind]
    search = (text.contains(needed) if needed else F.lit(True)) & (F.lit(True) if kind == "email" else text.rlike("[0-9]"))
    check = check_of(kind)
    return F.when(search, F.filter(match_spans(text, BASE[kind], kind), lambda s: check(s["value"]))).otherwise(no_spans())


def more_spans(text: Column) -> Column:
    """Candidates of the further kinds."""
    found = F.flatten(F.array(*(match_spans(text, p, k) for k, p in MORE.items())))
    return F.when(text.rlike(r"[0-9]|[(\[]at[)\]]"), found).otherwise(no_spans())


def features(s: Column, text: Column) -> Column:
    """Format and context features of a span of one of the further kinds, as a struct."""
    v, kinds = s["value"], list(MORE)
    before = F.substring(text, F.greatest(F.lit(1), s["start"] - 39), F.least(s["start"], F.lit(40)))
    edge = lambda c: (c == "") | c.rlike(r"[\s.,;:!?()\[\]\"']")
    made = {
        "length": F.length(v), "digits": F.length(digits_of(v)), "letters": F.length(F.regexp_replace(v, "[^A-Za-z]", "")), "separators": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
        "groups": F.size(F.split(v, "[^A-Za-z0-9]+")), "check": passes(s, kinds), "left_edge": edge(F.substring(text, s["start"], F.when(s["start"] > 0, F.lit(1)).otherwise(F.lit(0)))),
        "right_edge": edge(F.substring(text, s["end"] + 1, F.lit(1))), "cue": before.rlike(_BEFORE.format("|".join(CUES))), "other": before.rlike(_BEFORE.format("|".join(OTHER))),
        "kind": F.array_position(F.array(*map(F.lit, kinds)), s["kind"]),
    }
    return F.struct(*(made[k].cast("double").alias(k) for k in FEATURES))


@dataclass
class Model:
    """Boosted trees as nested (feature, threshold, left, right) or leaf values, with weights, and a calibrated threshold for each kind. No trees select nothing."""

    trees: list = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Per kind: precision and recall of the threshold on held-out rows.
    held_out: dict[str, tuple[float, float]] = field(default_factory=dict)

    def probability(self, of: Column) -> Column:
        """of: a struct of features."""

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, at, left, right = node
            return F.when(of[name] <= at, walk(left)).otherwise(walk(right))

        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + F.lit(weight) * walk(root)
        return 1 / (1 + F.exp(-2 * margin))

    def threshold(self, kind: Column) -> Column:
        """The threshold of a kind; more than any score if it has none."""
        out = F.lit(2.0)
        for k, at in self.thresholds.items():
            out = F.when(kind == k, F.lit(at)).otherwise(out)
        return out


def _tree(node) -> object:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _made_value(kind: str, well: Column, draw: Callable[[str, int], Column]) -> Column:
    """A value of a kind, well or badly formed. draw(name, n): n random digits."""
    d = lambda name, n: F.lpad(draw(name, n).cast("string"), n, "0")
    two9 = lambda name: (draw(name, 1) % 8 + 2).cast("string")
    if kind == "obfuscated_email":
        at, dot = F.when(draw("at", 1) < 5, F.lit(" (at) ")).otherwise(F.lit("[at]")), F.when(draw("dot", 1) < 5, F.lit(" (dot) ")).otherwise(F.lit("."))
        return F.concat(F.lit("user"), d("a", 2), at, F.lit("host"), d("b", 1), dot, F.when(well, F.lit("example")).otherwise(d("c", 2)))
    if kind == "national_phone":
        lead = F.when(well, F.concat(two9("a"), d("b", 2))).otherwise(F.concat(F.lit("0"), d("b", 2)))
        sign = F.when(draw("s", 1) < 5, F.lit("-")).otherwise(F.lit("."))
        return F.concat(F.when(draw("p", 1) < 5, F.concat(F.lit("("), lead, F.lit(") "))).otherwise(F.concat(lead, sign)), two9("c"), d("d", 2), sign, d("e", 4))
    if kind == "social_number":
        return F.concat(F.when(well, F.concat(F.lit("1"), d("a", 2))).otherwise(F.concat(F.lit("9"), d("a", 2))), F.lit("-1"), d("b", 1), F.lit("-1"), d("c", 3))
    if kind == "short_card":
        lead = F.concat(F.when(draw("a", 1) < 5, F.lit("34")).otherwise(F.lit("37")), d("b", 6), d("c", 6))
        last = (10 - luhn_sum(F.concat(lead, F.lit("0")))) % 10
        return F.concat(lead, F.when(well, last).otherwise((last + 1 + draw("e", 1) % 9) % 10).cast("string"))
    bare = F.concat(d("a", 8), d("b", 8))
    check = 98 - _mod97(F.concat(F.lit("GB00"), bare))
    check = F.lpad(F.when(well, check).otherwise(check % 97 + 1).cast("string"), 2, "0")
    return F.regexp_replace(F.concat(F.lit("GB"), check, bare), "(.{4})(?=.)", "$1 ")


def training_rows(docs: DataFrame, places: int) -> DataFrame:
    """docs: id, text. Rows (held, kind, label, features) of values set into the texts of documents, `places` for each kind and document."""
    kinds = list(MORE)
    rows = docs.select("id", "text", F.explode(F.sequence(F.lit(1), F.lit(places * len(kinds)))).alias("n")).withColumn("k", (F.col("n") % len(kinds)).cast("int"))
    draw = lambda name, n: F.pmod(F.xxhash64("id", "n", F.lit(name)), F.lit(10**n))
    cue = draw("cue", 3) % 3
    words = lambda ws: F.get(F.array(*map(F.lit, ws)), (draw("word", 6) % len(ws)).cast("int"))
    join = F.get(F.array(F.lit(": "), F.lit(" "), F.lit(" no. "), F.lit(" is "), F.lit(" number ")), (draw("join", 4) % 5).cast("int"))
    said = F.when(cue == 0, F.concat(words(CUES), join)).when(cue == 2, F.concat(words(OTHER), join)).otherwise(F.lit(""))
    well, glued = draw("well", 2) < 60, draw("glued", 2) < 15
    value, chance = F.lit(""), F.lit(0.0)
    for i, kind in enumerate(kinds):
        one = lambda p: F.when(cue == 0, p[0]).when(cue == 1, p[1]).otherwise(p[2])
        value = F.when(F.col("k") == i, _made_value(kind, well, draw)).otherwise(value)
        chance = F.when(F.col("k") == i, F.when(well, one(PRIORS[kind][0])).otherwise(one(PRIORS[kind][1]))).otherwise(chance)
    at = (F.pmod(F.xxhash64("id", "n"), F.length("text") + 1)).cast("int")
    rows = rows.withColumn("value", value).withColumn("said", said).withColumn("glue", F.when(glued, F.get(F.array(F.lit("/"), F.lit("_"), F.lit("="), F.lit("x")), (draw("sign", 2) % 4).cast("int"))).otherwise(F.lit(" ")))
    rows = rows.withColumn("left", F.concat(F.substring("text", F.greatest(F.lit(1), at - 40), F.lit(40)), F.lit(" "), "said", F.when(glued, F.col("glue")).otherwise(F.lit(""))))
    rows = rows.withColumn("whole", F.concat("left", "value", "glue", F.substring("text", at + 1, F.lit(20))))
    span = F.struct(F.get(F.array(*map(F.lit, kinds)), F.col("k")).alias("kind"), F.length("left").alias("start"), (F.length("left") + F.length("value")).alias("end"), F.col("value").alias("value"))
    label = (draw("label", 6) < chance * F.when(glued, GLUED).otherwise(1.0) * 1_000_000).cast("double")
    return rows.select((draw("held", 4) % 5 == 0).alias("held"), F.get(F.array(*map(F.lit, kinds)), F.col("k")).alias("name"), label.alias("label"), features(span, F.col("whole")).alias("f")).select("held", "name", "label", "f.*")


def fit(df: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION) -> Model:
    """Fit and calibrate on rows made from about sample_docs documents with text, chosen by a hash of the id; too few rows give a model that selects nothing."""
    text = text_or_empty(text_col)
    rows = df.where(F.length(text) >= 80).select(F.col(id_col).alias("id"), text.alias("text"))
    n = rows.count()
    if n > sample_docs:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample_docs / n))
    # few small rows, fitted over many times
    found = written(training_rows(rows, PLACES).coalesce(8), "pii-sample")
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found.where(~F.col("held")))
    if train.select("label").distinct().count() < 2:
        discard(found)
        return Model()
    fitted = GBTClassifier(maxIter=12, maxDepth=5, maxBins=16, seed=5, stepSize=0.3, checkpointInterval=-1).fit(train)
    model = Model([(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)])
    score = F.floor(model.probability(F.struct(*FEATURES)) * 100)
    bins: dict[str, dict[int, tuple[float, float]]] = {}
    for r in found.where("held").groupBy("name", score.alias("bin")).agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect():  # 100 rows a kind
        bins.setdefault(r["name"], {})[r["bin"]] = (r["good"], r["bad"])
    for kind, of in bins.items():
        good = bad = 0.0
        total = sum(g for g, _ in of.values())
        for at in sorted(of, reverse=True):
            good, bad = good + of[at][0], bad + of[at][1]
            if good >= precision * (good + bad) and good:
                model.thresholds[kind], model.held_out[kind] = at / 100, (good / (good + bad), good / total)
    discard(found)
    return model


def find_pii(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text, base (array of verified spans by kind, then start) and added (selected further spans, alike); spans in code points.

    A further span is added if the trees give it its kind's threshold or more, it overlaps no base span, and no overlapping candidate has a higher score (ties: the
    earlier, then the first kind). Null and empty texts have no spans; long texts are searched whole; repeated rows are answered each; an empty table gives
    no rows; other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", "text", *(base_spans(F.col("text"), k).alias(k) for k in BASE), more_spans(F.col("text")).alias("more"))
    rows = rows.withColumn("base", F.flatten(F.array(*BASE)))
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    if model.trees:
        free = F.filter("more", lambda s: ~F.exists("base", lambda b: overlaps(s, b)))
        scored = F.transform(free, lambda s: F.struct(s.alias("s"), let(features(s, F.col("text")), model.probability).alias("p")))
        rows = rows.withColumn("scored", F.when(F.size("more") > 0, F.filter(scored, lambda x: x["p"] >= model.threshold(x["s"]["kind"]))))
        beaten = lambda x: F.exists("scored", lambda y: overlaps(x["s"], y["s"]) & ((y["p"] > x["p"]) | ((y["p"] == x["p"]) & (F.struct(y["s"]["start"], y["s"]["kind"]) < F.struct(x["s"]["start"], x["s"]["kind"])))))
        added = F.coalesce(F.transform(F.filter("scored", lambda x: ~beaten(x)), lambda x: x["s"]), no_spans())
    else:
        added = no_spans()
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "base", added.alias("added"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace all spans of find_pii() by <KIND>."""
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col(text_col), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")).alias("out"))

    done = F.aggregate(spans, start, put, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.length(F.col(text_col)))))
    return found.withColumn("redacted", F.when(F.size(spans) > 0, done).otherwise(F.col(text_col)))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit(docs, "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"))
