"""Personal data: generators propose overlapping spans, boosted trees and calibrated thresholds select.

Base spans come from the strict patterns of each kind and always stay. Loose generators propose more: addresses with a
written-out or bracketed "at" and "dot", digit groups with any separators, dotted quads with spaces or brackets, numbers
without a country code. Each candidate gets format and context features, and gradient-boosted trees (Spark ML) score it.

What the strict rules find has forms that they do not know. So the trees learn from variants of it, a training aid: each base span of all
documents, and of some made-up ones, is put back into its context in disguise (spaces, brackets, "at", "dot", other separators,
no plus) as a right answer, and spoilt in the same disguise (a wrong check digit, a part beyond 255, too few digits, a date, a version, a sentence with
"at") as a wrong one. What the generators find elsewhere in the documents and no rule confirms is a wrong answer too.
Nothing is drawn: equal rows are counted, and the trees are fitted on the distinct ones with their counts as weights. A fifth of the documents is
kept out and sets a threshold for each kind: the least score from which ``PRECISION`` of the answers are right. A kind that never gets there adds
nothing. Candidates from it on that overlap no base span and no better candidate are added.

Everything else happens inside a row: positions come from the lengths of the pieces between matches, the
trees become a CASE expression, and no text is shuffled. The patterns are possessive, and one that
starts with a run of letters or digits only starts at a run's begin (or where the last match ended), so no text costs
more than a linear scan.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialise

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, PRECISION, NEVER = 16, 4, 0.98, 2.0
BLOCK = 64
FIT_ROWS = 20_000  # distinct training rows in a task
BINS = 256  # cut points of a feature, more for many rows, so that Spark looks at all of them for the cuts
SPANS = "array<struct<kind:int,start:bigint,end:bigint,hit:string>>"
SCORED = "array<struct<kind:int,start:bigint,end:bigint,hit:string,p:double>>"

#: The strict patterns of the contract, written without backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "[0-9]", "phone": "+"}

_AT = r"(?: ?@ ?| ?[\[({<] ?(?:at|@) ?[\])}>] ?| at )"
_DOT = r"(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot | ?\. ?)"
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9.])[0-9]{1,3}+(?:(?:" + _DOT + r"| ?, ?)[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ ._/-]{1,3}[0-9]{4}){2}[ ._/-]{1,3}[0-9]{1,7}|[0-9]{13,19}+)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\(?[0-9]{1,4}\)?[ ./-]{1,2}){1,4}[0-9]{3,5}(?![0-9A-Za-z])",
}
MAY_HOLD = r"(?i)[0-9]|@| at |[\[({<] ?at ?[\])}>]"
CONTEXT = r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|card|visa|account|ip|host|address|server)\W{0,3}$"
OTHER = r"(?i)(?:version|ver|v|date|page|chapter|section|no|nr)\W{0,3}$"
FEATURES = ("kind", "chars", "digits", "groups", "first", "last", "seps", "spaces", "letters", "brackets", "plus", "at", "dots", "check", "largest", "context", "other", "glued")

def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once; written out in a lambda it would be computed anew for every item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(items: Column, body) -> Column:
    """``body(number, part)`` over slices of ``BLOCK`` items, end to end; ``items`` is not empty."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / F.lit(BLOCK)).cast("int") - 1),
                                 lambda b: bind(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), lambda part: body(b, part))))


def running(steps: Column) -> Column:
    """Running totals of an array of bigints, itself included: the totals of blocks first, then inside each, so no long array grows item by item."""
    def add(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def of(s: Column) -> Column:
        sums = pieces(s, lambda b, part: F.array(F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x)))
        before = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), add)
        return bind(before, lambda start: pieces(s, lambda b, part: bind(F.aggregate(part, F.array(F.get(start, b)), add), lambda t: F.slice(t, F.lit(2), F.size(part)))))

    return bind(steps, of)


def found(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches, leftmost and not overlapping, in code points."""
    def spans(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        steps = F.zip_with(hits, gaps, lambda h, g: (F.char_length(h) + F.char_length(g)).cast("bigint"))
        return F.zip_with(hits, running(steps), lambda h, e: F.struct(F.lit(kind).alias("kind"), (e - F.char_length(h)).alias("start"), e.alias("end"), h.alias("hit")))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(F.array().cast(SPANS)))


def luhn(digits: Column) -> Column:
    return check_sum(digits) == 0


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def holds(span: Column) -> Column:
    """Whether a strict match passes its kind's check."""
    hit, digits = span["hit"], digits_of(span["hit"])
    n = F.char_length(digits)
    parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), p), F.lit("9999")), F.lit(0)) <= 255))
    return (F.when(span["kind"] == 0, True).when(span["kind"] == 1, small)
            .when(span["kind"] == 2, n.between(13, 19) & luhn(digits)).otherwise(n.between(9, 15)))


def base_spans(text: Column) -> Column:
    """The strict spans, by kind and start."""
    empty = F.array().cast(SPANS)
    each = []
    for k, kind in enumerate(KINDS):
        need = text.rlike(NEEDS[kind]) if kind == "card" else F.contains(text, F.lit(NEEDS[kind]))
        need = need & text.rlike("[0-9]") if kind in ("ip", "phone") else need
        each.append(F.when(need, F.filter(found(text, BASE[kind], k), holds)).otherwise(empty))
    return F.concat(*each)


def check_sum(digits: Column) -> Column:
    """The Luhn sum modulo ten: a format feature, of which the trees have to find out what it says."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                       .otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def candidates(text: Column, base: Column) -> Column:
    """Loose spans as structs of kind, start, end, hit, features, and whether they overlap a base span."""
    empty = F.array().cast(SPANS)
    loose = F.when(text.rlike(MAY_HOLD), F.concat(*[found(text, LOOSE[kind], k) for k, kind in enumerate(KINDS)])).otherwise(empty)

    def described(s: Column, near: Column) -> Column:
        hit, digits = s["hit"], digits_of(s["hit"])
        groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
        before = F.substring(text, F.greatest(s["start"] - 15, F.lit(1)).cast("int"), F.least(s["start"], F.lit(16)).cast("int"))
        after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))
        number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        many = lambda pattern: F.char_length(hit) - F.char_length(F.regexp_replace(hit, pattern, ""))
        values = {
            "kind": number(s["kind"]), "chars": number(F.char_length(hit)), "digits": number(F.char_length(digits)), "groups": number(F.size(groups)),
            "first": number(F.char_length(F.get(groups, F.lit(0)))), "last": number(F.char_length(F.get(groups, F.size(groups) - 1))),
            "seps": number(F.char_length(F.regexp_replace(hit, "[0-9A-Za-z]", ""))), "spaces": number(many(" ")), "letters": number(many("[A-Za-z]")),
            "brackets": number(many(r"[\[({<]")), "plus": number(before.rlike(r"\+$") | before.rlike(r"\+[0-9]{1,3} ?$")),
            "at": number(F.contains(hit, F.lit("@"))), "dots": number(many(r"(?i)\bdot\b|\.")), "check": number(check_sum(digits)),
            "largest": number(F.array_max(F.transform(groups, lambda g: F.when(F.char_length(g) <= 4, g.cast("double")).otherwise(9999.0)))),
            "context": number(before.rlike(CONTEXT)), "other": number(before.rlike(OTHER)), "glued": number(before.rlike("[0-9A-Za-z]$") | after.rlike("[0-9A-Za-z]")),
        }
        within = F.exists(near, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), hit.alias("hit"),
                        F.struct(*[values[f].alias(f) for f in FEATURES]).alias("f"), within.alias("within"))

    def block(_: Column, part: Column) -> Column:
        """Candidates stand by kind and start, so few base spans lie between a block's first start and last end."""
        reach = F.struct(F.array_min(F.transform(part, lambda s: s["start"])).alias("a"), F.array_max(F.transform(part, lambda s: s["end"])).alias("b"))
        near = bind(reach, lambda r: F.filter(base, lambda b: (b["start"] < r["b"]) & (b["end"] > r["a"])))
        return bind(near, lambda n: F.transform(part, lambda s: described(s, n)))

    return bind(loose, lambda spans: F.when(F.size(spans) > 0, pieces(spans, block)))


def variants(kind: Column, hit: Column) -> Column:
    """Disguises of a base span as an array of ``v`` and ``good``: 1 for what still says the same, 0 for what is spoilt."""
    user, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    dots = lambda x, by: F.replace(x, F.lit("."), F.lit(by))
    digits = digits_of(hit)
    last = F.right(digits, F.lit(1)).cast("int")
    wrong = F.concat(F.left(digits, F.char_length(digits) - 1), ((last + 1) % 10).cast("string"))
    four = lambda d, by: F.regexp_replace(d, r"([0-9]{4})(?=[0-9])", F.lit(f"$1{by}"))
    part = lambda i: F.substring_index(F.substring_index(hit, ".", i), ".", -1)
    beyond = F.concat(part(1), F.lit("."), part(2), F.lit("."), (F.coalesce(F.try_to_number(part(3), F.lit("999")), F.lit(0)).cast("int") % 100 + 256).cast("string"), F.lit("."), part(4))
    area, rest = F.substring(digits, -10, 3), F.right(digits, F.lit(7))
    a, b = F.left(rest, F.lit(3)), F.right(rest, F.lit(4))
    say = {
        0: ([F.concat(user, F.lit(at), dots(host, dot)) for at, dot in ((" [at] ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" @ ", " . "), ("[at]", "[dot]"), (" at ", "."))],
            [F.concat(F.lit("look at "), part(1), F.lit(". Then")), F.concat(F.lit("was at home. "), host), F.concat(F.lit("the end at last . And"), F.lit(""))]),
        1: ([dots(hit, by) for by in (" . ", "[.]", " dot ", "(.)", ". ")], [dots(beyond, by) for by in (" . ", "[.]", " dot ", "(.)", ". ")]),
        2: ([four(digits, by) for by in (".", "/", "_", "  ", " - ")], [four(wrong, by) for by in (".", "/", "_", "  ", " - ", "")]),
        3: ([F.concat(F.lit("("), area, F.lit(") "), a, F.lit("-"), b), F.concat(area, F.lit("."), a, F.lit("."), b), F.concat(F.lit("1-"), area, F.lit("-"), a, F.lit("-"), b),
             F.concat(F.lit("001 "), area, F.lit(" "), a, F.lit(" "), b)],
            [F.concat(F.lit("20"), F.left(a, F.lit(2)), F.lit("-05-1"), F.left(b, F.lit(1)), F.lit("0")), F.concat(a, F.lit("-"), b), F.concat(F.left(a, F.lit(2)), F.lit(" 000 000")),
             F.concat(F.left(a, F.lit(1)), F.lit("/"), F.left(b, F.lit(1)), F.lit("/"), F.lit("2019")), F.concat(a, F.lit("."), area)]),
    }
    out = F.lit(None).cast("array<struct<v:string,good:double>>")
    for k, (good, bad) in say.items():
        made = F.array(*[F.struct(v.alias("v"), F.lit(g).alias("good")) for vs, g in ((good, 1.0), (bad, 0.0)) for v in vs])
        out = F.when(kind == k, made).otherwise(out)
    return out


def made_up(spark) -> DataFrame:
    """Spans of all kinds with little context, for tables that hold few: 50 of each, by rule."""
    i = F.col("id")
    rows = spark.range(0, 50, 1, 1)
    card = F.concat(F.lpad((i * 7919 + 4000).cast("string"), 7, "4"), F.lpad((i * 104729 + 17).cast("string"), 8, "0"))
    check = (10 - check_sum(F.concat(card, F.lit("0")))) % 10
    hit = F.array(F.concat(F.lit("a.b"), i, F.lit("@mail"), i % 7, F.lit(".example.org")), F.concat_ws(".", i * 37 % 256, i * 91 % 256, i * 13 % 256, i * 57 % 255 + 1),
                  F.concat(card, check), F.concat(F.lit("+1 ("), F.lpad((i * 17 + 201).cast("string"), 3, "0"), F.lit(") 555-"), F.lpad((i * 191).cast("string"), 4, "0")))
    words = F.element_at(F.array(*[F.lit(w) for w in ("here ", "so then ", "contact: ", "call ", "see ")]), (i % 5 + 1).cast("int"))
    return rows.select((i % 5).cast("int").alias("part"), F.posexplode(hit).alias("kind", "hit"), words.alias("before"), F.lit(" and").alias("after"))


def seen(rows: DataFrame) -> DataFrame:
    """Per document of ``doc_id`` and ``text`` that may hold a span: its ``part``, the base spans in their contexts, and the features of the other candidates."""
    text = F.col("text")
    before = lambda s: F.substring(text, F.greatest(s["start"] - 15, F.lit(1)).cast("int"), F.least(s["start"], F.lit(16)).cast("int"))
    after = lambda s: F.substring(text, (s["end"] + 1).cast("int"), F.lit(16))
    known = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["hit"].alias("hit"), before(s).alias("before"), after(s).alias("after")))
    found = rows.filter(text.rlike(MAY_HOLD)).withColumn("base", base_spans(text)).withColumn("loose", candidates(text, F.col("base")))
    return found.select(F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("part"), known.alias("known"),
                        F.transform(F.filter("loose", lambda c: ~c["within"]), lambda c: c["f"]).alias("natural"))


def training_rows(documents: DataFrame) -> DataFrame:
    """``part``, the features, ``label`` and ``weight``, the number of equal rows, from what is ``seen`` in documents."""
    known = documents.select("part", F.inline("known"))
    seeds = known.unionByName(made_up(documents.sparkSession)).where(F.char_length("hit") < 100)
    planted = seeds.select("part", "kind", "before", "after", F.inline(variants(F.col("kind"), F.col("hit"))))
    start = F.char_length("before")
    planted = planted.select("part", "kind", "good", start.alias("a"), (start + F.char_length("v")).alias("b"), F.concat("before", "v", "after").alias("text"))
    planted = planted.withColumn("base", base_spans(F.col("text"))).select("part", "kind", "good", "a", "b", F.explode(candidates(F.col("text"), F.col("base"))).alias("c"))
    shared = F.least(F.col("c.end"), F.col("b")) - F.greatest(F.col("c.start"), F.col("a"))
    whole = F.greatest(F.col("c.end"), F.col("b")) - F.least(F.col("c.start"), F.col("a"))
    same = (shared > 0.8 * whole) & (F.col("c.kind") == F.col("kind"))
    right = F.when(same, F.col("good")).when((F.col("good") == 0.0) & (shared > 0), 0.0)
    planted = planted.where(~F.col("c.within")).select("part", "c.f", right.alias("label")).where("label is not null")
    natural = documents.select("part", F.explode("natural").alias("f")).withColumn("label", F.lit(0.0))
    return planted.unionByName(natural).groupBy("part", *[F.col(f"f.{n}").alias(n) for n in FEATURES], "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))


class SpanModel:
    """Boosted trees as one expression over the features, and the score of each kind from which a candidate counts."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, f: Column) -> Column:
        def walk(node) -> Column:
            if node.numDescendants() == 0:
                return F.lit(float(node.prediction()))
            split = node.split()
            return F.when(f[FEATURES[split.featureIndex()]] <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(float(weight)) * walk(tree)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    def threshold(self, kind: Column) -> Column:
        return F.get(F.array(*[F.lit(t) for t in self.thresholds]), kind)


def unbeaten(spans: Column) -> Column:
    """The scored spans that overlap no better one: of a higher score, else longer, else of an earlier kind."""
    def block(_: Column, part: Column) -> Column:
        reach = F.struct(F.array_min(F.transform(part, lambda s: s["start"])).alias("a"), F.array_max(F.transform(part, lambda s: s["end"])).alias("b"))
        near = bind(reach, lambda r: F.filter(spans, lambda o: (o["start"] < r["b"]) & (o["end"] > r["a"])))
        rank = lambda s: F.struct(s["p"], s["end"] - s["start"], -s["kind"])
        beats = lambda o, s: (o["start"] < s["end"]) & (o["end"] > s["start"]) & (rank(o) > rank(s))
        return bind(near, lambda n: F.filter(part, lambda s: ~F.exists(n, lambda o: beats(o, s))))

    return F.when(F.size(spans) > 0, pieces(spans, block)).otherwise(spans)


def fit_spans(rows: DataFrame) -> SpanModel | None:
    """Trees from all ``training_rows``; None without both labels. A fifth of the documents sets the thresholds and is not trained on."""
    rows = materialise(rows, "span-rows")
    n = rows.count()
    # dealt by content and in one order: the trees do not depend on how the table was cut
    whole = [*FEATURES, "label", "part"]
    rows = materialise(rows.repartition(max(1, -(-n // FIT_ROWS)), *whole).sortWithinPartitions(*whole), "span-fit")
    if {r["label"] for r in rows.filter("part < 4").select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = vectors.transform(rows.filter("part < 4"))
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=max(BINS, math.isqrt(n) + 1), stepSize=0.3, seed=3, labelCol="label", featuresCol="features",
                        weightCol="weight").fit(train.select("features", "label", "weight"))
    model = SpanModel([(w, t._java_obj.rootNode()) for w, t in zip(gbt.treeWeights, gbt.trees)], [NEVER] * len(KINDS))
    p = F.round(model.probability(F.struct(*[F.col(c) for c in FEATURES])), 2)
    scored = rows.filter("part = 4").groupBy("kind", p.alias("p")).agg(F.sum(F.col("label") * F.col("weight")).alias("yes"), F.sum("weight").alias("n")).orderBy("kind", F.desc("p")).collect()
    for k in range(len(KINDS)):  # at most 101 rows of a kind
        yes = n = 0
        for r in (r for r in scored if r["kind"] == k):
            yes, n = yes + r["yes"], n + r["n"]
            if yes / n >= PRECISION and r["p"] >= 0.5:
                model.thresholds[k] = r["p"]
    return model


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def fit_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel | None:
    """A model from all documents; None for an empty table. Texts are read once; what is kept of them is spans, contexts and features."""
    if docs.isEmpty():
        return None
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return fit_spans(training_rows(materialise(seen(rows), "span-documents")))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """Per row ``doc_id``, the base and all spans as arrays, their counts, digest and joined form.

    Null texts are empty and have no spans. Rows are judged one by one over their whole texts, so repeated rows and null ids do no harm; an
    empty table gives no rows; other columns are left out, whatever their names. Without a ``model`` one is fitted on ``docs``; it does not
    touch the base spans.
    """
    model = model or fit_personal(docs, id_col, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    spans = F.col("base")
    if model is not None:
        rows = rows.withColumn("loose", candidates(F.col("text"), F.col("base")))
        scored = F.transform(F.filter("loose", lambda c: ~c["within"]), lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["hit"].alias("hit"), F.round(model.probability(c["f"]), 2).alias("p")))
        good = F.filter(scored, lambda c: c["p"] >= model.threshold(c["kind"]))
        rows = rows.withColumn("good", F.coalesce(good, F.array().cast(SCORED)))
        more = bind(unbeaten(F.col("good")), lambda m: F.transform(m, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["hit"].alias("hit"))))
        spans = F.array_sort(F.array_distinct(F.concat("base", more.cast(SPANS))))
    rows = rows.withColumn("all_spans", spans)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                       F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"), "all_spans")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_personal(docs).drop("all_spans")
