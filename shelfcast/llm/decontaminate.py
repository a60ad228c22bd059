"""Benchmark decontamination by templates.

Numbers, names and units of measure become typed placeholders, so a question asked again with other values has the
same template. Windows of ``WINDOW`` template words of the documents are hash-joined with those of the benchmark items,
and an item is found in a document that holds ``SIMILARITY`` of its windows. Where a window has placeholders
the values of both sides are compared: windows with equal values count as they are, the others only if
one occurrence gives one item value one value of its own throughout (the slots are consistent). Windows of fewer than
two plain words are found with equal values only: they count for copies, and are left out where other values are allowed.

A capital in mid-sentence makes a name. Where it opens a sentence, line or quotation, it may be that of a plain word or of a name: windows
that hold such a word are made both ways, and items are judged in two readings, with these words plain and as names.

The benchmark is the stated query set. Its windows are joined in blocks of ``BLOCK_ROWS`` rows, each of a known size and so
broadcast; the documents are scanned in place, and only matches are shuffled, by document and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialise

from .rows import with_rid

WINDOW, SIMILARITY, BLOCK_ROWS = 5, 0.8, 200_000

#: The units that are told apart from plain words, where they follow a number.
UNITS = ("mm cm m km in ft yd mi mg g kg lb oz ml l gal ms s sec min h hr hrs hour hours day days week weeks month months year years "
         "mph kph hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa bar usd eur gbp dollar dollars euro euros cent cents percent "
         "meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms liter liters litre litres second seconds minute minutes")
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
INITIAL = "\x04"  # a word that has a capital perhaps only because of its place
FIRST_PLAIN = "\x05"
PAIRS = "array<struct<i:string,d:string>>"
COPY, PLAIN, NAMED = 0, 1, 2  # readings of the windows


def marked_words(rows: DataFrame, text_col: str = "text", out: str = "w") -> DataFrame:
    """``rows`` with its text replaced by words in lower case, parted by anything that is no letter or digit; a placeholder carries
    its mark in front of the value. Texts without digits, most of them, take a plainer pattern."""
    text = F.col(text_col)
    marks = NUMBER + NAME + UNIT + INITIAL
    clean = F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, " " * len(marks))).otherwise(text)
    capital = F.regexp_replace(clean, r"\p{Lu}(?=\p{Ll})(?<![\p{L}\p{N}]\p{Lu})", INITIAL + "$0")
    named = F.lower(F.regexp_replace(capital, rf"{INITIAL}(?<=[\p{{Ll}}\p{{N}},;:] {INITIAL})", NAME))
    units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
    number = r"([0-9]+(?:[.,][0-9]+)*)(?: ?(?:(%)|(" + units + r"))(?![\p{L}\p{N}]))?"
    counted = F.regexp_replace("named", number, f" {NUMBER}$1 {UNIT}$2$3 ")
    inside = rf"[^\p{{L}}\p{{N}}.,%{marks}]+|[.,]+(?![0-9])|(?<![0-9])[.,]+|[{UNIT}](?=[^\p{{L}}%]|$)"
    words = F.when(F.col("named").rlike("[0-9]"), F.split(counted, inside)).otherwise(F.split("named", rf"[^\p{{L}}\p{{N}}{marks}]+"))
    kept = [F.col(f"`{c}`") for c in rows.columns if c != text_col]
    return rows.select(*kept, named.alias("named")).select(*kept, F.array_remove(words, "").alias(out))


def dense(slots: str, size: int) -> Column:
    return F.coalesce(F.size(slots) > max(0, size - 2), F.lit(False))


def windows_of(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """``h, at, slots, named`` of every window: template hash, place, the placeholders' values (null where there are none), and whether
    words that open a sentence are taken for names, in windows that hold some and so are made both ways. The hash of a dense window,
    one of fewer than two plain words, covers its values too.

    Each step is a column that the next uses more than once, so the planner keeps it out of the per-window expressions.
    """
    code = lambda w: F.when(w < INITIAL, F.substring(w, 1, 1)).when(w < FIRST_PLAIN, F.substring(w, 2, 1 << 20)).otherwise(w)
    template = F.transform("w", lambda w: F.xxhash64(code(w)))
    slotted = F.exists("w", lambda w: w < INITIAL)
    words = marked_words(rows.select(*keep, "text")).select(*keep, "w", template.alias("t"), slotted.alias("slotted"), F.size("w").alias("n"))
    initial = F.array_compact(F.transform("w", lambda w, i: F.when((w >= INITIAL) & (w < FIRST_PLAIN), i)))
    words = words.select("*", initial.alias("initial"))
    name = lambda w: (w >= INITIAL) & (w < FIRST_PLAIN)
    as_names = F.when(F.size("initial") > 0, F.transform("w", lambda w: F.when(name(w), F.translate(w, INITIAL, NAME)).otherwise(w)))
    codes = F.when(F.size("initial") > 0, F.zip_with("w", "t", lambda w, t: F.when(name(w), F.xxhash64(F.lit(NAME))).otherwise(t)))
    starts = F.array_distinct(F.flatten(F.transform("initial", lambda i: F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.least(i, F.col("n") - size)))))
    words = words.select("*", as_names.alias("wn"), codes.alias("tn"), F.when((F.col("n") >= size) & (F.size("initial") > 0), starts).alias("starts"))
    hashed = lambda t, i: F.xxhash64(*[F.get(t, i + k) for k in range(size)])
    values = lambda w, i: F.filter(F.slice(w, i + 1, size), lambda x: x < INITIAL)
    window = lambda h, i, slots, named: F.struct(h.alias("h"), (i + 1).alias("at"), slots.alias("slots"), F.lit(named).alias("named"))
    none = F.lit(None).cast("array<string>")
    plain = F.transform("t", lambda x, i: window(hashed("t", i), i, none, False))
    mixed = F.transform("t", lambda x, i: window(hashed("t", i), i, values("w", i), False))
    both = F.transform("starts", lambda i: window(hashed("tn", i), i, values("wn", i), True))
    made = F.when(F.col("slotted"), mixed).otherwise(plain)
    made = F.when(F.col("starts").isNotNull(), F.concat(made, both)).otherwise(made)
    each = words.select(*keep, "n", F.inline(made)).filter(F.col("at") <= F.col("n") - (size - 1))
    h = F.when(dense("slots", size), F.xxhash64("h", "slots")).otherwise(F.col("h"))
    return each.select(*keep, h.alias("h"), "at", F.when(F.size("slots") > 0, F.col("slots")).alias("slots"), "named")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """The windows of the items. A passage may go on in mid-sentence where a capital counts as a name, so an item's first window is
    also made as if a word stood before it."""
    as_is = windows_of(items, size, "item_id").select("item_id", "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("named").alias("item_named"))
    inside = windows_of(items.withColumn("text", F.concat(F.lit("a "), F.ltrim("text"))), size, "item_id").filter("at = 2 and not named")
    made = as_is.unionByName(inside.select("item_id", "h", F.lit(1).alias("item_at"), F.col("slots").alias("item_slots"), F.col("named").alias("item_named")))
    made = made.groupBy("item_id", "h", "item_at", "item_slots").agg(F.min("item_named").alias("item_named"))
    # a window that is dense with names for all its capitals is left out where they are names
    return made.withColumn("item_loose", ~F.max(dense("item_slots", size)).over(Window.partitionBy("item_id", "item_at")))


def consistent(pairs: Column) -> Column:
    """Whether one item value has one value of the document throughout."""
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"]))) == F.size(pairs)


def judge(hits: DataFrame, total: DataFrame, size: int, similarity: float) -> DataFrame:
    """The rows of ``find_leaks`` from the windows found: ``doc_id, part, at, item_id, item_at, equal, pairs, readings``.

    Each reading is judged on its own: ``COPY`` by windows with equal values, the others by windows that may have other values.
    ``total`` has the windows of each item in each reading.

    A line is what one text holds of an item at one shift (place in the document minus place in the item). An occurrence is made of
    consistent lines whose shifts differ by less than the item is long, the longest first, so that words may be put in or left out and other
    variants or chance matches elsewhere do not count against it. What a document holds in scattered pieces is judged as a whole.
    """
    key = ["doc_id", "item_id", "reading"]
    hits = hits.withColumn("reading", F.explode("readings")).withColumn("pairs", F.when(F.col("reading") == COPY, F.array().cast(PAIRS)).otherwise(F.col("pairs")))
    found = hits.groupBy(*key, "part", (F.col("at") - F.col("item_at")).alias("shift"), "item_at").agg(
        F.max("equal").alias("equal"), F.max_by("pairs", F.size("pairs")).alias("pairs"))
    lines = found.groupBy(*key, "part", "shift").agg(F.collect_list(F.struct("item_at", "equal", "pairs")).alias("found"))  # as long as an item at most
    lines = materialise(lines.withColumns({"n": F.size("found"), "all_pairs": F.array_distinct(F.flatten(F.col("found")["pairs"]))}), "leak-lines")
    single = lines.select(*key, "part", "shift", "n", F.explode("found").alias("f")).select(*key, "part", "shift", "n", "f.*")
    placed = single.groupBy(*key, "item_at").agg(F.max("equal").alias("equal"), F.max_by("pairs", F.struct("n", -F.col("shift"), "part")).alias("pairs"))
    whole = placed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_found"), F.sum(F.col("equal").cast("long")).alias("n_equal"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))  # as long as an item at most
    width = F.col("n_all") + (size - 1)
    near = F.array(2 * F.floor(F.col("shift") / width), 2 * F.floor(F.col("shift") / width + 0.5) + 1)  # each half covered twice
    line = F.struct((-F.col("n")).alias("order"), "shift", F.col("found")["item_at"].alias("places"), F.col("all_pairs").alias("pairs"))
    spread = lines.filter(consistent(F.col("all_pairs"))).join(total, ["item_id", "reading"]).select(*key, "part", F.explode(near).alias("near"), line.alias("line"))
    groups = spread.groupBy(*key, "part", "near").agg(F.sort_array(F.collect_list("line")).alias("lines"))

    def add(held: Column, more: Column) -> Column:
        places, pairs = F.array_union(held["places"], more["places"]), F.array_union(held["pairs"], more["pairs"])
        fits = (F.size(places) > F.size(held["places"])) & consistent(pairs)
        return F.when(fits, F.struct(places.alias("places"), pairs.alias("pairs"))).otherwise(held)

    empty = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast(PAIRS).alias("pairs"))
    best = groups.select(*key, F.size(F.aggregate("lines", empty, add)["places"]).alias("n")).groupBy(*key).agg(F.max("n").alias("n_best"))
    same = [whole[c].eqNullSafe(best[c]) for c in key]
    read = whole.join(best, same[0] & same[1] & same[2], "left").select(*[whole[c] for c in whole.columns], F.coalesce("n_best", F.lit(0)).alias("n_best"))
    read = read.join(total, ["item_id", "reading"])
    held = F.greatest("n_best", "n_equal", F.when(consistent(F.col("pairs")), F.col("n_found")).otherwise(0))
    share = F.when(held >= similarity * F.col("n_read"), held / F.col("n_read"))
    copied = F.col("reading") == COPY
    judged = read.withColumn("share", share).groupBy("doc_id", "item_id").agg(
        F.first("n_all").alias("n_windows"), F.max("n_found").alias("n_found"), F.coalesce(F.max(F.when(copied, F.col("n_equal"))), F.lit(0)).alias("n_equal"),
        F.max(F.when(copied, F.col("share"))).alias("copy"), F.max(F.when(~copied, F.col("share"))).alias("reworked"))
    kind = F.when(F.col("copy").isNotNull(), "copy").when(F.col("reworked").isNotNull(), "reworked")
    return judged.withColumns({"share": F.coalesce("copy", "reworked"), "kind": kind}).filter("kind is not null")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, n_windows, n_found, n_equal, share, kind``: one row for each item that a document holds.

    ``kind`` is ``copy`` where windows with equal values alone reach the similarity, else ``reworked``. Items shorter than the
    window are one window of their own length; null or wordless texts and items match nothing. Rows that share a doc_id, null
    included, are judged together as one document, and repeated items once. A reworked item needs an occurrence with consistent slots.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    items = items.withColumn("text_", F.col("text"))
    items = marked_words(items, "text_").withColumn("size", F.least(F.size("w"), F.lit(window))).filter("size > 0").drop("w")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` of them
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.xxhash64("text"))
    schema = "item_id " + benchmark.schema[item_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"doc_id long, {schema}, n_windows long, n_found long, n_equal long, share double, kind string")
    for size in sizes:
        sought = materialise(item_windows(items.filter(F.col("size") == size), size), "item-windows")
        blocks = -(-sought.count() // BLOCK_ROWS)
        seen = windows_of(rows, size, "doc_id", "part")
        hits = None
        for k in range(max(1, blocks)):
            part = sought if blocks <= 1 else sought.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k)
            found = seen.join(F.broadcast(part), "h")  # about BLOCK_ROWS rows of one window each
            hits = found if hits is None else hits.unionByName(found)
        equal = F.col("slots").eqNullSafe(F.col("item_slots"))
        pairs = F.when(F.col("slots").isNotNull(), F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d"))))
        loose = ~dense("item_slots", size)
        places = {COPY: F.lit(True), PLAIN: loose & ~F.col("item_named"), NAMED: F.col("item_loose")}
        total = sought.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_all"), *[F.count_distinct(F.when(c, F.col("item_at"))).alias(f"n{r}") for r, c in places.items()])
        total = total.select("item_id", "n_all", F.inline(F.array(*[F.struct(F.lit(r).alias("reading"), F.col(f"n{r}").alias("n_read")) for r in places])))
        readings = F.array_compact(F.array(F.when(equal, F.lit(COPY)), F.when(loose & ~F.col("item_named") & ~F.col("named"), F.lit(PLAIN)),
                                           F.when(F.col("item_loose"), F.lit(NAMED))))
        hits = hits.withColumns({"equal": equal, "pairs": F.coalesce(pairs, F.array().cast(PAIRS)), "readings": readings}).filter(F.size("readings") > 0)
        judged = judge(hits, F.broadcast(total) if blocks <= 1 else total, size, similarity)
        out = out.unionByName(judged.select(*out.columns))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without a leak, with the columns of ``docs``, each judged by itself: of rows that share an id, or have none, those without
    a leak stay. The leaking rows are a shuffled anti-join's small side; the planner broadcasts them if they are few."""
    base = with_rid(docs, id_col, text_col, tuple(docs.columns))
    leaks = find_leaks(base.select("rid", "text"), benchmark, "rid", "text").select(F.col("doc_id").alias("rid")).distinct()
    return base.join(materialise(leaks, "leaks"), "rid", "left_anti").select("row.*")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
