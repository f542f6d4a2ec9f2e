"""Benchmark decontamination by template windows; DataFrame functions only.

A text becomes a template: numbers, units behind a number and capitalised names inside a sentence turn into typed
placeholders, everything else is lower-cased words. Benchmark items and documents meet by a hash join on their
windows of WINDOW template tokens; a document that holds CONTAINED of an item's distinct windows is a candidate.
Where the shared windows have slots, their values are checked: the same value in the item must go with the same
value in the document, so a re-parameterised question counts and a chance likeness of templates does not. A window
is paired with its first place in the document; where that pairing fails or finds other values, every place counts:
each offset between item and document is tried as the item's place, and one that holds the item is enough. An item
of fewer template tokens than a window has no slots: its plain words must stand in the document in their order, at least
LEAST_WORDS of them; a shorter item counts only as the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

WINDOW = 5
CONTAINED = 0.8
AGREE = 0.8
LEAST_WORDS = 3
SMALL = 200_000
NUMBER, UNIT, NAME, END = "\x02", "\x04", "\x05", "\x03"
# fixed values: units of measure and money that may follow a number
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|s|ms|min|h|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|cent|percent|miles|mile|feet|foot|inches|inch|meters|meter|metres|metre|degrees|degree|mph|kmh|kw|w|v|a|hz|kb|mb|gb|tb"


def _tagged(text: Column, raw: bool) -> Column:
    """The text with its slots marked; raw: their values stand in the marks.

    Repeated groups are possessive: nothing follows them, so they match the same, and a long run of numbers or names
    costs no stack. A greedy one takes a few calls a repeat, and a stack overflow ends the executor.
    """
    keep = lambda group: f"${group}" if raw else ""
    t = F.regexp_replace(text, r"[0-9]+(?:[.,][0-9]+)*+", f" {NUMBER}{keep(0)}{END} ")
    t = F.regexp_replace(t, rf"({END} +)({UNITS})([^\p{{L}}\p{{N}}]|$)", f"$1{UNIT}{keep(2)}{END} $3")
    t = F.when(text.rlike("[0-9]"), t).otherwise(text)
    return F.regexp_replace(t, rf"([\p{{Ll}},;:{END}] +)(\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)*+)", f"$1{NAME}{keep(2)}{END} ")


def template_tokens(text: Column) -> Column:
    """The template: lower-cased words and one-character placeholders."""
    clean = F.regexp_replace(text, f"[{NUMBER}{END}{UNIT}{NAME}]", " ")
    clean = F.when(text.rlike(f"[{NUMBER}{END}{UNIT}{NAME}]"), clean).otherwise(text)
    return F.filter(F.split(F.lower(_tagged(clean, False)), rf"[^\p{{L}}\p{{N}}{NUMBER}{UNIT}{NAME}]+"), lambda x: x != "")


def raw_tokens(text: Column) -> Column:
    """As template_tokens, with each placeholder's value behind it."""
    clean = F.regexp_replace(text, f"[{NUMBER}{END}{UNIT}{NAME}]", " ")
    return F.regexp_extract_all(_tagged(clean, True), F.lit(rf"[{NUMBER}{UNIT}{NAME}][^{END}]*{END}|[\p{{L}}\p{{N}}]+"), F.lit(0))


def _is_slot(x: Column) -> Column:
    return F.substring(x, 1, 1).isin(NUMBER, UNIT, NAME)


def windows(tokens: Column, width: int = WINDOW) -> Column:
    """A hash of each window of the tokens, in order; fewer tokens than a window make one of them all, none make none."""
    full = F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - (width - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(tokens, i + k) for k in range(1, width)]))
    return F.when(F.size(tokens) >= width, full).when(F.size(tokens) > 0, F.array(F.xxhash64(F.array_join(tokens, " "), F.lit(-1)))).otherwise(F.array().cast("array<bigint>"))


def _slot_pairs(ir: Column, dr: Column, p: Column, q: Column) -> Column:
    """(a, b) of each slot of the item's window at p and what stands there in the document's window at q."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.struct(F.get(ir, (p + k).cast("int")).alias("a"), F.get(dr, (q + k).cast("int")).alias("b")))
    return F.filter(pairs, lambda s: s["a"].isNotNull() & s["b"].isNotNull() & _is_slot(s["a"]))


def _consistency(slots: DataFrame, *by: str) -> DataFrame:
    """The share of the item's values that go with one value, and whether any goes with another than itself."""
    by_value = slots.groupBy(*by, "a").agg(F.count("*").alias("values"), F.max((F.col("a") != F.col("b")).cast("int")).alias("other"))
    return by_value.groupBy(*by).agg(F.avg((F.col("values") == 1).cast("double")).alias("consistent"), (F.max("other") > 0).alias("reparameterised"))


def _aligned(pair: DataFrame, sizes: DataFrame, contained: float, agree: float) -> DataFrame:
    """(doc_id, item_id, verbatim): pairs of which some place in the document holds the item with consistent slots.

    Each offset at which a window of both meets is a place; a window counts there by its nearest occurrence, not
    further off than the item is long, so that added or missing words do not end it. Offsets meet in bands of the
    item's length, which keeps the work in proportion to the places found.
    """
    key = ["doc_id", "item_id", "t"]
    own = pair.select(*key, F.posexplode("iw").alias("p", "h"))
    there = pair.select(*key, F.posexplode("dw").alias("q", "h"))
    met = own.join(there, [*key, "h"]).join(sizes, "item_id").withColumn("off", F.col("q") - F.col("p"))
    met = materialize(met.withColumn("band", F.floor(F.col("off") / F.col("n_windows"))), "meetings")
    places = met.select(*key, "band", F.col("off").alias("place")).distinct()
    around = met.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    far = F.abs(F.col("off") - F.col("place"))
    best = around.join(places, [*key, "band"]).where(far <= F.col("n_windows")).groupBy(*key, "place", "n_windows", "p", "h").agg(F.min_by("q", F.struct(far, "off")).alias("q"))
    enough = best.groupBy(*key, "place", "n_windows").agg(F.collect_set("h").alias("hs"), F.collect_list(F.struct("p", "q")).alias("at")).where(F.size("hs") >= contained * F.col("n_windows"))
    slots = enough.select(*key, "place", "at").join(pair.select(*key, "ir", "dr"), key)
    slots = slots.select(*key, "place", F.explode(F.array_distinct(F.flatten(F.transform("at", lambda x: _slot_pairs(F.col("ir"), F.col("dr"), x["p"], x["q"]))))).alias("s")).select(*key, "place", "s.a", "s.b")
    held = _consistency(slots, *key, "place").where(F.col("consistent") >= agree)
    return held.groupBy("doc_id", "item_id").agg(F.max(~F.col("reparameterised")).alias("verbatim"))


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _run_of(n: int):
    return lambda x, i: F.concat_ws(" ", F.slice(F.col("w"), i + 1, n))


def _short(rows: DataFrame, short: DataFrame) -> DataFrame:
    """(doc_id, item_id) of items (item_id, item_text) too short for a window; `short` has few, their widths are at most WINDOW and what slots hold."""
    items = short.select("item_id", plain_words(F.col("item_text")).alias("w")).select("item_id", F.size("w").alias("width"), F.array_join("w", " ").alias("words"))
    widths = [r["width"] for r in items.where(F.col("width") >= LEAST_WORDS).select("width").distinct().collect()]
    words = rows.select("doc_id", plain_words(F.col("text")).alias("w"))
    runs = F.array(F.array_join("w", " "))
    for n in sorted(widths):
        runs = F.concat(runs, F.transform(F.slice("w", 1, F.greatest(F.size("w") - (n - 1), F.lit(0))), _run_of(n)))
    return words.select("doc_id", F.explode_outer(F.array_distinct(runs)).alias("words")).join(small_side(items.where("width > 0")), "words").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", contained: float = CONTAINED, agree: float = AGREE) -> DataFrame:
    """(doc_id, item_id, hits, n_windows, reparameterised): a row for each document that holds a benchmark item.

    Null or empty texts hold nothing and are held by nothing; rows with a null id are left out (they can't be
    named); repeated rows give one result. Other columns are ignored, whatever their names. The benchmark is
    broadcast when its windows number SMALL at most, and joined by shuffle beyond that.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    items = items.withColumn("it", template_tokens(F.col("item_text")))
    short = materialize(items.where(F.size("it") < WINDOW).select("item_id", "item_text"), "short")
    items = items.where(F.size("it") >= WINDOW)
    wins = items.select("item_id", F.explode_outer(F.array_distinct(windows(F.col("it")))).alias("h")).where("h is not null").distinct()
    sizes = wins.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    few = wins.count() <= SMALL
    near = (lambda d: F.broadcast(d)) if few else (lambda d: d)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    tokens = rows.select("doc_id", template_tokens(F.col("text")).alias("tokens"))
    # explode_outer: for a plain explode the optimizer would test the array for emptiness first, below, and there it
    # would put the tokens' expression into the lambda and tokenise once for each window
    held = tokens.select("doc_id", F.explode_outer(F.array_distinct(windows(F.col("tokens")))).alias("h"))
    hits = held.join(near(wins), "h").groupBy("doc_id", "item_id").agg(F.size(F.collect_set("h")).cast("long").alias("hits"))
    found = materialize(hits.join(near(sizes), "item_id").where(F.col("hits") >= contained * F.col("n_windows")), "found")

    # slots: only candidates whose item has one
    slotted = items.where(F.exists("it", _is_slot)).select("item_id", "item_text")
    with_slots = found.join(near(slotted), "item_id").select("doc_id", "item_id", "item_text")
    texts = rows.join(small_side(with_slots.select("doc_id").distinct()), "doc_id", "left_semi").distinct()
    plain = lambda c: F.transform(c, lambda x: F.when(_is_slot(x), F.substring(x, 1, 1)).otherwise(F.lower(x)))
    pair = with_slots.join(texts, "doc_id").select("doc_id", "item_id", F.xxhash64("item_text", "text").alias("t"), raw_tokens(F.col("item_text")).alias("ir"), raw_tokens(F.col("text")).alias("dr"))
    # written, because pushed-down filters would put the tokens' expressions into the windows' lambdas
    pair = materialize(pair.withColumns({"ip": plain(F.col("ir")), "dp": plain(F.col("dr"))}), "slots")
    pair = pair.withColumns({"iw": windows(F.col("ip")), "dw": windows(F.col("dp"))})
    each = pair.select("doc_id", "item_id", "ir", "dr", "dw", F.posexplode_outer("iw").alias("p", "h")).withColumn("q", F.array_position("dw", F.col("h")) - 1).where("q >= 0")
    slots = each.select("doc_id", "item_id", F.explode_outer(_slot_pairs(F.col("ir"), F.col("dr"), F.col("p"), F.col("q"))).alias("s"))
    slots = slots.where(F.col("s").isNotNull()).select("doc_id", "item_id", "s.a", "s.b").distinct()
    checked = materialize(_consistency(slots, "doc_id", "item_id"), "checked")
    unsure = checked.where((F.col("consistent") < agree) | F.col("reparameterised")).select("doc_id", "item_id")
    places = _aligned(materialize(pair.join(unsure, ["doc_id", "item_id"], "left_semi"), "unsure"), near(sizes), contained, agree)
    out = found.join(checked, ["doc_id", "item_id"], "left").join(places, ["doc_id", "item_id"], "left").where((F.coalesce("consistent", F.lit(1.0)) >= agree) | F.col("verbatim").isNotNull())
    out = out.select("doc_id", "item_id", "hits", "n_windows", F.coalesce(~F.col("verbatim"), "reparameterised", F.lit(False)).alias("reparameterised"))
    if not short.limit(1).count():
        return out
    return out.unionByName(_short(rows, short).select("doc_id", "item_id", F.lit(1).cast("long").alias("hits"), F.lit(1).cast("long").alias("n_windows"), F.lit(False).alias("reparameterised")))
