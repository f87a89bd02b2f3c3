"""Benchmark items in documents, also with other numbers, names or units: typed templates, window join, slot consistency.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import drop_tables, settled

GAP = 3                       # tokens put in or left out between the parts of one copy
BROADCAST_WINDOWS = 200_000  # benchmark windows sent to every task (about 5 MB); more are joined by a shuffle

#: Marks that stand before a slot's value, or alone in a template: number, unit, name; a name at a sentence start until it is a template.
NUMBER, UNIT, NAME, LEAD = "\ue000", "\ue001", "\ue002", "\ue003"
INNER = "\ue004"             # stands for a separator inside a number
UNITS = ("km|cm|mm|kg|mg|ml|ms|km/h|mph|m|g|l|s|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|foot|"
         "inches|inch|meters?|metres?|grams?|pounds?|ounces?|liters?|litres?|dollars?|euros?|cents?|percent|degrees?")
#: The patterns of the SQL twin, which knows no lookbehind: names inside a sentence, one of two neighbours; numbers without separators.
NAME_PATTERN = r"([\p{Ll},;:] )(\p{Lu}\p{Ll}+)"
NUMBER_PATTERN = r"([0-9]+)"
UNIT_PATTERN = rf"({NUMBER}[0-9]+)\s*({UNITS})\b"
BREAK_PATTERN = rf"[^\p{{L}}\p{{N}}{NUMBER}-{NAME}]+"
#: The patterns used here.
INSIDE_NAME = r"(?<=[\p{L}\p{N},;:]\s)(\p{Lu}\p{Ll}+)"
LEADING_NAME = rf"(?<![\p{{L}}\p{{N}}{NAME}])(\p{{Lu}}\p{{Ll}}+)"
WHOLE_NUMBER = rf"([0-9][0-9{INNER}]*)"
UNIT_BEHIND = rf"({NUMBER}[0-9{INNER}]+)\s*({UNITS})\b"
BREAK = rf"[^\p{{L}}\p{{N}}{NUMBER}-{INNER}]+"
SLOT = rf"^[{NUMBER}-{LEAD}]"


def marked(text: Column) -> Column:
    """The text with a mark before each name, number and unit."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUMBER}-{INNER}]", " ")
    text = F.regexp_replace(F.regexp_replace(text, INSIDE_NAME, f"{NAME}$1"), LEADING_NAME, f"{LEAD}$1")
    text = F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", INNER)
    text = F.regexp_replace(text, WHOLE_NUMBER, f" {NUMBER}$1 ")
    return F.lower(F.regexp_replace(text, UNIT_BEHIND, f"$1 {UNIT}$2"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAK), "")


def _plain(raw: Column) -> Column:
    """Words of the canonical text: every slot is its mark alone, a name the same wherever it stands."""
    return F.transform(raw, lambda w: F.when(w.rlike(SLOT), F.translate(w.substr(1, 1), LEAD, NAME)).otherwise(w))


def window_hashes(raw: Column, plain: Column, width: int) -> Column:
    """The 64-bit hash of each run of `width` tokens; null where there are fewer. Names alone are no template: their values are hashed."""
    bare = F.xxhash64(*[F.lit(NAME)] * width)
    runs = F.transform(F.sequence(F.lit(0), F.size(plain) - width), lambda i: F.xxhash64(*[plain[i + k] for k in range(width)]))
    runs = F.transform(runs, lambda h, i: F.when(h == bare, F.xxhash64(*[F.substring(raw[i + k], 2, 1 << 30) for k in range(width)])).otherwise(h))
    return F.when(F.size(plain) >= width, runs)


def _tokens(rows: DataFrame, key: str) -> DataFrame:
    """(key, raw, plain): the tokens with and without the values of their slots."""
    return rows.select(key, words(marked(F.col("text"))).alias("raw")).select(key, "raw", _plain(F.col("raw")).alias("plain"))


def _windows(rows: DataFrame, key: str, width: int, name: str) -> DataFrame:
    """The windows: (at, hash, tokens), the slots with their values."""
    runs = F.transform(window_hashes(F.col("raw"), F.col("plain"), width), lambda h, i: F.struct(
        i.alias("at"), h.alias("hash"), F.slice("raw", i + 1, width).alias("tokens")))
    return _tokens(rows, key).select(key, F.explode(runs).alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """One row for each document and benchmark item in it: doc_id, item_id, n_windows, coverage, n_slots, consistency, kind.

    Texts become templates: numbers (1,200 and 3.5 are one), units behind numbers and capitalised words, also at a sentence
    start and side by side, are typed placeholders, the other words are lower-cased; windows of names alone count only in items that
    have no others, and by their words. A document holds an item if at least `share` of the item's windows of `width`
    tokens stand in it, and its slots are consistent, equal values of the item standing for equal values of the document:
    along one alignment (shifts at most GAP apart) that covers `share` of the item's windows, whatever else the document
    holds; or, for an item in scattered parts, along its shifts one by one for `share` of all aligned windows with slots.
    kind is 'verbatim' if all the values there are the item's own, else 'reparameterised'. n_slots leaves out words at a sentence start that are the item's own. An
    item's first token is left out.

    The windows of all documents are joined with the benchmark's by hash: broadcast up to BROADCAST_WINDOWS, beyond that
    by a shuffle; hits are counted before they are exchanged. Only documents over `share` are read again for the slots.
    Null texts are empty; items of fewer than `width` + 1 tokens have no windows; rows with a null id are not reported;
    rows that share an id count as one; other columns are ignored; empty tables give an empty result.
    """
    own: list[str] = []
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    hashes = window_hashes(F.col("raw"), F.col("plain"), width)
    probe = _tokens(items, "item_id").select("item_id", "plain", F.posexplode(hashes).alias("at", "hash")).where("at > 0")
    probe = probe.withColumn("bare", F.forall(F.slice("plain", F.col("at") + 1, width), lambda w: w == NAME))
    probe = probe.groupBy("item_id", "hash").agg(F.min("bare").alias("bare")).withColumn("all", F.min("bare").over(Window.partitionBy("item_id")))
    probe = settled(probe.where("not bare or all").select("item_id", "hash"), "probe", own)
    sizes = probe.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    side = F.broadcast(probe) if probe.count() <= BROADCAST_WINDOWS else probe
    hits = _tokens(docs, "doc_id").select("doc_id", F.explode(hashes).alias("hash"))
    hits = hits.join(side, "hash").groupBy("doc_id", "item_id", "hash").agg(F.lit(1).alias("one"))
    hits = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("found")).join(sizes, "item_id")
    hits = hits.where(F.col("found") >= F.lit(share) * F.col("n_windows"))
    hits = settled(hits.select("doc_id", "item_id", "n_windows", (F.col("found") / F.col("n_windows")).alias("coverage")), "hits", own)

    mine = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").where(F.col("text").rlike(r"[0-9]|\p{Lu}\p{Ll}"))
    mine = _windows(mine, "doc_id", width, "d")
    theirs = _windows(items, "item_id", width, "i").where("i.at > 0")
    theirs = theirs.withColumn("hash", F.col("i.hash")).join(probe, ["item_id", "hash"], "left_semi")
    met = mine.select("doc_id", "d", F.col("d.hash").alias("hash")).join(hits.select("doc_id", "item_id", "n_windows"), "doc_id")
    met = met.join(theirs, ["item_id", "hash"])
    pairs = F.filter(F.arrays_zip(F.col("i.tokens").alias("a"), F.col("d.tokens").alias("b")), lambda z: z["a"].rlike(SLOT))
    met = met.select("doc_id", "item_id", "n_windows", "hash", (F.col("d.at") - F.col("i.at")).alias("shift"), F.col("i.at").alias("at"),
                     F.explode_outer(pairs).alias("z"))
    met = met.select("doc_id", "item_id", "n_windows", "hash", "shift", "at", F.translate("z.a", LEAD, NAME).alias("a"),
                     F.translate("z.b", LEAD, NAME).alias("b"), F.col("z.a").startswith(LEAD).alias("lead"))
    met = settled(met.distinct(), "met", own)
    filled = F.when(~F.col("lead") | (F.col("a") != F.col("b")), F.col("a"))
    told = [F.count_distinct("a").alias("values"), F.count_distinct("a", "b").alias("maps"), F.count_distinct(filled).alias("slots"),
            F.min(F.col("a") == F.col("b")).alias("same")]
    lines = met.where("a is not null").groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("at").alias("n"), *told)
    slots = lines.groupBy("doc_id", "item_id").agg(
        F.max("slots").alias("n_slots"), (F.sum(F.when(F.col("values") == F.col("maps"), F.col("n")).otherwise(0)) / F.sum("n")).alias("consistency"),
        F.max("same").alias("same"))
    spans = F.array(*[F.struct(F.lit(g).alias("gap"), F.lit(k).alias("back")) for g in range(GAP + 1) for k in range(g + 1)])
    whole = met.withColumn("s", F.explode(spans)).withColumn("first", F.col("shift") - F.col("s.back"))
    whole = whole.groupBy("doc_id", "item_id", "n_windows", "s.gap", "first").agg(F.count_distinct("hash").alias("covered"), *told)
    whole = whole.where((F.col("covered") >= F.lit(share) * F.col("n_windows")) & (F.col("values") == F.col("maps")))
    whole = whole.groupBy("doc_id", "item_id").agg(F.max(F.coalesce("same", F.lit(True))).alias("as_is"))
    slots = slots.join(whole, ["doc_id", "item_id"], "left").withColumn("consistency", F.when(F.col("as_is").isNotNull(), 1.0).otherwise(F.col("consistency")))
    slots = slots.withColumn("same", F.coalesce("as_is", "same")).drop("as_is")
    out = hits.join(slots, ["doc_id", "item_id"], "left")
    out = out.select("doc_id", "item_id", "n_windows", "coverage", F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
                     F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
                     F.when(F.coalesce("same", F.lit(True)), "verbatim").otherwise("reparameterised").alias("kind"))
    out = settled(out.where(F.col("consistency") >= share), "leaks")
    drop_tables(spark, own)
    return out
