"""Benchmark decontamination by template windows and slot consistency.

A text becomes a template: numbers, units after a number, and names (any
capitalised word) turn into typed placeholders, other words are lower-cased.
What stands before a word does not decide whether it is a name, so an item
reads the same behind a label, in quotes and at the start of a sentence.
Windows of ``width`` template words are hash-joined with those of the benchmark
items, in two readings: ``names``, as above, and ``plain``, the lower-cased
words and numbers as they are.  A ``names`` window is evidence only if it holds
a word that is no placeholder, and at least ``LITERALS`` words and units.

A document holds an item if at least ``similarity`` of the item's windows are in
it, in either reading.  Where the plain windows alone do not reach that, the raw
values of the placeholders, the slots, are compared: along one alignment every
value of the item must stand for one value of the document, and windows that
contradict the value most often seen do not count.  At the start of a sentence a
capitalised word may be an ordinary one ('What', 'The'): words that more texts
hold in lower case than capitalised inside a sentence may not stand for others.
So verbatim and re-parameterised questions are both found.  DataFrame functions
only.

How it runs: tokens are hashed once and five numbers make a window.  Any
``n - ceil(similarity * n) + 1`` windows of an item meet a document that holds
it, so the first pass over all documents looks only for those of an item's
windows that the fewest items share; all windows are compared for the documents
found by it, and slots are read only at windows that matched.

Defined results: null or empty texts have no windows and match nothing; a text
of fewer words than ``width`` is one window of all its words, and such an item
is also looked for, literally, among the windows of its length of every
document; rows without an id are not matched; texts that share a document id
are judged one by one and the best match is reported; items that share an id
count separately; repeated rows count once; a text may be of any length (its
windows leave as rows); empty tables give an empty table; columns other than id
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import BROADCAST_MAX_BYTES, spill_table

WIDTH = 5
SIMILARITY = 0.8
LITERALS = 2

TOKEN = r"\p{L}+|[0-9]+(?:[.,][0-9]+)*|[.!?\n]"
PLAIN, NAMES = "plain", "names"  # readings of a text
MARKS = (".", "!", "?", "\n")
NUMBER, UNIT, NAME = "#number", "#unit", "#name"
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
         "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mg", "g", "kg", "t", "oz", "lb", "lbs", "gram", "grams",
         "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
         "gallon", "gallons", "s", "sec", "min", "h", "hr", "hrs", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
         "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
         "mph", "kmh", "degree", "degrees")




# Tokens are letter runs, numbers or marks, and only letters sort from 'A' on (by
# bytes), so one comparison tells which a token is.

def _is_number(token: Column) -> Column:
    return token.between("0", ":")


def _is_unit(tokens: str, token: Column, at: Column) -> Column:
    return F.coalesce(_is_number(F.get(tokens, at - 1)), F.lit(False)) & F.lower(token).isin(*UNITS)


def _named(tokens: str, token: Column, at: Column, literal) -> Column:
    """The template word of a token; ``literal`` makes the others."""
    low = F.lower(token)
    return (F.when(token >= "A", F.when(low != token, literal(F.lit(NAME))).when(_is_unit(tokens, token, at), literal(F.lit(UNIT))).otherwise(literal(low)))
            .when(_is_number(token), literal(F.lit(NUMBER))))


def tokenized(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), 0).alias("_tokens"))


def template_words(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``(*keys, words)``: array of (w, the template word; r, the token; first,
    whether it begins a sentence)."""
    word = F.transform("_tokens", lambda t, at: F.struct(
        _named("_tokens", t, at, lambda c: c).alias("w"), t.alias("r"),
        F.coalesce(F.get("_tokens", at - 1).isin(*MARKS), F.lit(True)).alias("first")))
    return tokenized(rows, text, *keys).select(*keys, F.filter(word, lambda s: s["w"].isNotNull()).alias("words"))


def token_hashes(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``(*keys, _plain, _names)``: a hash per word in both readings."""
    plain = F.transform("_tokens", lambda t: F.when((t >= "A") | _is_number(t), F.xxhash64(F.lower(t))))
    names = F.transform("_tokens", lambda t, at: _named("_tokens", t, at, F.xxhash64))
    return tokenized(rows, text, *keys).select(*keys, F.array_compact(plain).alias("_plain"), F.array_compact(names).alias("_names"))


def _window_hashes(words: str, width: int) -> Column:
    """Hashes of all windows; a text of fewer words is one window (words that
    are not there do not change a hash)."""
    none = F.array().cast("array<int>")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))).otherwise(none)
    return F.transform(starts, lambda at: F.xxhash64(*[F.get(words, at + i) for i in range(width)]))


def _readings(width: int, short: list[int]) -> list[tuple[str, Column]]:
    """(reading, hashes of its windows): plain ones of all lengths, and names;
    in few words a name is no evidence."""
    names = F.when(F.size("_names") >= width, _window_hashes("_names", width)).otherwise(F.array().cast("array<bigint>"))
    return [(PLAIN, _window_hashes("_plain", k)) for k in (width, *short)] + [(NAMES, names)]


def document_hashes(rows: DataFrame, text: str, width: int, short: list[int], *keys: str) -> DataFrame:
    """``(*keys, hash)``: the windows of a row in both readings, and the plain
    ones of the ``short`` lengths."""
    return token_hashes(rows, text, *keys).select(*keys, F.explode(F.concat(*[h for _, h in _readings(width, short)])).alias("hash"))


def document_windows(rows: DataFrame, text: str, width: int, short: list[int], *keys: str) -> DataFrame:
    """``(*keys, reading, pos, hash)`` of the same windows."""
    hashed = token_hashes(rows, text, *keys)
    out = None
    for reading, hashes in _readings(width, short):
        part = hashed.select(*keys, F.lit(reading).alias("reading"), F.posexplode(hashes).alias("pos", "hash"))
        out = part if out is None else out.unionByName(part)
    return out


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """``(item, variant, reading, ipos, hash)``: the windows that are evidence."""
    plain = document_windows(items, "text", width, [], "item", "variant")
    words = template_words(items, "text", "item", "variant")
    starts = words.select("item", "variant", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("pos"))
    told = F.filter(F.slice("words", F.col("pos") + 1, width), lambda s: ~s["w"].isin(NUMBER, NAME))
    names = starts.where((F.size(told) >= LITERALS) & F.exists(told, lambda s: s["w"] != UNIT)).select("item", "variant", F.lit(NAMES).alias("reading"), "pos")
    told = plain.where(F.col("reading") == PLAIN).unionByName(plain.join(names, ["item", "variant", "reading", "pos"], "left_semi"))
    return told.withColumnRenamed("pos", "ipos")


def window_slots(rows: DataFrame, text: str, width: int, *keys: str, at: str | None = None) -> DataFrame:
    """``(*keys, pos, slots)``: (type, value, first) of each placeholder of the
    windows of the names reading; of those at the positions ``at`` only."""
    words = template_words(rows, text, *keys, *([at] if at else []))
    starts = F.col(at) if at else F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    part = words.select(*keys, "words", F.explode(starts).alias("pos")).select(*keys, "pos", F.slice("words", F.col("pos") + 1, width).alias("_part"))
    slots = F.transform(F.filter("_part", lambda s: s["w"].isin(NUMBER, UNIT, NAME)),
                        lambda s: F.struct(s["w"].alias("type"), s["r"].alias("value"), s["first"].alias("first")))
    return part.select(*keys, "pos", slots.alias("slots"))


def ordinary_words(words: DataFrame, *texts: DataFrame) -> DataFrame:
    """Those of ``words`` (column ``word``, lower case) that more of the texts
    hold in lower case than capitalised inside a sentence."""
    out = None
    for rows in texts:
        told = F.transform("_tokens", lambda t, at: F.when((t >= "A") & (F.lower(t) == t), t)
                           .when((t >= "A") & ~F.coalesce(F.get("_tokens", at - 1).isin(*MARKS), F.lit(True)), F.concat(F.lit("#"), F.lower(t))))
        forms = tokenized(rows, "text").select(F.explode(F.array_distinct(F.array_compact(told))).alias("form"))
        forms = forms.select(F.ltrim("form", F.lit("#")).alias("word"), F.col("form").startswith("#").alias("name"))
        out = forms if out is None else out.unionByName(forms)
    return (out.join(_small(words), "word", "left_semi").groupBy("word").agg(F.count_if("name").alias("names"), F.count(F.lit(1)).alias("n"))
            .where("n > 2 * names").select("word"))


def _small(side: DataFrame) -> DataFrame:
    """Broadcast if measured small; beyond the bound a shuffle gives the same."""
    return F.broadcast(side) if side.count() * 96 <= BROADCAST_MAX_BYTES else side


def short_lengths(items: DataFrame, text: str, width: int) -> list[int]:
    """The numbers of words below ``width`` that occur among the items."""
    size = F.size("_plain").alias("k")
    return sorted(r.k for r in token_hashes(items, text).select(size).distinct().where(F.col("k").between(1, width - 1)).collect())


PAIR = ["doc", "version", "item", "variant"]


def _index(side: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """``(hash, item, variant)``: the windows of each item that the fewest items
    share, as many as a document that holds the item cannot miss."""
    shared = side.groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    common = side.join(shared, "hash").groupBy("item", "variant", "ipos").agg(F.max("items").alias("items"))
    first = F.row_number().over(Window.partitionBy("item", "variant").orderBy("items", "ipos"))
    needed = F.col("n_windows") - F.ceil(F.col("n_windows") * similarity) + 1
    chosen = common.withColumn("nr", first).join(sizes, ["item", "variant"]).where(F.col("nr") <= needed)
    return side.join(chosen.select("item", "variant", "ipos"), ["item", "variant", "ipos"], "left_semi").select("hash", "item", "variant").distinct()


def held_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc, version, item, variant, n_windows, n_matched, n_changed)`` of
    every text (``version``: its hash) and item it holds."""
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    items = spill_table(benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull())
                        .select(F.col(item).alias("item"), F.col(item_text).alias("text")).distinct().withColumn("variant", F.xxhash64("text")), "items")
    side = spill_table(item_windows(items, width), "item-windows")
    sizes = spill_table(side.groupBy("item", "variant").agg(F.countDistinct("ipos").alias("n_windows")), "item-sizes")
    index = spill_table(_index(side, sizes, similarity), "item-index")
    short = short_lengths(items, "text", width)

    # one pass over all documents
    hit = document_hashes(named, "text", width, short, "doc", "version").join(_small(index), "hash")
    found = spill_table(hit.select(*PAIR).distinct(), "template-candidates", few=True)
    some = named.join(_small(found.select("doc", "version").distinct()), ["doc", "version"], "left_semi").groupBy("doc", "version").agg(F.any_value("text").alias("text"))
    some = spill_table(some, "candidate-texts")

    # all windows of the documents found, against the items found in them
    met = document_windows(some, "text", width, short, "doc", "version").join(_small(side), ["reading", "hash"])
    met = spill_table(met.join(found, PAIR, "left_semi").select(*PAIR, "reading", "pos", "ipos"), "template-met", few=True)
    plain = F.size(F.collect_set(F.when(F.col("reading") == PLAIN, F.col("ipos")))).alias("n_plain")
    counts = met.groupBy(*PAIR).agg(plain, F.size(F.collect_set("ipos")).alias("n_any")).join(sizes, ["item", "variant"])
    enough = F.col("n_windows") * similarity
    counts = spill_table(counts.where(F.col("n_any") >= enough), "template-counts", few=True)
    verbatim = counts.where(F.col("n_plain") >= enough).select(*PAIR, "n_windows", F.col("n_plain").alias("n_matched"), F.lit(0).alias("n_changed"))

    # the slots of the windows that matched by names
    open_ = counts.where(F.col("n_plain") < enough).select(*PAIR, "n_windows")
    rows = spill_table(met.join(open_, PAIR), "template-open", few=True)
    by_names = rows.where(F.col("reading") == NAMES).withColumn("shift", F.col("pos") - F.col("ipos"))
    wanted = by_names.groupBy("doc", "version").agg(F.collect_set("pos").alias("at"))
    doc_slots = window_slots(some.join(wanted, ["doc", "version"]), "text", width, "doc", "version", at="at").withColumnRenamed("slots", "doc_slots")
    item_slots = window_slots(items, "text", width, "item", "variant").withColumnsRenamed({"pos": "ipos", "slots": "item_slots"})
    along = [*PAIR, "shift"]
    aligned = by_names.join(item_slots, ["item", "variant", "ipos"]).join(doc_slots, ["doc", "version", "pos"]).select(*along, "ipos", "item_slots", "doc_slots")
    aligned = spill_table(aligned, "template-aligned", few=True)
    values = aligned.select(*along, "ipos", F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("z")).select(
        *along, "ipos", F.col("z.item_slots.type").alias("type"), F.col("z.item_slots.value").alias("from"), F.col("z.doc_slots.value").alias("to"),
        (F.col("z.item_slots.first") | F.col("z.doc_slots.first")).alias("first"))
    # at the start of a sentence an ordinary word is no name that may change
    swapped = values.where((F.col("type") == NAME) & F.col("first") & (F.col("from") != F.col("to")))
    swapped = spill_table(swapped.select(*along, "ipos", F.explode(F.array(F.lower("from"), F.lower("to"))).alias("word")).distinct(), "template-swapped", few=True)
    if not swapped.isEmpty():
        ordinary = spill_table(ordinary_words(swapped.select("word").distinct(), named, items), "ordinary-words", few=True)
        barred = spill_table(swapped.join(ordinary, "word").select(*along, "ipos").distinct(), "template-barred", few=True)
        aligned, values = (r.join(barred, [*along, "ipos"], "left_anti") for r in (aligned, values))
    seen = values.groupBy(*along, "type", "from", "to").agg(F.count(F.lit(1)).alias("n"))
    chosen = seen.groupBy(*along, "type", "from").agg(F.max(F.struct("n", "to"))["to"].alias("chosen"))
    against = values.join(chosen, [*along, "type", "from"]).where(F.col("to") != F.col("chosen")).select(*along, "ipos").distinct()
    consistent = aligned.join(against, [*along, "ipos"], "left_anti").select(*PAIR, "ipos")
    counted = (consistent.unionByName(rows.where(F.col("reading") == PLAIN).select(*PAIR, "ipos"))
               .groupBy(*PAIR).agg(F.size(F.collect_set("ipos")).alias("n_matched")))
    changed = chosen.where(F.col("from") != F.col("chosen")).groupBy(*PAIR).agg(F.size(F.collect_set(F.struct("type", "from"))).alias("n_changed"))
    varied = (open_.join(counted, PAIR).where(F.col("n_matched") >= enough).join(changed, PAIR, "left")
              .select(*PAIR, "n_windows", "n_matched", F.coalesce("n_changed", F.lit(0)).alias("n_changed")))
    return verbatim.unionByName(varied)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``(key, item, n_windows, n_matched, similarity, n_changed)`` of every
    document and item it holds; n_changed: slot values of the item that stand
    for another value in the document (0: found verbatim)."""
    held = held_items(docs, benchmark, key, text, item, item_text, width, similarity)
    best = held.groupBy("doc", "item").agg(F.max(F.struct(
        (F.col("n_matched") / F.col("n_windows")).alias("similarity"), "n_windows", "n_matched", "n_changed")).alias("b"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), F.col("b.n_windows").cast("long").alias("n_windows"),
                       F.col("b.n_matched").cast("long").alias("n_matched"), F.col("b.similarity").alias("similarity"),
                       F.col("b.n_changed").cast("long").alias("n_changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the texts that hold a benchmark item; other texts of
    the same id, and rows without an id, stay."""
    found = spill_table(held_items(docs, benchmark, key, text).select(F.col("doc").alias("_doc"), F.col("version").alias("_version")).distinct(), "contaminated", few=True)
    return docs.join(found, (docs[key] == found["_doc"]) & (F.xxhash64(docs[text]) == found["_version"]), "left_anti")
