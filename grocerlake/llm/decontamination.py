"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question keeps its form when
its parameters change.  Windows of canonical words are hash-joined with those of the benchmark;
where enough of an item's windows occur in a document, the values in its
slots are compared: equal values of the item must have become equal values.

Items without a window of enough words besides placeholders (short ones, rows of numbers) are found word by
word: all their windows, as they are, of five words or of all words if there are fewer.  An item of one word is
found where that is the whole text, as anywhere else a word says nothing of a copy.

A capital elsewhere (at the start of a text, a sentence, a quotation) may begin a name or not.
Windows with such a word have two forms, the word itself and a name's placeholder, on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 5
#: Share of an item's windows that must occur in the document, and of its slots
#: that must be filled consistently.
MIN_COVERAGE, MIN_CONSISTENCY = 0.8, 0.8
#: Words besides placeholders in a window that counts.
MIN_LITERALS = 2
#: Benchmark windows up to this number (some 24 MB) are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000

# Unit words and their short forms, in lower case.
UNITS = (
    "mm cm m km in ft yd mi miles mile meters metres meter metre inches feet yards mg g kg t oz lb lbs pounds grams gram kilograms kilogram tons tonnes "
    "ml l liters litres liter litre gallons s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year "
    "kb mb gb tb hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa mpa mph kmh dollars dollar euros euro cents cent usd eur gbp percent degrees degree"
).split()
_UNITS = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
#: Sign of a possible name, and what stands for that character in a text.
_MAYBE, _OTHER = "\x01", "\x02"
#: Words that begin sentences and are no names: one that became another word is a change of the wording.
OPENERS = (
    "a an the this that these those there here what which who whom whose when where why how is are was were am be do does did has have had can could will would shall should may might must "
    "i you he she it we they my your his her its our their one each every all both some any no not if then so but and or nor yet as at by for from in into of off on onto over to under up with without within "
    "after before during until while since because although though however also once only given suppose let find calculate compute determine write name explain describe list choose select use"
).split()


def marked_words(text: Column) -> Column:
    """Words of a text in lower case; those in slots begin with their type's sign.

    ``#`` a number, ``@`` a name (a capitalised word that follows a lower-case letter, a
    digit, a comma, a colon or a semicolon and one space), ``~`` a unit after a number.  Words are runs of
    letters and digits.  Null for null.
    """
    return _lower_words(_signed(text), "@#~")


def _signed(text: Column) -> Column:
    t = F.translate(text, "@#~", "   ")
    t = F.regexp_replace(t, r"([0-9])[.,]([0-9])", "$1$2")
    t = F.regexp_replace(t, r"([\p{Ll}\p{N},;:] )(\p{Lu})", "$1@$2")
    t = F.regexp_replace(t, r"([0-9]+)", " #$1 ")
    return F.regexp_replace(t, rf"(#[0-9]+) +((?i:{_UNITS}))([^\p{{L}}\p{{N}}]|$)", "$1 ~$2$3")


def _lower_words(t: Column, signs: str) -> Column:
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}{signs}]+"), "")


def open_words(text: Column) -> Column:
    """The same words, and other capitalised ones begin with the sign of a possible name."""
    t = _signed(F.translate(text, _MAYBE, _OTHER))
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}@#~])(\p{Lu})", f"{_MAYBE}$1")
    return _lower_words(t, f"@#~{_MAYBE}")


def _sign(word: Column) -> Column:
    return F.substring(word, 1, 1)


def _is_slot(word: Column) -> Column:
    return _sign(word).isin("#", "@", "~")


def _plain(word: Column) -> Column:
    """A word as it is if possible names are none."""
    return F.when(_sign(word) == _MAYBE, F.substring(word, 2, 1 << 20)).otherwise(word)


def _with_windows(df: DataFrame, text: str) -> DataFrame:
    """Add the words and, in order, a hash of the canonical words of each window: ``_windows`` with
    possible names as words, ``_open`` with them as names, null where that is the same.

    Fewer words than a window has give no window.  Windows are exploded with the outer
    form: for the inner one the optimizer tests the array's size below the projections,
    which repeats all of this for each element.
    """
    words = df.withColumn("_words", F.coalesce(open_words(F.col(text)), F.array().cast("array<string>")))
    hashed = words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(F.when(_is_slot(w), _sign(w)).otherwise(_plain(w)))))
    hashed = hashed.withColumn("_names", F.zip_with("_words", "_hashes", lambda w, h: F.when(_sign(w) == _MAYBE, F.xxhash64(F.lit("@"))).otherwise(h)))
    last = F.size("_words") - WINDOW
    none = F.array().cast("array<bigint>")

    def windows(name: str) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(name), i + k) for k in range(WINDOW)]))
        return F.when(last >= 0, each).otherwise(none)

    out = hashed.withColumn("_windows", windows("_hashes")).withColumn("_as_names", windows("_names"))
    return out.withColumn("_open", F.zip_with("_windows", "_as_names", lambda w, o: F.when(w != o, o)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_pos, window, item_plain, item_words of every window with enough words besides slots.

    A window has a row for each of its forms; the second (not item_plain) where it has enough words as well.
    Items with equal ids and texts count once.  Null texts and items shorter than a window have none.
    """
    items = _with_windows(benchmark.select("item_id", "text").distinct(), "text")
    rows = items.select("item_id", "_words", F.size("_windows").alias("_n"), F.posexplode_outer(F.concat("_windows", "_open")).alias("_at", "window")).where("window is not null")
    rows = rows.withColumns({"item_pos": (F.col("_at") % F.col("_n")).cast("int"), "item_plain": F.col("_at") < F.col("_n")})
    words = F.slice("_words", F.col("item_pos") + 1, WINDOW)
    literals = F.size(F.filter(words, lambda w: ~_is_slot(w))) - F.when(F.col("item_plain"), 0).otherwise(F.size(F.filter(words, lambda w: _sign(w) == _MAYBE)))
    return rows.where(literals >= MIN_LITERALS).select("item_id", "item_pos", "window", "item_plain", words.alias("item_words"))


def _exact(df: DataFrame, lengths: list[int]) -> Column:
    """Hashes of the windows of the given lengths, of words without signs; ``_words`` is there.  Only a whole text is a window of one word."""
    words = F.transform("_words", lambda w: F.translate(w, f"@#~{_MAYBE}", ""))

    def windows(n: int) -> Column:
        last = F.size("_words") - n
        each = F.transform(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(words, i, F.lit(n)), " ")))
        return F.when(last == 0 if n == 1 else last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.array(*map(windows, lengths)))


def exact_windows(benchmark: DataFrame, found: DataFrame) -> DataFrame:
    """item_id, item_pos, window, length of the items (item_id, text) that have no row in ``found``, word by word.

    Items without words have none.
    """
    items = _with_windows(benchmark.select("item_id", "text").distinct(), "text").where(F.size("_words") > 0)
    rest = items.join(found.select("item_id").distinct(), "item_id", "left_anti").withColumn("length", F.least(F.size("_words"), F.lit(WINDOW)))
    of = {n: F.posexplode(_exact(rest, [n])).alias("item_pos", "window") for n in range(1, WINDOW + 1)}
    parts = [rest.where(F.col("length") == n).select("item_id", each, "length") for n, each in of.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, min_consistency: float = MIN_CONSISTENCY) -> DataFrame:
    """A row for each document (doc_id, text) and benchmark item (item_id, text) it contains.

    Columns: doc_id, row_key (hash of id and text), item_id, windows (of the item), matched, slots (compared), changed (of
    them), consistency.  A document is known by id and text: equal rows give one row.
    Null and empty texts contain nothing; null items and those without words are never found.  Other columns are ignored.
    Items without a countable window are found where their exact windows are, and have no slots.

    Any other item is found by the first of three ways that has enough windows and consistent slots, and the figures are that way's: possible names as words;
    windows in either form on one diagonal (a run of the document, word beside word), the best one;
    windows in either form wherever they are.
    """
    bench = materialize(benchmark_windows(benchmark))
    n = bench.count()
    index = bench.select("item_id", "item_pos", "window", "item_plain")
    index = F.broadcast(index) if n <= BROADCAST_WINDOWS else index
    exact = materialize(exact_windows(benchmark, bench))
    lengths = sorted(r["length"] for r in exact.select("length").distinct().collect())  # at most five numbers
    keyed = docs.select("doc_id", "text").where("text is not null").withColumn("_key", F.xxhash64("doc_id", "text"))
    worded = _with_windows(keyed, "text")
    windows = worded.select("_key", F.size("_windows").alias("_n"), F.posexplode_outer(F.concat("_windows", F.array_compact("_open"))).alias("_at", "window"))
    hits = windows.join(index, "window").groupBy("_key", "item_id", "item_pos").agg(F.max(F.col("item_plain") & (F.col("_at") < F.col("_n"))).alias("plain"))
    sizes = bench.where("item_plain").groupBy("item_id").agg(F.count(F.lit(1)).alias("windows"))
    covered = hits.groupBy("_key", "item_id").agg(F.count(F.lit(1)).alias("either"), F.count_if("plain").alias("matched")).join(sizes, "item_id").where(F.col("either") >= F.col("windows") * min_coverage)
    covered = materialize(covered)
    # the few documents that hold an item are read again, word by word
    held = keyed.join(covered.select("_key").distinct(), "_key").distinct()
    opened = _with_windows(held, "text").select("doc_id", "_key", "_words", F.size("_windows").alias("_n"), F.posexplode_outer(F.concat("_windows", "_open")).alias("_at", "window")).where("window is not null")
    opened = opened.withColumn("doc_pos", (F.col("_at") % F.col("_n")).cast("int"))
    places = opened.join(covered.select("_key", "item_id"), "_key").join(F.broadcast(bench) if n <= BROADCAST_WINDOWS else bench, ["item_id", "window"])
    places = places.withColumns({"diagonal": F.col("doc_pos") - F.col("item_pos"), "plain": F.col("item_plain") & (F.col("_at") < F.col("_n"))})
    places = materialize(places.select("_key", "item_id", "diagonal", "item_pos", "plain", "item_words", F.slice("_words", F.col("doc_pos") + 1, WINDOW).alias("doc_words")))
    words = places.select("_key", "item_id", "diagonal", "item_pos", "plain", "doc_words", F.posexplode("item_words").alias("k", "item_word"))
    words = words.select("_key", "item_id", "diagonal", "plain", (F.col("item_pos") + F.col("k")).alias("place"), "item_word", F.get("doc_words", F.col("k")).alias("doc_word"))
    pair, way = ["_key", "item_id"], lambda k: F.lit(k).alias("way")
    share = (F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)) / F.sum("n")).alias("consistency")
    figures = F.sum("n").alias("slots"), F.sum("c").alias("changed"), share

    slots = words.where(F.col("plain") & _is_slot(F.col("item_word"))).select(*pair, "diagonal", "place", "item_word", "doc_word").distinct()
    by_value = slots.groupBy(*pair, "diagonal", "item_word").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("item_word") != F.col("doc_word")).cast("long")).alias("c"), (F.min("doc_word") == F.max("doc_word")).alias("same")
    )
    plain = covered.select(*pair, "windows", "matched").join(by_value.groupBy(*pair).agg(*figures), pair, "left").withColumn("way", F.lit(0))

    # a possible name counts as a slot where it changed, and then must be none of the openers
    value = lambda w: F.translate(w, f"@{_MAYBE}", "")
    maybe = _sign(F.col("item_word")) == _MAYBE
    slots = words.where(_is_slot(F.col("item_word")) | maybe).select(*pair, "diagonal", "place", maybe.alias("maybe"), value("item_word").alias("item_word"), value("doc_word").alias("doc_word")).distinct()
    by_value = slots.groupBy(*pair, "diagonal", "item_word").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("item_word") != F.col("doc_word")).cast("long")).alias("c"), (F.min("doc_word") == F.max("doc_word")).alias("same"),
        F.min("maybe").alias("maybe"), F.max(F.col("maybe") & (F.col("item_word") != F.col("doc_word")) & (F.col("item_word").isin(OPENERS) | F.col("doc_word").isin(OPENERS))).alias("reworded"),
    ).where("not maybe or c > 0").withColumn("same", F.col("same") & ~F.col("reworded"))
    lines = places.groupBy(*pair, "diagonal").agg(F.count_distinct("item_pos").alias("matched")).join(by_value.groupBy(*pair, "diagonal").agg(*figures), [*pair, "diagonal"], "left")
    line = lines.join(sizes, "item_id").select(*pair, "windows", "matched", "slots", "changed", "consistency", way(1))
    spread = covered.select(*pair, "windows", F.col("either").alias("matched")).join(by_value.groupBy(*pair).agg(*figures), pair, "left").withColumn("way", F.lit(2))

    ways = plain.unionByName(line).unionByName(spread).withColumns({"slots": F.coalesce("slots", F.lit(0)).cast("long"), "changed": F.coalesce("changed", F.lit(0)).cast("long"), "consistency": F.coalesce("consistency", F.lit(1.0))})
    passed = ways.where((F.col("matched") >= F.col("windows") * min_coverage) & (F.col("consistency") >= min_consistency))
    names = ("windows", "matched", "slots", "changed", "consistency")
    best = passed.groupBy(*pair).agg(F.min_by(F.struct(*names), F.struct("way", -F.col("matched"), -F.col("consistency"), -F.col("slots"), "changed")).alias("_f")).select(*pair, "_f.*")
    out = held.select("doc_id", "_key").join(best, "_key").select("doc_id", F.col("_key").alias("row_key"), "item_id", *names)
    if not lengths:
        return out
    few = F.broadcast(exact) if exact.count() <= BROADCAST_WINDOWS else exact
    whole = exact.groupBy("item_id").agg(F.count_distinct("item_pos").alias("windows"))
    seen = worded.select("doc_id", "_key", F.explode_outer(_exact(worded, lengths)).alias("window")).where("window is not null").join(few, "window")
    matched = seen.groupBy("doc_id", "_key", "item_id").agg(F.count_distinct("item_pos").alias("matched")).join(whole, "item_id").where(F.col("matched") >= F.col("windows") * min_coverage)
    zero = F.lit(0).cast("long")
    return out.unionByName(matched.select("doc_id", F.col("_key").alias("row_key"), "item_id", "windows", "matched", zero.alias("slots"), zero.alias("changed"), F.lit(1.0).alias("consistency")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = materialize(find_contamination(docs, benchmark).select("row_key").distinct())
    return docs.join(found, F.xxhash64("doc_id", "text") == F.col("row_key"), "left_anti")


def _words_sql(text: str) -> str:
    t = f"translate({text}, '@#~', '   ')"
    t = f"regexp_replace({t}, '([0-9])[.,]([0-9])', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '([\\p{{Ll}}\\p{{N}},;:] )(\\p{{Lu}})', '\\1@\\2', 'g')"
    t = f"regexp_replace({t}, '([0-9]+)', ' #\\1 ', 'g')"
    t = f"regexp_replace({t}, '(#[0-9]+) +((?i:{_UNITS}))([^\\p{{L}}\\p{{N}}]|$)', '\\1 ~\\2\\3', 'g')"
    return f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}@#~]+'), lambda w: w <> '')"


OP6_SQL = f"""
WITH b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, {_words_sql('text')} AS words FROM b),
d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
dw AS (SELECT row_number() OVER () AS k, doc_id, {_words_sql('text')} AS words FROM d),
bp AS (SELECT item_id, words, unnest(range(len(words) - {WINDOW - 1})) AS p FROM bw WHERE len(words) >= {WINDOW}),
bx AS (SELECT item_id, p, words[p + 1 : p + {WINDOW}] AS words FROM bp
  WHERE len(list_filter(words[p + 1 : p + {WINDOW}], lambda w: w[1] NOT IN ('#', '@', '~'))) >= {MIN_LITERALS}),
bi AS (SELECT *, array_to_string(list_transform(words, lambda w: CASE WHEN w[1] IN ('#', '@', '~') THEN w[1] ELSE w END), ' ') AS win FROM bx),
dp AS (SELECT k, doc_id, words, unnest(range(len(words) - {WINDOW - 1})) AS p FROM dw WHERE len(words) >= {WINDOW}),
dx AS (SELECT k, doc_id, p, words[p + 1 : p + {WINDOW}] AS words FROM dp),
di AS (SELECT *, array_to_string(list_transform(words, lambda w: CASE WHEN w[1] IN ('#', '@', '~') THEN w[1] ELSE w END), ' ') AS win FROM dx),
m AS (SELECT di.k, di.doc_id, bi.item_id, di.p AS dpos, bi.p AS ipos, di.words AS dwords, bi.words AS iwords FROM di JOIN bi USING (win)),
n AS (SELECT item_id, count(*) AS windows FROM bi GROUP BY item_id),
c AS (SELECT k, doc_id, item_id, windows, count(DISTINCT ipos) AS matched FROM m JOIN n USING (item_id)
  GROUP BY ALL HAVING count(DISTINCT ipos) >= windows * {MIN_COVERAGE}),
s AS (SELECT DISTINCT k, item_id, dpos - ipos AS diagonal, ipos + o AS place, iwords[o + 1] AS iw, dwords[o + 1] AS dw
  FROM m SEMI JOIN c USING (k, item_id), range({WINDOW}) t(o) WHERE iwords[o + 1][1] IN ('#', '@', '~')),
v AS (SELECT k, item_id, diagonal, iw, count(*) AS n, count(*) FILTER (iw <> dw) AS c, min(dw) = max(dw) AS same FROM s GROUP BY ALL),
x AS (SELECT item_id, list_transform(words, lambda w: ltrim(w, '@#~')) AS words, least(len(words), {WINDOW}) AS n FROM bw WHERE len(words) > 0 AND item_id NOT IN (SELECT item_id FROM bi)),
xi AS (SELECT item_id, n, p, array_to_string(words[p + 1 : p + n], ' ') AS win FROM (SELECT *, unnest(range(len(words) - n + 1)) AS p FROM x)),
xd AS (SELECT k, doc_id, n, list_transform(words, lambda w: ltrim(w, '@#~')) AS words FROM dw, (SELECT DISTINCT n FROM x) WHERE len(words) >= n AND (n > 1 OR len(words) = 1)),
xw AS (SELECT k, doc_id, n, array_to_string(words[p + 1 : p + n], ' ') AS win FROM (SELECT *, unnest(range(len(words) - n + 1)) AS p FROM xd)),
xc AS (SELECT k, doc_id, xi.item_id, any_value(w.windows) AS windows, count(DISTINCT xi.p) AS matched FROM xw JOIN xi USING (n, win) JOIN (SELECT item_id, count(*) AS windows FROM xi GROUP BY ALL) w ON w.item_id = xi.item_id
  GROUP BY k, doc_id, xi.item_id HAVING count(DISTINCT xi.p) >= any_value(w.windows) * {MIN_COVERAGE}),
g AS (SELECT k, item_id, sum(n)::BIGINT AS slots, sum(c)::BIGINT AS changed, sum(CASE WHEN same THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS consistency FROM v GROUP BY ALL)
SELECT doc_id, item_id, windows, matched, coalesce(slots, 0) AS slots, coalesce(changed, 0) AS changed, coalesce(consistency, 1.0)::DOUBLE AS consistency
FROM c LEFT JOIN g USING (k, item_id) WHERE coalesce(consistency, 1.0) >= {MIN_CONSISTENCY}
UNION ALL SELECT doc_id, item_id, windows, matched, 0, 0, 1.0::DOUBLE FROM xc
"""
