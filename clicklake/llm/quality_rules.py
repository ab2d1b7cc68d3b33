"""Quality rules: counts of a text's words, symbols and repetitions, and a log-likelihood ratio of hashed n-grams. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import CRC_CTES, Scratch, crc_sql, read_table

#: What separates words: the space and the control characters U+0009 to U+000D.
GAP = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Buckets of the hashed n-grams, and how many steps a unit of the log-likelihood ratio has (weights are integers).
BUCKETS, STEPS = 1 << 16, 10_000
#: A text of fewer words fails, and so does one with more than this percentage of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: One labelled document in so many sets the threshold instead of the target counts, by the crc32 of its id.
FOLD = 5
#: Thresholds are looked for on a grid of so many places a unit of the score.
GRID = 1_000
#: Up to so many trusted ids are broadcast; beyond, ids and texts meet by shuffle.
BROADCAST_IDS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def by_place(rows: DataFrame, *kept: str) -> DataFrame:
    """A row per place of the column `words`: `kept`, the word, and the next one (null at the end)."""
    placed = rows.select(*kept, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("place"))
    return placed.select(*kept, F.get("words", "place").alias("word"), F.get("words", F.col("place") + 1).alias("next"))


def buckets_of(word: str, next_word: str) -> tuple[Column, Column]:
    """The buckets of a word and of the pair that it begins: crc32 of their text, modulo BUCKETS. The last word begins none: null."""
    bucket = lambda text: (F.crc32(text) % BUCKETS).cast("int")  # noqa: E731
    return bucket(F.col(word)), F.when(F.col(next_word).isNotNull(), bucket(F.concat_ws(" ", word, next_word)))


def held(id_col: str) -> Column:
    """Whether an id belongs to the labelled documents that set the threshold."""
    return F.crc32(F.col(id_col).cast("string")) % FOLD == 0


def labels_by_id(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): ids and labels that are null do not count, of differing labels of an id the lowest does."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def ngram_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> str | None:
    """The log-likelihood ratio of every bucket in STEPS-ths, as a JSON array; None if no trusted document has a word.

    Two multinomials over the buckets: of the n-grams of all documents of `docs` (doc_id, text), and of those whose id is
    in `trusted` (doc_id, each once). Every bucket's count is one higher than found, so none is zero.
    """
    trusted = trusted.withColumn("target", F.lit(1))
    small = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # 8 MB of ids
    flagged = docs.join(F.broadcast(trusted) if small else trusted, "doc_id", "left").select(words_of("text").alias("words"), F.coalesce("target", F.lit(0)).alias("target"))
    places = by_place(flagged.filter(F.size("words") > 0), "target")
    counts = places.select("target", F.explode(F.array(*buckets_of("word", "next"))).alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    # From here on a row a bucket.
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    total = Window.partitionBy(F.lit(0))
    share = lambda n: F.log((F.col(n) + 1) / (F.sum(n).over(total) + buckets))  # noqa: E731
    weight = F.round((share("target") - share("raw")) * STEPS).cast("int")
    rows = every.select("bucket", weight.alias("weight"), "target").agg(F.sum("target").alias("n"), F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"])).alias("weights"))
    found = rows.first()
    return found["weights"] if found["n"] else None


#: Bits of a place in `count_repeated`; longer texts are told apart the slow way.
PLACE_BITS = 24


def covered(starts: Column) -> Column:
    """How many places windows of three cover, given their distinct starts in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    cover = lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n"), (x + 3).alias("end"))  # noqa: E731
    return F.aggregate(starts, start, cover, lambda a: a["n"])


def count_repeated(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: how many places lie in windows of three, given in order by 64-bit hashes (`grams`), that occur twice or more.

    Each window becomes a number of its hash's upper bits and its place; after a sort equal windows are neighbours. Should
    two different hashes share the upper bits, or the text be too long, pairs of hash and place are sorted instead.
    """
    kept = [c for c in rows.columns if c != "grams"]
    mask = (1 << PLACE_BITS) - 1
    some = F.size(F.array_distinct("grams")) < F.size("grams")
    coded = F.when(some, F.sort_array(F.transform("grams", lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))))
    rows = rows.select(F.inline(F.array(F.struct(*kept, "grams", coded.alias("coded")))))  # what lambdas index is made once
    same = lambda x, y: F.coalesce(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.lit(False))  # noqa: E731
    near = F.filter("coded", lambda x, i: same(x, F.get(F.col("coded"), i + 1)) | same(x, F.get(F.col("coded"), i - 1)))
    rows = rows.select(F.inline(F.array(F.struct(*kept, "grams", near.alias("near")))))
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")  # noqa: E731
    told = F.size(F.array_distinct(F.transform("near", lambda x: F.shiftright(x, PLACE_BITS)))) == F.size(F.array_distinct(F.transform("near", lambda x: F.get(F.col("grams"), place(x)))))
    quick = covered(F.sort_array(F.transform("near", place)))
    placed = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    slow = covered(F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    again = F.when(F.col("near").isNull(), 0).when(told & (F.size("grams") <= mask), quick).otherwise(slow)
    return rows.select(*kept, again.cast("long").alias("n_repeat_words"))


def score_documents(docs: DataFrame, weights: str | None) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score.

    The score is the mean weight of the text's n-grams, so its length does not matter; null without weights or n-grams.
    """
    text = F.col("text")
    window = lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2))  # noqa: E731
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), words_of(text).alias("words"))
    rows = rows.select(F.inline(F.array(F.struct("doc_id", "n_symbols", "lines", "words"))))
    grams = F.slice(F.transform("words", window), 1, F.greatest(F.size("words") - 2, F.lit(0)))
    again = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    rows = count_repeated(rows.select("doc_id", "n_symbols", again.alias("n_dup_lines"), "words", grams.alias("grams")))
    # A key for each row; all of a row's places are in one task, so what is shuffled is a row for each document.
    of_row = ["row_key", "doc_id", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = rows.withColumn("row_key", F.monotonically_increasing_id())
    rows = rows.withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(F.array(F.lit(None).cast("string"))))
    table = F.from_json(F.lit(weights or "[]"), "array<int>")
    one, pair = (F.coalesce(F.get(table, b), F.lit(0)).cast("long") for b in buckets_of("word", "next"))
    out = by_place(rows, *of_row).groupBy(*of_row).agg(F.count("word").alias("n_words"), F.coalesce(F.sum(F.length("word")), F.lit(0)).cast("long").alias("word_chars"), F.sum(one + pair).alias("weight"))
    score = F.when(F.col("n_words") > 0, F.col("weight") / ((2 * F.col("n_words") - 1) * F.lit(float(STEPS))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (score if weights else F.lit(None).cast("double")).alias("score"))


def best_threshold(scores: DataFrame, labels: DataFrame) -> float | None:
    """The score from which on documents are kept: the place that tells the labels of the held fold apart best.

    Of all places between two scores that have documents (on a grid of GRID steps a unit, so their number is bounded)
    the one with the highest share of bad documents under it plus share of good ones from it on; of equal ones the
    lowest. None if one of the two kinds is missing.
    """
    known = scores.filter(~F.col("base_failed") & F.col("score").isNotNull()).filter(held("doc_id")).join(labels, "doc_id")
    bins = known.groupBy(F.floor(F.col("score") * GRID).alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    before, every = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731
    n_good, n_bad = F.sum("good").over(every), F.sum("bad").over(every)
    gain = whole(F.coalesce(F.sum("bad").over(before), F.lit(0))) * whole(n_good) + whole(n_good - F.coalesce(F.sum("good").over(before), F.lit(0))) * whole(n_bad)
    places = bins.select("bin", gain.alias("gain"), F.coalesce(F.max("bin").over(before) + 1, "bin").alias("after"), n_good.alias("n_good"), n_bad.alias("n_bad"))
    best = places.filter("n_good > 0 and n_bad > 0").orderBy(F.desc("gain"), "bin").limit(1).first()
    return (best["bin"] + best["after"]) / 2 / GRID if best else None


def judge_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Words are runs of anything but space and U+0009 to U+000D, compared as they stand. The target multinomial comes from
    all documents with quality 1 in `labels` outside the held fold, the raw one from all documents, the threshold from
    the held fold's labelled documents (`best_threshold`); none of them moves text between machines unless there are over
    BROADCAST_IDS trusted ids. A document is kept if it passes the base rules and its score is at least the threshold.
    Without trusted documents, or labels of both kinds in the held fold, the base rules decide alone.

    Null and empty texts have no words and fail. Windows of three words are compared by 64-bit hash. Null ids have no
    labels. Repeated rows are rows of their own; an empty table gives none; other columns are not read.
    """
    scratch = Scratch(spark, "quality-rules")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labels = labels_by_id(labels)
    weights = ngram_weights(docs, labels.filter(F.col("quality") == 1).filter(~held("doc_id")).select("doc_id"))
    scored = scratch.cut(score_documents(docs, weights), "scored")
    least = best_threshold(scored, labels) if weights else None
    passed = ~F.col("base_failed")
    kept = passed if least is None else passed & (F.col("score") >= F.lit(least))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


#: The same rows in DuckDB, from a table of all words by place.
SQL = rf"""
WITH RECURSIVE {CRC_CTES},
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, list_filter(regexp_split_to_array(text, '{GAP}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines FROM d),
places AS (SELECT k, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
next AS (SELECT *, lead(word) OVER by_text AS word2, lead(word, 2) OVER by_text AS word3 FROM places WINDOW by_text AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i FROM next WHERE word3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, word, word2, word3) > 1),
cover AS (SELECT k, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) t(j) GROUP BY k),
grams AS (SELECT k, word AS gram FROM places UNION ALL SELECT k, word || ' ' || word2 FROM next WHERE word2 IS NOT NULL),
hashed AS (SELECT gram, {crc_sql("gram")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT gram FROM grams), crc_table),
l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
folds AS (SELECT doc_id, quality, {crc_sql("doc_id::VARCHAR")} % {FOLD} = 0 AS held FROM l, crc_table),
counts AS (
  SELECT bucket, count(*) AS raw, count(f.doc_id) AS target
  FROM grams JOIN hashed USING (gram) JOIN d USING (k) LEFT JOIN folds f ON f.doc_id = d.doc_id AND f.quality = 1 AND NOT f.held GROUP BY bucket
),
sums AS (SELECT sum(raw) AS raw, sum(target) AS target FROM counts),
weights AS (SELECT bucket, round((ln((c.target + 1)::DOUBLE / (s.target + {BUCKETS})) - ln((c.raw + 1)::DOUBLE / (s.raw + {BUCKETS}))) * {STEPS})::BIGINT AS weight FROM counts c, sums s WHERE s.target > 0),
scores AS (SELECT k, sum(weight)::BIGINT / (count(*) * {float(STEPS)}) AS score FROM grams JOIN hashed USING (gram) JOIN weights USING (bucket) GROUP BY k),
judged AS (
  SELECT k, doc_id, len(words) AS n_words, length(regexp_replace(text, '{GAP}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, score
  FROM w LEFT JOIN cover USING (k) LEFT JOIN scores USING (k)
),
based AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM judged),
bins AS (SELECT floor(score * {GRID}) AS bin, count_if(quality = 1) AS good, count_if(quality = 0) AS bad FROM based JOIN folds USING (doc_id) WHERE held AND NOT base_failed AND score IS NOT NULL GROUP BY 1),
cuts AS (
  SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) AS after, sum(good) OVER () AS goods, sum(bad) OVER () AS bads,
    coalesce(sum(bad) OVER before, 0) * sum(good) OVER () + (sum(good) OVER () - coalesce(sum(good) OVER before, 0)) * sum(bad) OVER () AS gain
  FROM bins WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
cut AS (SELECT (bin + after) / 2 / {GRID} AS least FROM cuts WHERE goods > 0 AND bads > 0 ORDER BY gain DESC, bin LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score >= (SELECT least FROM cut), true) AS kept, score FROM based
"""
