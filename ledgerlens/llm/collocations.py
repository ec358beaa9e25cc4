"""Collocations: the longest windows of words are counted once, and ROLLUP sums them to all shorter phrases."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import discard, release, written
from ledgerlens.llm.line_dedup import LOWER, UPPER

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Frequent words that all tasks may know (a row takes some 30 bytes); with more of them windows hold the words themselves.
VOCABULARY = 2_000_000
#: Frequent pairs of words as text that all tasks may know; with more of them windows are joined to the pairs by a shuffle.
PAIRS = 500_000
#: Bits of the sieve of frequent pairs of numbered words: for each of the most pairs that there can be, and all there are at most (16 MB).
#: With more pairs than that the sieve lets more of the others through, which costs work and changes no count.
BITS_EACH, BITS = 16, 1 << 27
#: Parts in which pairs of numbered words, or windows of words as text, are counted by their first word, one after the other: memory and disk
#: hold those of one part at a time, and texts are read once for each. Numbered windows have gone through the sieve and are counted at once.
PARTS = 3
#: Bytes of text that a task looks at together; a longer text is cut where a piece ends.
CHUNK = 2 << 20
#: Bytes of text that come to a task at once, in both processes several times over; some languages share them.
BATCH = 4 * CHUNK
#: Rows of a batch that goes back to Spark.
ROWS = 1 << 15
#: Groups in which words are numbered, and in which each language's first phrases are sought before the last sort.
GROUPS = 256
BLANK, END = 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, 0x09]] = BLANK
CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = END
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 32


@contextmanager
def _small_batches(spark: SparkSession):
    """Meanwhile ``BATCH`` bounds the batches that go to Python; after that the session's own bound holds again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of some texts each; a text beyond ``CHUNK`` comes in parts that end with a piece."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:  # nothing but empty texts
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    cuts = [offsets]
    for k in np.flatnonzero(np.diff(offsets) > CHUNK):
        ends = np.flatnonzero(CLASS[data[offsets[k] : offsets[k + 1]]] == END) + 1 + offsets[k]
        cuts.append(ends[np.unique(ends // CHUNK, return_index=True)[1]])
    cuts = np.unique(np.concatenate(cuts))
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + CHUNK, "right")) - 1)
        yield data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at]
        at = to


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts, A-Z lower-cased, and the number of the piece that each is in."""
    kind = CLASS[data]
    word = kind == 0
    full = np.diff(offsets) > 0
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[first] = word[first]
    ends[:-1] &= ~word[1:]
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    steps = (kind == END).astype(np.int32)
    steps[first] += 1
    place = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
    letters = SMALL[data[word]]
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(place), pa.py_buffer(letters)])
    return words, np.cumsum(steps, dtype=np.int32)[start]


def _by_language(batches) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(language, words, pieces) of the (lang, text) rows, some texts of one language at a time."""
    for batch in batches:
        lang, text = batch.column(0), batch.column(1)
        for one in pc.unique(lang).to_pylist():
            for chunk in _chunks(text.filter(pc.equal(lang, one))):
                words, piece = split(*chunk)
                if len(words):
                    yield one, words, piece


def _word_counts(batches):
    for lang, words, _ in _by_language(batches):
        found = pc.value_counts(words)
        word, n = found.field("values"), found.field("counts")
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word), pa.string()), word.cast(pa.string()), n], ["lang", "word", "n"])


def lead_columns(ids: np.ndarray, piece: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each place the words there and after it, as columns; 0 from the first on that is 0 or in another piece."""
    columns = [ids]
    for j in range(1, longest):
        after = np.zeros_like(ids)
        if j < len(ids):
            after[:-j] = np.where((piece[j:] == piece[:-j]) & (columns[-1][:-j] > 0), ids[j:], 0)
        columns.append(after)
    return columns


def _sliced(arrays: list, names: list[str]):
    whole = pa.RecordBatch.from_arrays(arrays, names)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def _numbers(shared, batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, pieces), some texts of one language at a time; the number of a word that is not frequent is 0."""
    for lang, words, piece in _by_language(batches):
        if lang in shared.value:
            known, number = shared.value[lang]
            at = pc.fill_null(pc.index_in(words, known), -1).to_numpy()
            yield np.where(at >= 0, number[at], np.int32(0)), piece


def _numbered_pairs(shared, part: int, parts: int):
    """Pairs of the numbers of frequent words, those of one part; a word that is not frequent ends a piece."""
    def run(batches):
        for ids, piece in _numbers(shared, batches):
            columns = lead_columns(ids, piece, 2)
            keep = (columns[1] > 0) & (columns[0] % parts == part)
            yield from _sliced([pa.array(c[keep]) for c in columns], ["w0", "w1"])

    return run


def _numbered_windows(shared, sieve, longest: int):
    """Windows of the numbers of frequent words; a pair of words that the sieve does not hold ends a window, as a piece does."""
    def run(batches):
        for ids, piece in _numbers(shared, batches):
            size, bits = sieve.value
            pair = lead_columns(ids, piece, 2)
            place = (pair[0].astype(np.int64) << 32 | pair[1]) % size
            held = (pair[1] > 0) & (bits[place >> 6] >> (place & 63) & 1 > 0)
            columns = lead_columns(ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(~held[:-1])]), longest)
            yield from _sliced([pa.array(c[held]) for c in columns], [f"w{k}" for k in range(longest)])

    return run


def _sieve(pairs: DataFrame, size: int) -> np.ndarray:
    """Bits of a sieve of ``size`` that holds all pairs, in cells of 64."""
    place = pairs.select(F.pmod(F.shiftleft(F.col("w0").cast("long"), 32) + F.col("w1"), F.lit(size).cast("long")).alias("place"))
    cells = place.groupBy(F.expr("CAST(place div 64 AS int)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS int)))").alias("bits")).toArrow()
    bits = np.zeros(size // 64 + 1, np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return bits


def _word_windows(longest: int):
    """Windows of all words as text, under their language; nothing follows the last word of a piece."""
    def run(batches):
        for lang, words, piece in _by_language(batches):
            places = lead_columns(np.arange(1, len(words) + 1), piece, longest)
            keep = places[1] > 0
            texts = [pc.fill_null(words.take(pa.array(p[keep] - 1, mask=p[keep] == 0)), "").cast(pa.string()) for p in places]
            yield from _sliced([pa.array([lang] * int(keep.sum()), pa.string()), *texts], ["lang", *[f"w{k}" for k in range(longest)]])

    return run


def _summed(windows: DataFrame, lead: list[str], pad: str, longest: int, least: int, sieved: bool) -> DataFrame:
    """(lead, w: array of 2 to ``longest`` words, a) of all phrases found ``least`` times, from windows and their counts.

    Counts of the longest phrases are those of the full windows; ROLLUP sums them to each shorter prefix. A prefix of
    three words or more is seldom found twice, so windows that went through no sieve are kept for it only if their first
    two words are found ``least`` times. All sums are made within tasks before rows are shuffled, so a common beginning is
    no hot key.
    """
    names = [f"w{k}" for k in range(longest)]
    full = windows.where((F.col(names[-1]) != F.expr(pad)) & (F.col("n") >= least)).select(*lead, F.array(*names).alias("w"), F.col("n").alias("a"))
    if longest == 2:
        return written(full, "phrases")
    fixed, rolled = [*lead, *names[:2]], names[2:-1]
    pairs = windows.groupBy(*fixed).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    if not rolled:
        return written(full.unionByName(pairs.select(*lead, F.array(*names[:2]).alias("w"), "a")), "phrases")
    kept = windows
    if not sieved:
        pairs = written(pairs, "pairs")
        first = pairs.select(*fixed)
        kept = windows.join(F.broadcast(first) if first.count() <= PAIRS else first, fixed, "left_semi")
    marks = [f"grouping({c}) AS g_{c}" for c in rolled]
    sql = f"SELECT {', '.join([*fixed, *rolled, *marks])}, sum(n) AS a FROM {{kept}} GROUP BY {', '.join(fixed)}, ROLLUP ({', '.join(rolled)}) HAVING sum(n) >= {least}"
    sums = windows.sparkSession.sql(sql, kept=kept)
    # a column that is summed over is null; one that is not, and holds the mark for nothing, makes no phrase
    for c in rolled:
        sums = sums.where((F.col(f"g_{c}") == 1) | (F.col(c) != F.expr(pad)))
    out = written(full.unionByName(sums.select(*lead, F.filter(F.array(*names[:2], *rolled), lambda x: x.isNotNull()).alias("w"), "a")), "phrases")
    if not sieved:
        discard(pairs)
    return out


def _words_of(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, w, a) with the words for their numbers; a number is of one language."""
    each = phrases.select(F.col("w").alias("ids"), "a", F.posexplode("w").alias("pos", "id")).join(frequent.select("id", "lang", "word"), "id")
    g = each.groupBy("ids").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return g.select("lang", F.transform("w", lambda x: x["word"]).alias("w"), "a")


def _wide(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER, vocabulary: int = VOCABULARY,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts are cut at ``.,;:!?`` and line ends into pieces, and these at blanks and tabs into words, A-Z lower-cased. A
    phrase of 2 to ``longest`` words counts if it is found ``least`` times; its score is the least over its cuts of
    ``floor(2000000 * a / (l + r))``, with the counts of the whole and of both parts. Phrases go that lie in a longer one
    which is found in ``cover`` of 100 of their places. Null texts are empty, a null language is ``und``, repeated rows
    count as often as they come, and other columns play no part. Without texts there are no rows.

    Words that are not frequent are in no phrase, so they end a window. Frequent words are numbered and known to all
    tasks while there are at most ``vocabulary``, and pairs of them that are not frequent end a window too: a sieve that
    all tasks know tells most of these. Beyond that windows hold all words as text, with the same result.
    """
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    with _small_batches(df.sparkSession):
        counts = written(texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    group = F.pmod(F.xxhash64("lang", "word"), F.lit(GROUPS))
    place = F.row_number().over(Window.partitionBy("group").orderBy("lang", "word"))
    frequent = counts.where(F.col("n") >= least).withColumn("group", group).withColumn("id", (place - 1) * F.lit(GROUPS).cast("long") + F.col("group") + 1)
    frequent = written(frequent.select("lang", "word", "n", "id"), "frequent")
    names = [f"w{k}" for k in range(longest)]
    numbered = frequent.count() <= vocabulary
    if numbered:
        known: dict = {}
        table = frequent.select("lang", "word", "id").toArrow()
        for lang in pc.unique(table["lang"]).to_pylist():
            own = table.filter(pc.equal(table["lang"], lang))
            known[lang] = own["word"].combine_chunks().cast(pa.large_string()), own["id"].to_numpy().astype(np.int32)
        shared = df.sparkSession.sparkContext.broadcast(known)
        occurrences = frequent.agg(F.sum("n")).first()[0] or 0
        size, bits = min(BITS, BITS_EACH * occurrences // max(1, least)) | 1, 0
        for part in range(PARTS):
            rows = texts.mapInArrow(_numbered_pairs(shared, part, PARTS), "w0 int, w1 int")
            with _small_batches(df.sparkSession):
                bits |= _sieve(rows.groupBy("w0", "w1").agg(F.count("*").alias("n")).where(F.col("n") >= least), size)
            release(df.sparkSession)
        sieve = df.sparkSession.sparkContext.broadcast((size, bits))
    found = None
    for part in range(1 if numbered else PARTS):
        if numbered:
            rows, lead, pad = texts.mapInArrow(_numbered_windows(shared, sieve, longest), ", ".join(f"{c} int" for c in names)), [], "0"
        else:
            rows, lead, pad = texts.mapInArrow(_word_windows(longest), ", ".join(f"{c} string" for c in ["lang", *names])), ["lang"], "''"
            rows = rows.where(F.pmod(F.xxhash64("w0"), F.lit(PARTS)) == part)
        with _small_batches(df.sparkSession):
            windows = written(rows.groupBy(*lead, *names).agg(F.count("*").alias("n")), "windows")
        release(df.sparkSession)
        own = _summed(windows, lead, pad, longest, least, numbered)
        found = own if found is None else found.unionByName(own)
        discard(windows)
        release(df.sparkSession)
    phrases = (found if lead else written(_words_of(found, frequent), "phrases")).withColumn("phrase", F.array_join("w", " "))
    out = _kept(phrases, frequent, cover)
    # the first of each group are enough to find the first of all, so no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _kept(phrases: DataFrame, frequent: DataFrame, cover: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one covers."""
    every = frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")).unionByName(phrases.select("lang", "phrase", "a"))
    part = lambda of, n: every.select("lang", F.col("phrase").alias(of), F.col("a").alias(n))
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(CAST({SCALE} AS decimal(8,0)) * CAST(a AS decimal(20,0))) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    best = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = phrases.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("s"))
    longer = inner.select("lang", F.array_join(F.slice("w", F.col("s"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * cover))
    return held.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


#: DuckDB.
OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, t, count(*) AS f FROM grams GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, m, t, f AS a, string_split(t, ' ') AS w FROM f WHERE m >= 2 AND f >= {LEAST}),
cuts AS (
  SELECT lang, t, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a) // (x.f + y.f) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.t = cuts.x JOIN f AS y ON y.lang = cuts.lang AND y.t = cuts.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[s : s + n - 1], ' ') AS t, max(a) AS most
  FROM (SELECT *, unnest(range(1, m - n + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS n FROM c)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, t) WHERE most IS NULL OR 100::HUGEINT * most < {COVER} * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, t)::BIGINT AS rank, t AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
