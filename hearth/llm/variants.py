"""Operator 13: spelling variants by reduced-alphabet neighbourhoods.

Words are the runs of letters of all documents, lower-cased in A-Z, of at
least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences. Two words are
near when one inserted, deleted or replaced code point turns one into the
other.

1. Every letter is hashed to one of ``SYMBOLS`` symbols. One edit of a word is
   at most one edit of its reduced word.
2. The full one-edit neighbourhood of each reduced word is generated: with few
   symbols that is some ``2 * SYMBOLS * length`` strings, whatever the real
   alphabet.
3. The neighbourhoods are joined with the reduced vocabulary. An edit lies in
   one half of a word and leaves the other half as it is, so the key carries
   that half in its original letters as well: words that merely share a reduced
   form do not meet, and no bucket grows with the vocabulary.
4. The words that met are verified on their original letters.

Then each word takes as its form the most frequent near word that occurs at
least ``DOMINANCE`` times as often, and its root is found by doubling the
links, which gives any chain in a logarithmic number of rounds.

Occurrences are counted with partial aggregation, so a frequent word costs one
row per task; everything after works on the vocabulary, and a word with many
near words is counted in the map tasks as well. All DataFrame functions.

``slip``: for tests of the grouping, one of ``slip`` (document, run) pairs by
crc32 loses a code point, as a misspelling; None takes the runs as they are.

Result: ``word, n, form, root, n_near, form_n``. Cases: null and empty texts
have no words; a null id counts as the empty string in the slip; a very long
text is an array of its runs in one task; of equally frequent near words the
first in code-point order is the form; repeated rows count each time; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.staging import is_empty, merged, stage, table, text_of

MIN_LENGTH = 6
MIN_COUNT = 5
DOMINANCE = 5
SYMBOLS = 4
SLIP = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, slip: int | None = None) -> DataFrame:
    """``word, n``: the words and how often they occur."""
    # A run that is too short stays so when it loses a letter.
    found = F.regexp_extract_all(text_of(text_col), F.lit("[A-Za-zÀ-ÿ]{%d,}" % min_length), F.lit(0))
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                     F.explode(found).alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    word = F.col("run")
    if slip:
        h, n = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
        at = F.pmod(h, n.cast("long")).cast("int")
        word = F.when(F.pmod(h, F.lit(slip)) == 0, F.concat(
            F.substring(word, F.lit(1), at), F.substring(word, at + 2, n))).otherwise(word)
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with every letter hashed to one of the symbols."""
    return F.translate(word, _LETTERS, "".join(_LOWER[ord(c) * 11 % 31 % symbols] for c in _LETTERS))


def _key(red: Column, side: str, half: Column) -> Column:
    return F.xxhash64(red, F.lit(side), half)


def _cut(s: Column, start: Column | int, stop: Column) -> Column:
    """``s[start:stop]``"""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(s, start + 1, F.greatest(stop - start, F.lit(0)))


def _own_keys(word: Column, red: Column) -> Column:
    """The vocabulary's side: the reduced word with either half."""
    n = F.length(word)
    half = F.floor(n / 2).cast("int")
    return F.array(_key(red, "first", _cut(word, 0, half)), _key(red, "last", _cut(word, half, n)))


def _near_keys(word: Column, red: Column, symbols: int) -> Column:
    """The neighbourhood: all reduced words one edit away, each with the half
    that the edit leaves alone as it stands in the edited word."""
    n = F.length(word)

    def keyed(new: Column, at: Column, grown: int) -> Column:
        # The edited word has n + grown letters; its last half begins at ``half`` there.
        half = F.floor((n + grown) / 2).cast("int")
        return F.when(at >= half, _key(new, "first", _cut(word, 0, half))).otherwise(
            _key(new, "last", _cut(word, half - grown, n)))

    alphabet = F.array(*[F.lit(_LOWER[k]) for k in range(symbols)])
    every = F.sequence(F.lit(0), n - 1)
    deleted = F.transform(every, lambda i: keyed(F.concat(_cut(red, 0, i), _cut(red, i + 1, n)), i, -1))
    replaced = F.flatten(F.transform(every, lambda i: F.transform(alphabet, lambda s: keyed(
        F.concat(_cut(red, 0, i), s, _cut(red, i + 1, n)), i, 0))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(alphabet, lambda s: keyed(
        F.concat(_cut(red, 0, i), s, _cut(red, i, n)), i, 1))))
    return F.array_distinct(F.concat(deleted, replaced, inserted))


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, near, near_n``: each word with each word one edit away, from a
    table ``word, n`` of distinct words."""
    red = reduced(F.col("word"), symbols)
    own = words.select("word", "n", red.alias("red")).select(
        F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(_own_keys(F.col("word"), F.col("red"))).alias("key"))
    around = words.select("word", red.alias("red")).select(
        "word", F.explode(_near_keys(F.col("word"), F.col("red"), symbols)).alias("key"))
    # A word's halves may both lead to a near word; levenshtein counts code points.
    met = stage(merged(around, own, "key").filter(
        (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
        .select("word", "near", "near_n"), "near")
    return met.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from a table ``word, form`` without cycles (null: none)."""
    at = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(merged(at, step, "root").select("word", F.col("root").alias("was"), F.col("further").alias("root")),
                      "roots")
        if is_empty(after.filter("was <> root")):
            return after.select("word", "root")
        at = after.select("word", "root")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, dominance: int = DOMINANCE, symbols: int = SYMBOLS,
                      slip: int | None = None) -> DataFrame:
    """One row per word with its form and root."""
    words = stage(vocabulary(df, id_col, text_col, min_length, min_count, slip), "words")
    around = near_words(words, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = merged(words, around, "word", "left")
    most = -F.col("best.less")
    rows = stage(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(most >= dominance * F.col("n"), F.col("best.near")).alias("form"),
                             F.when(most >= dominance * F.col("n"), most).alias("form_n")), "forms")
    return merged(rows, roots(rows), "word").select("word", "n", "form", "root", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), slip=SLIP)


# crc32 byte by byte: the table's entries are the bytes' own eight steps.
_CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
                 ORDER BY b) AS t FROM range(256) r(b))"""
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, {_LOW.format("run")} AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_transform(range(strlen(id || ':' || run)),
                   lambda k: ('0x' || substr(hex(encode(id || ':' || run)), 2 * k + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) AS h
  FROM runs, crc),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
         ELSE run END AS word, times FROM hashed),
w AS (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
         FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
shorter AS (SELECT DISTINCT l.word, w.word AS near FROM less l JOIN w ON l.rest = w.word),
near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, near FROM shorter UNION SELECT near, word FROM shorter),
best AS (
  SELECT a.word, count(*) AS n_near, first(a.near ORDER BY b.n DESC, a.near) AS near, max(b.n) AS near_n
  FROM near a JOIN w b ON a.near = b.word GROUP BY a.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
         CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT word, n, form, root, n_near, form_n
FROM forms JOIN (SELECT word, max_by(here, step) AS root FROM chain GROUP BY word) USING (word)
"""
