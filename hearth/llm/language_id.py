"""Operator 1: language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled text. A document is parsed greedily against each automaton: the next
phrase is the longest match with the sample that starts here. The fewer
phrases a language needs, each priced at log2 of the sample size, the better
its text explains the document; the cheapest language wins. A sample of fewer
than ``LEAST_SAMPLE`` characters is priced as one of that size: its phrases are
mostly single letters, and a price below that of a letter would win every text.

The greedy parse is a finite automaton: follow the transition if there is one,
else count a phrase and go on from the root. Its transitions are one table, so
all segments of a group of documents advance one letter per array operation,
for all languages at once. Segments are ``SEGMENT`` letters; whole texts are
parsed.

Each language's table has columns for the letters of its own sample, at most
``MAX_LETTERS``, so the tables grow with the number of languages whatever their
scripts. Only the sample is broadcast: at most ``CHARS_OF_ALL`` characters of
the ``MAX_LANGUAGES`` languages with the most labelled rows (a column of free
text would have any number), whatever the corpus. It is drawn over the whole
table: a window of
``WINDOW`` characters from documents chosen by a hash of the id, from as many
documents as needed. Each worker builds the tables from it once.

Result: ``lang_pred, score, bits`` per row; the score is the share of the
winner in ``2^-(bits / TEMPER)``, from 0 to 1; ``bits`` is per letter, with
the winner's phrases at the price of a full sample, so that it means the same
whatever the size of the winner's sample. Cases: a null text, an empty one or one
without letters is ``und`` with score 0, as is every text when no labelled
text exists; ties go to the alphabetically first language; letters that the
sample lacks end a phrase in every language; a repeated row is predicted
twice, alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from hearth.llm.staging import table, text_of

CHARS_PER_LANGUAGE = 30_000
CHARS_OF_ALL = 1_200_000  # beyond 40 languages each has a smaller sample
MAX_LANGUAGES = 200
WINDOW = 250
LEAST_SAMPLE = 250  # characters that a phrase is priced for at least
MAX_LETTERS = 128  # of one language's sample, by frequency: bounds the tables
SEGMENT = 256
TEMPER = 8.0
MAX_BITS = 10.0  # texts of a learned language need about 3, of an unknown script about 14
LONG_BITS, SLACK = 6.4, 360.0  # a text of n letters may need LONG_BITS + SLACK / n, at most MAX_BITS
UNKNOWN = "und"


def held_out_by(id_col: str, modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def sample_text(df: DataFrame, id_col: str, text_col: str, lang_col: str,
                chars_per_language: int = CHARS_PER_LANGUAGE,
                max_languages: int = MAX_LANGUAGES) -> dict[str, list[str]]:
    """Windows of labelled text of the ``max_languages`` most frequent languages
    (ties in alphabetical order), at most ``chars_per_language`` characters of
    each and ``CHARS_OF_ALL`` together."""
    lang = F.col(lang_col).cast("string")
    rows = df.filter(lang.isNotNull() & F.col(text_col).isNotNull()).select(
        lang.alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    counts = {r["lang"]: r["n"] for r in per.limit(max_languages).collect()}
    if not counts:
        return {}
    chars_per_language = min(chars_per_language, CHARS_OF_ALL // len(counts))
    want = max(1, chars_per_language // WINDOW)
    # Twice the wanted share, as hashes vary and short texts fill less.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3.0 * want / n))])
    h = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20))
    pick = rows.filter(h < share[F.col("lang")] * (1 << 20))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    got = (pick.select("lang", "id", h.alias("h"), F.substring(
        F.col("text"), (F.pmod(F.xxhash64("id", F.lit(2)), room) + 1).cast("int"), F.lit(WINDOW)).alias("w"))
        .limit(8 * want * len(counts)).collect())
    out: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(got, key=lambda r: (r["h"], r["id"] or "", r["w"])):
        if sum(map(len, out[r["lang"]])) + len(r["w"]) <= chars_per_language:
            out[r["lang"]].append(r["w"])
    return {k: v for k, v in sorted(out.items()) if any(any(c.isalpha() for c in w) for w in v)}


def normalise(text: str) -> str:
    """Lower-case letters; every run of other characters is one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions per state of the automaton of all substrings of ``text``."""
    trans: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class CrossParser:
    """Parses texts against the samples of all languages at once."""

    def __init__(self, samples: dict[str, list[str]], max_letters: int = MAX_LETTERS):
        self.langs = sorted(samples)
        texts = [" ".join(normalise(w) for w in samples[k]) for k in self.langs]
        letters = []
        for t in texts:
            seen, n = np.unique(list(t), return_counts=True)
            letters.append([str(c) for c in seen[np.argsort(-n, kind="stable")][:max_letters]])
        alphabet = sorted({c for cs in letters for c in cs if c.isalpha()})
        # Column 0 pads, 1 is any letter outside the samples, 2 the blank.
        letter = {" ": 2} | {c: i + 3 for i, c in enumerate(alphabet)}
        self.columns = np.ones(0x110000, np.int32)
        for c, i in letter.items():
            self.columns[ord(c)] = i
        # A language's table has columns for its own letters only: ``own`` says
        # which column a letter of any language has in each (1 if none). A state
        # is the place of its row in the joined tables.
        self.own = np.ones((len(self.langs), len(alphabet) + 3), np.int32)
        tables, self.roots, at = [], [], 0
        for t, mine, to_own in zip(texts, letters, self.own, strict=True):
            column = {" ": 2} | {c: i + 3 for i, c in enumerate(c for c in mine if c.isalpha())}
            to_own[[letter[c] for c in column]] = list(column.values())
            width = len(column) + 2
            auto = suffix_automaton("".join(c if c in column else "\x00" for c in t))
            if at + len(auto) * width >= 1 << 30:
                raise ValueError("the samples are too large: fewer characters per language are needed")
            step = np.full((len(auto), width), -1, np.int32)  # all places are below 2^30
            for s, edges in enumerate(auto):
                for c, to in edges.items():
                    if c in column:
                        step[s, column[c]] = to
            again = np.maximum(step[0], 0) * width + at + (1 << 30)
            miss = step < 0
            step *= width
            step += at
            np.copyto(step, again, where=miss)
            del auto, miss
            tables.append(step.ravel())
            self.roots.append(at)
            at += step.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bits = np.array([np.log2(max(LEAST_SAMPLE, len(t))) for t in texts])
        self.full = np.log2(max([CHARS_PER_LANGUAGE, *map(len, texts)]))
        self.ample = np.array([len(t) >= CHARS_PER_LANGUAGE // 2 for t in texts])

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per language for each text (phrases times log2 of the sample
        size), and the letters of each text."""
        from hearth.llm.textvec import char_class, points
        lows = [t.lower() for t in texts]
        base = np.concatenate([[0], np.cumsum([len(t) for t in lows])])
        cps = points("".join(lows))
        letter = char_class(str.isalpha)[cps]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # a blank after each run of letters
        cut = base[1:-1]
        cut = cut[(cut > 0) & (cut < len(cps))]
        keep[cut] = letter[cut]
        col = np.where(letter, self.columns[cps], 2)[keep].astype(np.int32)
        n = np.add.reduceat(np.append(letter, False), base[:-1]) if len(texts) else np.zeros(0)
        n = np.where(np.diff(base) > 0, n, 0)
        lens = np.concatenate([[0], np.cumsum(keep)])[base]
        size = np.diff(lens)
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        first = np.cumsum(parts) - parts
        begin = lens[:-1][owner] + (np.arange(len(owner)) - first[owner]) * SEGMENT
        stop = np.minimum(begin + SEGMENT, lens[1:][owner])
        order = np.argsort(begin - stop, kind="stable")  # longest segments first
        begin, stop = begin[order], stop[order]
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(begin), axis=1)
        count = np.zeros(state.shape, np.int32)
        longest = stop - begin
        for t in range(int(longest[0]) if len(longest) else 0):
            live = int(np.searchsorted(-longest, -t, side="left"))
            step = self.table[state[:, :live] + self.own[:, col[begin[:live] + t]]]
            count[:, :live] += step >> 30
            state[:, :live] = step & ((1 << 30) - 1)
        phrases = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            phrases[:, k] = np.bincount(owner[order], weights=count[k], minlength=len(texts))
        return phrases * self.bits, n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per letter in that language at the price of a
        full sample, with two phrases free, as a short text is mostly its two
        ends, and the most bits that a text of that language may need."""
        if not self.langs:
            return [UNKNOWN] * len(texts), *np.zeros((3, len(texts)))
        bits, letters = self.costs(texts)
        best = bits.argmin(axis=1)
        odds = np.exp2(-np.clip((bits - bits.min(axis=1, keepdims=True)) / TEMPER, 0, 60))
        score = np.where(letters > 0, 1 / odds.sum(axis=1), 0.0)
        row = np.arange(len(texts))
        phrases = bits[row, best] / self.bits[best]
        per_letter = np.maximum(0, phrases - 2) * self.full / np.maximum(1, letters)
        most = np.where(self.ample[best], np.minimum(MAX_BITS, LONG_BITS + SLACK / np.maximum(1, letters)), MAX_BITS)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)], score, per_letter, most


_PARSERS: dict = {}


def _parser(samples: dict[str, list[str]]) -> CrossParser:
    """One parser per worker process and sample."""
    key = hash(tuple((k, tuple(v)) for k, v in samples.items()))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def identify(df: DataFrame, samples: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """``row, lang_pred, score, bits, most``: each row of ``df`` as a struct,
    with its language, score, bits per letter and the most that it may need."""
    rows = df.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = (StructType([rows.schema["row"]]).add("lang_pred", StringType()).add("score", DoubleType())
              .add("bits", DoubleType()).add("most", DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        parser = _parser(samples)
        for batch in batches:
            for first, group in groups(batch.column(1).to_pylist()):
                langs, score, bits, most = parser.predict(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(group)), pa.array(langs, pa.string()),
                     *[pa.array(x, pa.float64()) for x in (score, bits, most)]],
                    names=["row", "lang_pred", "score", "bits", "most"])

    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """The rows, as they are, whose text some learned language explains: it has
    letters and needs at most ``MAX_BITS`` per letter, a long text less where
    the language's sample is at least half full: learned text needs
    hardly above 5, Finnish 7; one close to a learned language may stay."""
    return (identify(docs, samples, text_col)
            .filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits") <= F.col("most"))).select("row.*"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out_by("doc_id", 4, 2)
    samples = sample_text(docs.filter(~held), "doc_id", "text", "lang")
    rows = identify(docs.select("doc_id", "text"), samples)
    return rows.select("row.doc_id", "lang_pred", "score", F.col("bits").alias("bits_per_letter")).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_letter")
