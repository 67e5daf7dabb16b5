"""Toxicity of noisy text: a noisy-channel decoder restores words, a learned lexicon scores them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import forget_tables, handed_back, numbered, runtime_filter, small_batches
from textwarden.sources.checkpoints import cut_lineage

#: Size of the lexicon, whatever the number of labels: features that may enter, features kept.
CANDIDATES, KEPT = 4_000, 500
#: Pairs of features that one task counts at a time.
PAIRS = 1_000_000
#: A feature must be in so many toxic documents, and be that much likelier in them (log odds).
SUPPORT, LOG_ODDS = 8, 3.0
#: A feature is a mark of copies, not of toxicity, if more others than this are in most of its documents.
COMPANIONS, MOST = 3, 0.8
THRESHOLD = 0.7
#: Lengths of word beginnings that are features next to whole words.
STEMS = (4, 5, 6, 7, 8)

#: What a written character may stand for (fixed values), besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Marks that may stand between letters and mean nothing.
GAPS = " .-_*~'/\\,;:#%&"
#: Costs of the channel, in nats: another character than meant, a dropped mark, a dropped repeat,
#: a digit or mark that is meant as such, a mark that parts words.
SWAP, DROP, REPEAT, KEEP, SPLIT = 1.0, 0.5, 0.2, 2.0, 1.5
#: Words that joined letters are parted into: so many at most, of so many letters at most.
WORDS, LONGEST = 30_000, 24
#: Written characters after which what all readings agree on is settled, and the most that stays unsettled.
SETTLE, OPEN = 32, 512
#: Character classes of the language model: word boundary, a to z, bytes of other letters, digits and marks.
_CLASSES = 29
_CODE = np.where(np.arange(256) < 128, 28, 27)
_CODE[list(range(ord("a"), ord("z") + 1))] = np.arange(1, 27)
_CODE[list(range(ord("A"), ord("Z") + 1))] = np.arange(1, 27)
_CODE[[9, 10, 11, 12, 13, 32, *map(ord, ".,;:!?\"()")]] = 0

_MARKS = re.escape("".join(LEET)) + re.escape(GAPS.replace(" ", ""))
#: Words that the channel may have changed: a letter stands next to a digit or mark, or three times in a row.
_ODD = re.compile(rf"[^\W\d_][{_MARKS}]+[^\W_]|[{_MARKS}][^\W\d_]|([^\W\d_])\1\1", re.S)
#: Single characters with one space between each two, at least four of them.
_SPACED = re.compile(rf"(?<!\S)(?:[^\W_]|[{re.escape(''.join(LEET))}])(?: (?:[^\W_]|[{re.escape(''.join(LEET))}])){{3,}}(?!\S)")
_OPENING = GAPS + "\"([{<>"
_OUTER = "".join(set(GAPS + "!?\"()[]{}<>|$*#%&+"))


def count_grams(docs: DataFrame, text: str) -> np.ndarray:
    """How often each three classes follow each other, over all texts; the table has a fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        total = np.zeros(_CLASSES**3, dtype=np.int64)
        for batch in batches:
            for value in batch["text"]:
                codes = _CODE[np.frombuffer(f"  {value}  ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
                total += np.bincount(codes[:-2] * _CLASSES**2 + codes[1:-1] * _CLASSES + codes[2:], minlength=_CLASSES**3)
        gram = np.flatnonzero(total)
        yield pd.DataFrame({"gram": gram, "n": total[gram]})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counts = rows.mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(_CLASSES**3)
    for row in counts:
        table[row["gram"]] = row["n"]
    return table.reshape(_CLASSES, _CLASSES, _CLASSES)


class Decoder:
    """Viterbi over the lattice of what each written character may mean.

    States are the last two classes; a step takes one written character or a run of equal
    ones. Of a run of letters one or two are meant; marks may mean a letter or nothing.
    Letters that were spaced one by one, or joined by marks, are parted into the words of a
    table, as its counts make likeliest; without one they stay together.
    """

    def __init__(self, grams: np.ndarray, words: Mapping[str, int] | None = None):
        # Interpolated with shorter contexts, so that no sequence is impossible.
        tri = (grams + 0.01) / (grams + 0.01).sum(axis=2, keepdims=True)
        two = grams.sum(axis=0) + 0.01
        two = two / two.sum(axis=1, keepdims=True)
        one = grams.sum(axis=(0, 1)) + 1
        one = one / one.sum()
        self.log = np.log(0.7 * tri + 0.2 * two[None] + 0.1 * one[None, None]).tolist()
        self.all = sum((words or {}).values())
        self.rare = float(np.log(max(1, self.all)))
        self.cost = {w: float(np.log(self.all / n)) for w, n in (words or {}).items()}
        self.memo: dict[str, str] = {}

    @staticmethod
    def _options(char: str, count: int) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = []
        meant = [(char, 0.0)] if char.isalpha() else []
        meant += [(c, SWAP) for c in LEET.get(char, "")]
        for c, cost in meant:
            found.append((c, cost + REPEAT * (count - 1)))
            if count > 1:
                found.append((c + c, cost + REPEAT * (count - 2)))
        if char in GAPS:
            found += [("", DROP * count), (" ", SPLIT)]
        elif not char.isalpha():
            found += [("", DROP * count + 2 * SWAP)] if char in "!|+(<" else []
            found.append((char * count, KEEP))
        return found

    @staticmethod
    def _classes(char: str) -> tuple[int, ...]:
        if "a" <= char <= "z":
            return (ord(char) - 96,)
        return (0,) if char == " " else (28,) if char.isascii() else (27, 27)

    def decode(self, word: str) -> str:
        """The likeliest word that was meant.

        Time is linear in the length: what all readings share is settled on the way, and
        readings that differ from the best one for OPEN characters leave.
        """
        word = word.lower().rstrip(_OUTER).lstrip(_OPENING)
        if not word:
            return word
        if word in self.memo:
            return self.memo[word]
        settled: list[str] = []
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for step, (char, run) in enumerate(groupby(word), 1):
            options = self._options(char, sum(1 for _ in run))
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, said) in best.items():
                for meant, cost in options:
                    x, y, total = a, b, score - cost
                    for c in meant:
                        for k in self._classes(c):
                            total += self.log[x][y][k]
                            x, y = y, k
                    old = after.get((x, y))
                    if old is None or (total, said + meant) > old:
                        after[(x, y)] = (total, said + meant)
            best = after
            if step % SETTLE == 0:
                top = max(best.values())[1]
                same = commonprefix([said for _, said in best.values()])
                if len(top) - len(same) > OPEN:
                    same = top[:-OPEN]
                best = {k: (score, said[len(same) :]) for k, (score, said) in best.items() if said.startswith(same)}
                settled.append(same)
        result = max((score + self.log[a][b][0], said) for (a, b), (score, said) in best.items())[1]
        result = "".join([*settled, result])
        if len(word) <= 64:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = result
        return result

    def parted(self, text: str) -> str:
        """The text with each run of letters as the likeliest words; time is linear in the length."""
        return _LETTERS.sub(lambda m: " ".join(self._words(m[0])), text) if self.cost else text

    def _words(self, letters: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(letters) + 1):
            found = []
            for start in range(max(0, end - LONGEST), end):
                # An unknown word is as rare as can be, the more so the longer it is.
                unknown = self.rare + 2.3 * (end - start - 1)
                found.append((best[start] + self.cost.get(letters[start:end], unknown), start))
            cost, start = min(found)
            best.append(cost)
            back.append(start)
        words, end = [], len(letters)
        while end:
            words.append(letters[back[end] : end])
            end = back[end]
        return words[::-1]

    def restore(self, text: str) -> str:
        """The text with the words that the channel may have changed as they were meant."""
        return self._restored(text)[0]

    def both(self, text: str) -> str:
        """The text and, behind it, what was restored: a plain word that looks odd is not lost."""
        return "\n".join([text, *self._restored(text)[1]])

    def _restored(self, text: str) -> tuple[str, list[str]]:
        meant: list[str] = []

        def joined(match: re.Match) -> str:
            letters = match[0].replace(" ", "").lower()
            whole = self.decode(letters)
            meant.append(whole)
            # A letter written twice is meant twice where no other sign was changed.
            meant.append(self.parted(whole if _ODD.search(letters) or not letters.isalpha() else letters))
            return meant[-1] if self.cost else whole

        text = _SPACED.sub(joined, text)
        if not _ODD.search(text):
            return text, meant
        words = text.split()
        for k, word in enumerate(words):
            if _ODD.search(word):
                words[k] = self.decode(word)
                meant.append(words[k])
                if self.cost and sum(c in GAPS for c in word) > 1:
                    words[k] = self.parted(words[k])
                    meant.append(words[k])
        return " ".join(words), meant


_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words in lower case (w:) and their beginnings (s:)."""
    words = set(_LETTERS.findall(text.lower()))
    stems = {f"s:{w[:n]}" for w in words for n in STEMS if len(w) > n}
    return {f"w:{w}" for w in words} | stems


@lru_cache(maxsize=1)
def _decoder(raw: bytes, words: tuple[tuple[str, int], ...] = ()) -> Decoder:
    """One for each worker, in place of the tables of other operators."""
    forget_tables()
    return Decoder(np.frombuffer(raw, dtype=np.float64).reshape(_CLASSES, _CLASSES, _CLASSES), dict(words))


class Model:
    """Lexicon words and word beginnings, and the share of toxic documents by number of hits."""

    def __init__(self, lexicon: Iterable[str], rates: list[float]):
        lexicon = list(lexicon)
        self.words = {f[2:] for f in lexicon if f[0] == "w"}
        self.stems = {f[2:] for f in lexicon if f[0] == "s"}
        self.rates = rates

    def count(self, words: set[str], stems: set[str]) -> int:
        """Distinct lexicon words, and beginnings that none of these words explains."""
        found = words & self.words
        begun = {s for s in stems & self.stems if not any(w.startswith(s) for w in found)}
        # Of beginnings within each other the shortest counts.
        return len(found) + sum(1 for s in begun if not any(s != t and s.startswith(t) for t in begun))

    def hits(self, text: str) -> int:
        words = set(_LETTERS.findall(text.lower()))
        stems = {w[:n] for w in words for n in STEMS if len(w) > n and w[:n] in self.stems} if self.stems else set()
        return self.count(words, stems)


def held_out(doc_id):
    """Rows of the fold that no label is learned from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, limit: int | None = None) -> DataFrame:
    """doc_id, text, toxic of every labelled row outside the held-out fold; with a limit, of so many ids by a hash of them."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.where(~held_out(F.col("doc_id")))
    if limit is not None:
        drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    drawn = cut_lineage(drawn)
    # Only texts that a filter of the ids lets through are moved, whatever the sizes.
    with runtime_filter(docs.sparkSession, always=True):
        return cut_lineage(texts.join(drawn.where(F.col("doc_id") >= -(1 << 63)), "doc_id"))


def count_words(sample: DataFrame) -> tuple[tuple[str, int], ...]:
    """The words that most rows hold, at most WORDS of them, and how many rows hold each: two at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                n = Counter(w for t in batch["text"].iloc[at : at + 512] for w in set(_LETTERS.findall(t.lower())) if len(w) <= LONGEST)
                yield pd.DataFrame({"word": list(n.keys()), "n": np.array(list(n.values()), dtype=np.int64)})

    counts = sample.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return tuple((r["word"], r["n"]) for r in counts.where("n > 1").orderBy(F.col("n").desc(), "word").limit(WORDS).collect())


def fit(sample: DataFrame, grams: np.ndarray, words: tuple[tuple[str, int], ...]) -> Model:
    """Learn the lexicon from labelled rows.

    Everything that is counted over rows is counted by Spark: features in toxic and other documents, pairs
    of features in toxic ones, documents by number of hits. To the driver come at most CANDIDATES features, by log
    odds, with these numbers. Words that only the copies of one document share come in crowds, and are left out by that.
    """
    raw = grams.astype(np.float64).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _decoder(raw, words)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "features": [list(features(decoder.both(t))) for t in part["text"]]})

    total = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = total.get(1, 0), total.get(0, 0)
    if not toxic:
        return Model([], [0.0 if other else 0.5])
    # Texts are decoded once, features read twice.
    owned = cut_lineage(sample.mapInPandas(run, "doc_id long, toxic int, features array<string>"))
    owned = owned.select("doc_id", "toxic", F.explode("features").alias("feature"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (other + 1))
    counts = (
        owned.groupBy("feature")
        .agg(F.sum((F.col("toxic") == 1).cast("long")).alias("a"), F.sum((F.col("toxic") != 1).cast("long")).alias("b"))
        .where(F.col("a") >= min(SUPPORT, max(3, toxic // 16)))
        .withColumn("odds", odds)
        .where(F.col("odds") >= LOG_ODDS)
    )
    best = [(r["feature"], r["a"], r["b"]) for r in counts.orderBy((F.col("odds") * F.sqrt("a")).desc(), "feature").limit(CANDIDATES).collect()]
    if not best:
        return Model([], rates([], toxic, other))
    named = sample.sparkSession.createDataFrame([(f, i) for i, (f, _, _) in enumerate(best)], "feature string, name int")
    held = (
        owned.join(F.broadcast(named), "feature")  # at most CANDIDATES rows
        .groupBy("doc_id", "toxic", "name").agg(F.count("*").alias("times"))
        .groupBy("doc_id", "toxic").agg(F.collect_list(F.struct("name", "times")).alias("held"))
    )
    held = cut_lineage(held.select("toxic", "held.name", "held.times"))
    chosen = choose(best, companions(held, best))
    return Model(chosen, rates(by_hits(held, best, chosen), toxic, other))


def companions(held: DataFrame, best: list[tuple[str, int, int]]) -> dict[int, int]:
    """How many others are in most of the toxic documents of a feature, by its place; only of features that may be chosen."""
    size = len(best)
    may = np.array([20 * b < a for _, a, b in best])
    begins = np.unique([f[2:6] for f, _, _ in best], return_inverse=True)[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, times, n = [], [], 0

        def counted() -> pd.DataFrame:
            pair, at = np.unique(np.concatenate(codes), return_inverse=True)
            found = np.bincount(at, weights=np.concatenate(times)).astype(np.int64)
            return pd.DataFrame({"name": (pair // size).astype(np.int32), "other": (pair % size).astype(np.int32), "n": found})

        for batch in batches:
            for names, often in zip(batch["name"], batch["times"]):
                names, often = np.asarray(names, dtype=np.int64), np.asarray(often, dtype=np.int64)
                own = np.flatnonzero(may[names])
                step = max(1, PAIRS // len(names))
                for start in range(0, len(own), step):
                    part = own[start : start + step]
                    apart = begins[names[part]][:, None] != begins[names][None, :]
                    codes.append((names[part][:, None] * size + names[None, :])[apart])
                    times.append((often[part][:, None] * often[None, :])[apart])
                    n += len(codes[-1])
                    if n >= PAIRS:
                        yield counted()
                        codes, times, n = [], [], 0
        if n:
            yield counted()

    pairs = held.where("toxic = 1").mapInPandas(run, "name int, other int, n long").groupBy("name", "other").agg(F.sum("n").alias("n"))
    most = held.sparkSession.createDataFrame([(i, MOST * a) for i, (_, a, _) in enumerate(best)], "name int, most double")
    crowds = pairs.join(F.broadcast(most), "name").where(F.col("n") >= F.col("most")).groupBy("name").agg(F.count("*").alias("n"))
    return {r["name"]: r["n"] for r in crowds.collect()}


def choose(best: list[tuple[str, int, int]], crowds: Mapping[int, int]) -> list[str]:
    """Features ``(feature, toxic documents, others)`` without a crowd of companions, those of most documents first."""
    order = sorted(range(len(best)), key=lambda i: (20 * best[i][2] - best[i][1], best[i][0]))
    return [best[i][0] for i in order if crowds.get(i, 0) <= COMPANIONS and 20 * best[i][2] < best[i][1]][:KEPT]


def by_hits(held: DataFrame, best: list[tuple[str, int, int]], chosen: list[str]) -> list[tuple[int, bool, int]]:
    """``(hits, toxic, documents)``, from one hit on; three stand for more."""
    model, names = Model(chosen, []), [f for f, _, _ in best]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for label, places in zip(batch["toxic"], batch["name"]):
                found = [names[i] for i in places]
                total[min(3, model.count({f[2:] for f in found if f[0] == "w"}, {f[2:] for f in found if f[0] == "s"})), label == 1] += 1
        yield pd.DataFrame({"hits": [k for k, _ in total], "toxic": [t for _, t in total], "n": list(total.values())})

    sums = held.mapInPandas(run, "hits int, toxic boolean, n long").where("hits > 0").groupBy("hits", "toxic").agg(F.sum("n").alias("n"))
    return [(r["hits"], r["toxic"], r["n"]) for r in sums.collect()]


def rates(found: list[tuple[int, bool, int]], toxic: int, other: int) -> list[float]:
    """The share of toxic documents by number of hits, which never falls."""
    table = {0: [toxic, other]}
    for k, is_toxic, n in found:
        table[0][not is_toxic] -= n
        table.setdefault(k, [0, 0])[not is_toxic] += n
    shares, last = [], 0.0
    for k in range(4):
        a, b = table.get(k, [0, 0])
        last = max(last, (a + 0.5) / (a + b + 1)) if a + b else last
        shares.append(round(last, 6))
    return shares


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """The rows with held_out, score (0 to 1), predicted and restored_hits, the lexicon words found.

    The language model counts the characters of all texts; labels, and the words that joined
    letters are parted into, are learned from every labelled row outside the held-out fold (with a `limit`, from the
    rows of so many ids); scores use the text alone. Null texts
    count as empty ones and have the score of texts without a hit. With no labels at all
    every score is 0.5, with no toxic one 0. Rows that repeat are scored alike. A
    label that is given twice for an id is toxic if one of them is. Input columns
    of the names of the added ones are replaced by these; others are kept.
    """
    with small_batches(docs.sparkSession):
        grams = count_grams(docs, text)
        sample = labelled(docs, labels, doc_id, text, limit)
        words = count_words(sample)
        model = fit(sample, grams, words)
    raw = grams.astype(np.float64).tobytes()

    kept: list[Decoder] = []

    # Spark pickles a hundred rows at a time, whatever the session's Arrow batches are when the result is read.
    @F.udf("struct<score:double,hits:int>", useArrow=False)
    def scored(value: str) -> tuple[float, int]:
        if not kept:
            kept.append(_decoder(raw, words))
        hits = model.hits(kept[0].both(value))
        return model.rates[min(hits, len(model.rates) - 1)], hits

    rows, names = numbered(docs)
    out = rows.withColumn("scored", scored(F.coalesce(F.col(names[text]), F.lit(""))))
    added = {
        "held_out": held_out(F.col(names[doc_id])),
        "score": F.col("scored.score"),
        "predicted": (F.col("scored.score") >= THRESHOLD).cast("int"),
        "restored_hits": F.col("scored.hits"),
    }
    return handed_back(out.withColumns(added), names, tuple(added))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, labels)
