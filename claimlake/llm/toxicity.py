"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

Two levels are interpolated. At the upper one a class counts how often a word follows another; at the lower one a word's
count in a class is its number of different preceding words there. From each count goes a discount: DISCOUNT, and EXCESS
times what the counts of both classes together let expect (of pairs, by the class's share of the labelled documents), so only
expressions that are really the class's own keep mass. What a class takes from the pairs of a preceding word goes to its lower
level, and what it takes there is shared out by the pooled counts. The first word of a text has the lower level only. A text's
score is the mean over its words of log P(word | word before, toxic) - log P(word | word before, ordinary), put through a
logistic curve at the cutoff that errs least on labelled rows that the counts have not seen.

Words are told apart by 64-bit hashes and counted in a table that grows with the vocabulary; the counts cover all labelled
rows. All words of which no class keeps mass have one ratio; a pair of which no class keeps mass has its word's, moved by what
the word before has left. Of all words, preceding words and pairs that differ, the HOT_WORDS most frequent are broadcast and
the rest is joined to those of the texts. The cutoff is fitted on at most CALIBRATION_ROWS rows, in the order of a hash of
their id.

Nulls: null text has no words, null labels are not learned from. Texts without words score as the curve says at 0. A
document with several labels is toxic if one says so. Ties and repeated rows score alike. Empty tables give empty
results, and with no label of a class everything scores 0. Columns of the output's names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.llm import kernel as K
from claimlake.llm.common import fresh, prefilter, quoted, stash

#: Words whose ratios are broadcast, 16 bytes each; all others are joined.
HOT_WORDS = 1 << 18
DISCOUNT, EXCESS = 2.0, 3.0
CALIBRATION_ROWS = 20_000
_RUN = 1 << 21
#: Bits of a hash by which most words without a ratio of their own are passed over.
_BITS = 22


def word_hashes(texts: pa.Array):
    """(64-bit hashes of all words, index of each text's first word) of runs of texts."""
    for first, last, data, offsets in K.slices(texts):
        lower = K.LOWER[data]
        starts, ends, firsts = K.words(lower, offsets, K.ALPHANUMERIC)
        yield last - first, K.span_hash(K.prefix_hash(lower), starts, ends).view(np.int64), firsts


def words_before(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The word before each; 0 for the first of a text."""
    before = np.zeros(len(words), np.int64)
    before[1:] = words[:-1]
    before[firsts[:-1][firsts[:-1] < len(words)]] = 0
    return before


def before_name(before: np.ndarray) -> np.ndarray:
    """The hash that a word has as the one before another."""
    return ~before


def pair_name(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a word and the one before it."""
    b = before.view(np.uint64)
    return ((b << np.uint64(17)) | (b >> np.uint64(47))).view(np.int64) ^ word


def class_counts(labelled: DataFrame, toxic_share: float | None = None) -> DataFrame:
    """labelled (text, toxic 0/1) -> word, before, ordinary, toxic, pooled, n_ordinary, n_toxic.

    Rows without `before` are words: ordinary, toxic and pooled are the different preceding words in each class and in both,
    n_ordinary and n_toxic the occurrences. Where the toxic share of the documents is given, there are also rows of the pairs of
    which a class keeps mass, with their occurrences.
    """
    def read(batches):
        run, held = [], 0

        def flush():
            word, before, toxic = (np.concatenate(x) for x in zip(*run, strict=True))
            order = np.lexsort((before, word))
            word, before, toxic = word[order], before[order], toxic[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
            starts = np.flatnonzero(new)
            n_toxic = np.add.reduceat(toxic.astype(np.int64), starts)
            columns = [word[starts], before[starts], np.diff(np.append(starts, len(word))) - n_toxic, n_toxic]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["word", "before", "n_ordinary", "n_toxic"])

        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for n, words, firsts in word_hashes(batch.column(0)):
                cls = np.repeat(label[at : at + n], np.diff(firsts))
                run.append((words, words_before(words, firsts), cls > 0))
                held += len(words)
                at += n
                if held >= _RUN:
                    yield flush()
                    run, held = [], 0
        if held:
            yield flush()

    times = [F.sum(c).alias(c) for c in ("n_ordinary", "n_toxic")]
    pairs = labelled.select("text", "toxic").mapInArrow(read, "word long, before long, n_ordinary long, n_toxic long").groupBy("word", "before").agg(*times)
    none = F.lit(None).cast("long")
    rows = F.array(none)
    if toxic_share is not None:
        kept = [x > 0 for x in pair_mass(toxic_share).values()]
        rows = F.when((F.col("before") != 0) & (kept[0] | kept[1]), F.array(none, F.col("before"))).otherwise(rows)
    return pairs.withColumn("before", F.explode(rows)).groupBy("word", "before").agg(
        F.count_if(F.col("n_ordinary") > 0).alias("ordinary"), F.count_if(F.col("n_toxic") > 0).alias("toxic"), F.count("*").alias("pooled"), *times)


def pair_mass(toxic_share: float) -> dict:
    """What each class keeps of a pair's n_ordinary and n_toxic."""
    both = F.col("n_ordinary") + F.col("n_toxic")
    kept = lambda c, share: F.greatest(F.col(f"n_{c}") - EXCESS * share * both - DISCOUNT, F.lit(0.0))
    return {"ordinary": kept("ordinary", 1 - toxic_share), "toxic": kept("toxic", toxic_share)}


class Ratios:
    """log P(w | toxic) - log P(w | ordinary): `base` for a word of which no class keeps mass, and what any other has above it.

    Where `paired`, before_name of the word before and pair_name of both add what they have. The hot_words most frequent names are
    in arrays; the others, if there are any, in the table `rest` (word, above), of which `bits` has a bit for each by the first
    bits of a hash.
    """

    def __init__(self, base: float, words: np.ndarray, above: np.ndarray, rest: DataFrame | None = None, paired: bool = False) -> None:
        self.base, self.rest, self.bits, self.paired = base, rest, None, paired
        order = np.argsort(words)
        self.words, self.above = words[order], above[order]
        if rest is not None:
            place = F.shiftrightunsigned("word", 64 - _BITS) + 1
            held = rest.select(place.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
            packed = np.zeros(((1 << _BITS) // 32768, 4096), np.uint8)
            for r in held.collect():  # 4 KB each, the filter's size at most
                packed[r["n"] - 1] = np.frombuffer(r["bits"], np.uint8)
            self.bits = packed.ravel()


class Lookup:
    """What tasks need of Ratios."""

    def __init__(self, ratios: Ratios) -> None:
        self.words, self.above, self.bits, self.paired = ratios.words, ratios.above, ratios.bits, ratios.paired
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._place(self.words)] = True

    @staticmethod
    def _place(words: np.ndarray) -> np.ndarray:
        return (words.view(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)

    def names(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(names to look up, text of each): the words, and where the model has pairs also the words before and the pairs."""
        texts = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        if not self.paired:
            return words, texts
        before = words_before(words, firsts)
        inner = before != 0
        return np.concatenate([words, before_name(before[inner]), pair_name(before[inner], words[inner])]), np.concatenate([texts, texts[inner], texts[inner]])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices of words in the arrays, what they have above the base, indices of words that may be in the rest)."""
        place = self._place(words)
        at = np.flatnonzero(self.maybe[place])
        slot = np.minimum(np.searchsorted(self.words, words[at]), max(0, len(self.words) - 1))
        known = self.words[slot] == words[at] if len(at) else np.zeros(0, bool)
        other = np.zeros(0, np.int64)
        if self.bits is not None:
            other = np.flatnonzero((self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            other = np.setdiff1d(other, at[known], assume_unique=True)
        return at[known], self.above[slot[known]], other


def log_ratios(counts: DataFrame, hot_words: int = HOT_WORDS, toxic_share: float = 0.0) -> Ratios | None:
    """Ratios from class_counts, which is read several times; None without a count in each class."""
    exact = lambda c: F.sum(c.cast("decimal(38,18)")).cast("double")  # noqa: E731  the same in any order
    classes = ("ordinary", "toxic")
    singles = counts.filter("before is null")
    total = singles.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*classes, "pooled")]).first()
    if not total["ordinary"] or not total["toxic"]:
        return None
    share = F.col("pooled") / F.lit(float(total["pooled"]))
    own = {c: F.greatest(F.col(c) - EXCESS * total[c] * share - DISCOUNT, F.lit(0.0)) for c in classes}
    kept = singles.select("word", "pooled", *[x.alias(c) for c, x in own.items()])
    some = kept.filter((F.col("ordinary") > 0) | (F.col("toxic") > 0))
    sums = some.agg(*[F.coalesce(exact(F.col(c)), F.lit(0.0)).alias(c) for c in own], F.count("*").alias("n")).first()
    left = {c: 1 - sums[c] / total[c] for c in own}
    base = float(np.log(left["toxic"] / left["ordinary"]))
    chance = {c: F.col(c) / total[c] + left[c] * share for c in own}
    rated = some.select("word", "pooled", (F.log(chance["toxic"] / chance["ordinary"]) - base).alias("above"))
    pairs = stash(counts.filter("before is not null").select("word", "before", (F.col("n_ordinary") + F.col("n_toxic")).alias("pooled"), *[x.alias(f"own_{c}") for c, x in pair_mass(toxic_share).items()]))
    n_pairs = pairs.count()
    if n_pairs:
        rated = stash(rated.unionByName(_rated_pairs(pairs, singles, kept.select("word", *[x.alias(f"chance_{c}") for c, x in chance.items()]))))
    arrays = lambda t: [t.column(c).to_numpy() for c in ("word", "above")]
    paired = n_pairs > 0
    if (rated.count() if paired else sums["n"]) <= hot_words:
        return Ratios(base, *arrays(rated.select("word", "above").toArrow()), paired=paired)
    hot = rated.orderBy(F.desc("pooled"), "word").limit(hot_words).toArrow()
    rest = rated
    if hot_words:
        pooled, word = hot.column("pooled")[-1].as_py(), hot.column("word")[-1].as_py()
        rest = rated.filter((F.col("pooled") < pooled) | ((F.col("pooled") == pooled) & (F.col("word") > word)))
    return Ratios(base, *arrays(hot), stash(rest.select("word", "above")), paired)


def _rated_pairs(pairs: DataFrame, singles: DataFrame, chances: DataFrame) -> DataFrame:
    """(word, pooled, above) by name: of words before others the ratio of what the classes have left, of pairs what they have beyond that
    and their word's own ratio.
    """
    classes = ("ordinary", "toxic")
    taken = pairs.groupBy("before").agg(F.sum("pooled").alias("seen"), *[F.sum(F.col(f"own_{c}").cast("decimal(38,18)")).cast("double").alias(f"sum_{c}") for c in classes])
    times = singles.select(F.col("word").alias("before"), *[F.col(f"n_{c}") for c in classes])
    left = taken.join(times, "before").select("before", "seen", *[F.col(f"n_{c}") for c in classes], *[
        F.when(F.col(f"n_{c}") > 0, 1 - F.col(f"sum_{c}") / F.col(f"n_{c}")).otherwise(1.0).alias(f"left_{c}") for c in classes])
    chance = {c: F.when(F.col(f"n_{c}") > 0, F.col(f"own_{c}") / F.col(f"n_{c}")).otherwise(0.0) + F.col(f"left_{c}") * F.col(f"chance_{c}") for c in classes}
    shift = F.log(F.col("left_toxic") / F.col("left_ordinary"))
    known = F.log(F.col("chance_toxic") / F.col("chance_ordinary"))
    name = F.shiftleft("before", 17).bitwiseOR(F.shiftrightunsigned("before", 47)).bitwiseXOR(F.col("word"))
    before = left.select(F.bitwise_not("before").alias("word"), F.col("seen").alias("pooled"), shift.alias("above"))
    return before.unionByName(pairs.join(left, "before").join(chances, "word").select(
        name.alias("word"), "pooled", (F.log(chance["toxic"] / chance["ordinary"]) - known - shift).alias("above")))


def mean_ratios(docs: DataFrame, ratios: Ratios, keep: list[str]) -> DataFrame:
    """The kept columns with `ratio`, the length-normalised log-likelihood ratio."""
    text, row, total, words, rare, row_of, word, times, more = fresh(docs, "tox_text", "tox_row", "tox_sum", "tox_words", "tox_rare", "tox_row_of", "tox_word", "tox_times", "tox_more")
    rows = docs.select(*[quoted(c) for c in keep], F.col("text").alias(text))
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(ratios))
    asks = ratios.rest is not None
    pair = pa.struct([("word", pa.int64()), ("times", pa.int64())])

    def read(batches):
        for batch in batches:
            sums, sizes, lists = [np.zeros(0)], [np.zeros(0, np.int64)], []
            for n, found, firsts in word_hashes(batch.column(batch.num_columns - 1)):
                asked, doc = shared.value.names(found, firsts)
                at, above, other = shared.value.find(asked)
                sums.append(np.bincount(doc[at], above, n))
                sizes.append(np.diff(firsts))
                if asks:
                    other = other[np.argsort(doc[other], kind="stable")]
                    bounds = np.searchsorted(doc[other], np.arange(n + 1))
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                        names, times = np.unique(asked[other[a:b]], return_counts=True)
                        lists.append([{"word": w, "times": t} for w, t in zip(names.tolist(), times.tolist(), strict=True)])
            out = [pa.array(np.concatenate(sums), pa.float64()), pa.array(np.concatenate(sizes), pa.int64())]
            if asks:
                out.append(pa.array(lists, pa.list_(pair)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], total, words, *([rare] if asks else [])])

    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema][:-1] + [T.StructField(total, T.DoubleType()), T.StructField(words, T.LongType())]
    if asks:
        fields.append(T.StructField(rare, T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("times", T.LongType())]))))
    rated, above = rows.mapInArrow(read, T.StructType(fields)), F.col(total)
    if asks:
        rated = stash(rated.withColumn(row, F.monotonically_increasing_id()))
        asked = rated.select(F.col(row).alias(row_of), F.explode(rare).alias(rare)).select(row_of, F.col(f"{rare}.word").alias(word), F.col(f"{rare}.times").alias(times))
        found = asked.join(ratios.rest.hint("merge"), F.col(word) == F.col("word"))
        extra = found.groupBy(row_of).agg(F.sum((F.col(times) * F.col("above")).cast("decimal(38,18)")).cast("double").alias(more))
        rated = rated.join(extra, F.col(row) == F.col(row_of), "left")
        above = above + F.coalesce(F.col(more), F.lit(0.0))
    ratio = F.when(F.col(words) > 0, ratios.base + above / F.col(words)).otherwise(0.0)
    return rated.select(*[quoted(c) for c in keep], ratio.alias("ratio"))


def cutoff(ratios: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(cut, slope) of the logistic curve: the middle of the widest gap among cuts of fewest errors."""
    order = np.argsort(ratios, kind="stable")
    x, y = ratios[order], toxic[order] > 0
    edges = np.concatenate([[x[0] - 1e-3], (x[1:] + x[:-1]) / 2, [x[-1] + 1e-3]])
    gap = np.concatenate([[0.0], np.diff(x), [0.0]])
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(~y)])[-1] - np.concatenate([[0], np.cumsum(~y)])
    errors = np.where(np.concatenate([[True], np.diff(x) > 0, [True]]), errors, len(x) + 1)
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(gap[best])]
    return float(edges[at]), 4 / max(float(np.std(x)), 1e-6)


class Model:
    def __init__(self, ratios: Ratios | None, cut: float = 0.0, slope: float = 1.0) -> None:
        self.ratios, self.cut, self.slope = ratios, cut, slope


def fit(docs: DataFrame, labels: DataFrame, hot_words: int = HOT_WORDS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): all that may be learned from. A fifth by hash is kept for the cutoff."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # a hint keeps the plan alike at every size; the filter leaves little more than the labelled texts to shuffle
    rows = prefilter(docs.select("doc_id", "text"), F.col("doc_id"), known, F.col("doc_id")).join(known.hint("merge"), "doc_id")
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    toxic_share = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    ratios = log_ratios(stash(class_counts(rows.filter(~aside), toxic_share)), hot_words, toxic_share)
    if ratios is None:
        return Model(None)
    held = mean_ratios(rows.filter(aside), ratios, ["doc_id", "toxic"]).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CALIBRATION_ROWS).select("ratio", "toxic").toArrow()
    if held.num_rows == 0:
        return Model(ratios)
    return Model(ratios, *cutoff(held.column("ratio").to_numpy(), held.column("toxic").to_numpy()))


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with score, 0 to 1, and predicted."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted", "ratio")]
    if model.ratios is None:
        return docs.select(*[quoted(c) for c in keep], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    rated = mean_ratios(docs, model.ratios, keep)
    score = 1 / (1 + F.exp(-(F.col("ratio") - model.cut) * model.slope))
    return rated.select(*[quoted(c) for c in keep], score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
