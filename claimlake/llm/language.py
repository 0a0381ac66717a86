"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text answers how far a text can be followed as a piece of that sample.
Parsing a text greedily into longest matches gives phrases; few long phrases mean a familiar language. Phrases times log2
of the sample's length, per letter, is the entropy estimate; the least one wins.

The model is fitted on a bounded sample: at most SAMPLE_DOCS labelled texts per language, in the order of a hash of their
id, at most SAMPLE_CHARS characters of each, and MODEL_CHARS characters of all languages together, in equal shares. Texts are
predicted whole, cut into stretches of STRETCH letters that are parsed each by itself and at the same time.

Every letter of the sample is told apart: the commonest have a column of the transition table, the others' transitions are looked
up in a sorted list. Letters that no sample has match nothing. Letters are lower-cased; all else counts as one space. Nulls: null text, and text without a letter, is `und` with score 0;
rows of null lang or text are not learned from. Ties go to the first language by name. Without any labelled text all are
`und`. Repeated rows are predicted alike. Empty tables give empty results; columns of the output's names are replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.llm.common import fresh, quoted

SAMPLE_DOCS, SAMPLE_CHARS, MODEL_CHARS = 128, 2000, 1 << 18
STRETCH = 256
#: Letters with a column of the table; the transitions of rarer ones are kept in a list.
_LETTERS = 94
_FOREIGN, _SPACE = 0, 1
_SLICE_CHARS = 1 << 20


@lru_cache(1)
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Automaton:
    """Suffix automaton of one sequence, as a table: state, letter -> next state and phrases ended (two low bits).

    Letters from `width` on have no column: `edges` holds their (state, letter, next state) and `restart` where they begin a phrase.
    """

    def __init__(self, letters: list[int], width: int, all_letters: int) -> None:
        to, link, length, last = [{}], [-1], [0], 0
        for c in letters:
            now = len(to)
            to.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = now
                p = link[p]
            if p >= 0:
                q = to[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(to)
                    to.append(dict(to[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and to[p].get(c) == q:
                        to[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        first = to[0]
        restart = np.array([(first[c] << 2) | 1 if c in first else 2 for c in range(all_letters)], np.int32)
        self.restart = restart
        self.table = np.tile(restart[:width], (len(to), 1))
        rare = []
        for state, edges in enumerate(to):
            for c, target in edges.items():
                if c < width:
                    self.table[state, c] = target << 2
                else:
                    rare.append((state, c, target))
        self.edges = np.array(rare, np.int64).reshape(-1, 3)
        self.table[0, [c for c in range(width) if c not in first]] = 1
        self.size = max(2, len(letters))


class Model:
    """Automata of all languages over one alphabet, in one table."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        lower = lambda c: c.lower() if len(c.lower()) == 1 else c
        forms = Counter(c for s in samples.values() for c in s if c.isalpha())
        seen = Counter()
        for c, n in forms.items():
            seen[lower(c)] += n
        kept = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        code = {c: i + 2 for i, c in enumerate(sorted(kept[:_LETTERS]) + kept[_LETTERS:])}
        self.codes = np.where(_alphabetic(), _FOREIGN, _SPACE).astype(np.min_scalar_type(len(kept) + 2))
        for form, c in [*((c.upper(), c) for c in sorted(kept)), *((c, lower(c)) for c in forms), *((c, c) for c in kept)]:
            if len(form) == 1:
                self.codes[ord(form)] = code[c]
        self.width, self.all_letters = min(len(kept), _LETTERS) + 2, len(kept) + 2
        parts, keys, targets, restarts, self.start, self.bits, at = [], [], [], [], [], [], 0
        for name in self.names:
            one = Automaton(self.letters(samples[name]).tolist(), self.width, self.all_letters)
            parts.append(one.table + np.int32(at << 2))
            keys.append((one.edges[:, 0] + at) * self.all_letters + one.edges[:, 1])
            targets.append(((one.edges[:, 2] + at) << 2).astype(np.int32))
            restarts.append(one.restart + np.int32(at << 2))
            self.start.append(at)
            self.bits.append(np.log2(one.size))
            at += len(one.table)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.targets = self.keys[order], np.concatenate(targets)[order] if targets else np.zeros(0, np.int32)
        self.restarts = np.array(restarts, np.int32).reshape(len(self.names), self.all_letters)

    def letters(self, text: str) -> np.ndarray:
        codes = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
        return codes[keep]

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Table entries of (language, stretch) states at each stretch's letter."""
        rare = np.flatnonzero(letter >= self.width)
        if not len(rare):
            return self.table[state.astype(np.int64) * self.width + letter]
        out = self.table[state.astype(np.int64) * self.width + np.where(letter < self.width, letter, _FOREIGN)]
        from_, c = state[:, rare], letter[rare].astype(np.int64)
        key = from_.astype(np.int64) * self.all_letters + c
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        again = self.restarts[:, c]
        again = again - ((again & 2) >> 1) * (from_ == np.array(self.start, np.int32)[:, None])  # at the root no phrase is open
        out[:, rare] = np.where(self.keys[place] == key, self.targets[place], again)
        return out

    def rates(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) bits a letter; infinite without letters."""
        coded = [self.letters(t) for t in texts]
        sizes = np.array([len(c) for c in coded])
        flat = np.concatenate(coded) if coded else np.zeros(0, np.uint8)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + part * STRETCH
        length = np.minimum(STRETCH, np.repeat(sizes, pieces) - part * STRETCH)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(STRETCH), "left")  # stretches longer than t
        root = np.array(self.start, np.int32)[:, None]
        state = np.repeat(root, len(begin), axis=1)
        ended = np.zeros(state.shape, np.int32)
        for t in range(int(length.max(initial=0))):
            n = active[t]
            step = self.step(state[:, :n], flat[begin[:n] + t])
            ended[:, :n] += step & 3
            state[:, :n] = step >> 2
        ended += state != root
        out = np.empty((len(texts), len(self.names)))
        has = np.array([bool((c != _SPACE).any()) for c in coded], bool)
        for k in range(len(self.names)):
            out[:, k] = np.bincount(owner, ended[k], len(texts)) * self.bits[k] / np.maximum(sizes, 1)
        out[~has] = np.inf
        return out


def sample(labelled: DataFrame) -> dict[str, str]:
    """Bounded training text per language from labelled rows (doc_id, text, lang)."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    ids = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    picked = ids.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_DOCS).collect()
    texts = defaultdict(list)
    for r in sorted(picked, key=lambda r: (r["lang"], r["nth"])):
        texts[r["lang"]].append(r["text"])
    share = MODEL_CHARS // max(1, len(texts))
    return {lang: "\n".join(dict.fromkeys(held))[:share] for lang, held in texts.items()}


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with lang_pred and score: how far the best language is from the next, 0 to 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    text, = fresh(docs, "id_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[quoted(c) for c in keep], F.col("text").alias(text))
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema][:-1] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        known = shared.value
        for batch in batches:
            said = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            names, scores = [], []
            at = 0
            while at < len(said):
                end, held = at + 1, len(said[at])
                while end < len(said) and held + len(said[end]) <= _SLICE_CHARS:
                    held += len(said[end])
                    end += 1
                for row in known.rates(said[at:end]) if known.names else [[]] * (end - at):
                    if not len(row) or np.isinf(row[0]):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    rest = np.delete(row, best)
                    names.append(known.names[best])
                    scores.append(float(1 - row[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(predict, out)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
