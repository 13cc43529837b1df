"""Phrase collocation mining after Toivonen: a sample proposes phrases, a full pass counts them with their negative border, and border phrases that turn out frequent are expanded until the set is closed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Sieve, broadcast_if_small, hot_split, materialise, pieces, seeded_bits, table

#: Words of a phrase at most; occurrences that make a phrase a candidate; phrases listed of each language.
WORDS, FREQUENT, TOP = 4, 30, 2000
#: A longer candidate with at least this percentage of a phrase's occurrences hides it; what the score is multiplied by.
HIDES, SCALE = 80, 2_000_000
#: The sample holds one document in SAMPLE, by a seeded hash; a phrase is proposed if it occurs there at least half as often as FREQUENT occurrences would on average.
SAMPLE, SEED = 8, 13
#: A-Z to lower case, ends of pieces to newlines, white space between words to a blank.
_TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n\n\n\n\n\n\n\n\n ")
#: Bytes of texts that are counted together, and rows of one batch of counted phrases.
_PIECE, _STEP = 2 << 20, 1 << 16


def chained(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of phrases from the hashes of their words, first words first. Sieves are asked with it."""
    h = words[0]
    for w in words[1:]:
        h = h * np.uint64(0x9E3779B97F4A7C15) + w
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
    return h


def words_of(texts: list[str | None], langs: list[str]) -> tuple[np.ndarray, list[tuple[str, bytes]]]:
    """Numbers of all words of the texts in order, with -1 at the end of each piece, and the (lang, word) that each number stands for."""
    known: dict[str, dict[bytes, int]] = {}
    names: list[tuple[str, bytes]] = []
    out: list[int] = []
    for text, lang in zip(texts, langs, strict=True):
        own = known.setdefault(lang, {})
        for piece in (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n"):
            for w in piece.split(b" "):
                if w:
                    i = own.get(w)
                    if i is None:
                        i = own[w] = len(names)
                        names.append((lang, w))
                    out.append(i)
            out.append(-1)
    return np.array(out, np.int64), names


def word_hashes(names: list[tuple[str, bytes]]) -> np.ndarray:
    seeds = {lang: xxhash.xxh64_intdigest(lang) for lang, _ in names}
    return np.array([xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in names], np.uint64)


class Places:
    """Where phrases of n words begin in a row of words, and which of them a pass counts, as booleans for each place."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray):
        self.ids = np.concatenate([ids, np.full(WORDS, -1)])
        self.inside = [np.zeros(0, bool), ids >= 0]
        own = hashes[self.ids]  # a piece's end takes any word's hash, and is outside anyway
        self.keys = [own[:0], own[: len(ids)]]
        for n in range(2, WORDS + 1):
            self.inside.append(self.inside[-1] & (self.ids[n - 1 : len(ids) + n - 1] >= 0))
            self.keys.append(chained([own[k : k + len(ids)] for k in range(n)]))

    def held(self, n: int, sieve: Sieve) -> np.ndarray:
        return self.inside[n] & sieve.may_hold(self.keys[n].view(np.int64))

    def longer(self, n: int, parts: np.ndarray) -> np.ndarray:
        """Places of phrases of n words whose first and last n - 1 words are at one of `parts`."""
        return self.inside[n] & parts & np.append(parts[1:], False)

    def first(self, proposed: Sieve | None, longest: int = WORDS) -> list[np.ndarray]:
        """What the first full pass counts, by length: all words, and phrases whose first and last words (but one) are proposed: the proposed ones and their negative border."""
        return [self.inside[0], self.inside[1], *(self.longer(n, self.held(n - 1, proposed)) for n in range(2, longest + 1))]

    def second(self, proposed: Sieve, frequent: Sieve) -> list[np.ndarray]:
        """What the second full pass counts: phrases that the first found frequent; and its expansion: phrases not counted before whose first and last words (but one) are frequent, or not counted before either
        and of such parts in turn."""
        before = self.first(proposed)
        may = self.held(1, frequent)
        out = [self.inside[0], may]
        for n in range(2, WORDS + 1):
            may = np.where(before[n], self.held(n, frequent), self.longer(n, may))
            out.append(may)
        return out

    def count(self, n: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct phrases of n words at the given places, as rows of word numbers, and their counts."""
        at = np.flatnonzero(where)
        _, first, inverse, f = np.unique(self.keys[n][at], return_index=True, return_inverse=True, return_counts=True)
        if any((self.ids[at + k] != self.ids[at[first] + k][inverse]).any() for k in range(n)):  # two phrases of one hash
            return np.unique(self.ids[at[:, None] + np.arange(n)], axis=0, return_counts=True)
        return self.ids[at[first][:, None] + np.arange(n)], f


def _hashed(lengths: tuple[int, ...], proposed=None):
    """(lang, text) rows to (key, f), a row for each hash of a phrase of a piece, for what Places.first() says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", _PIECE):
            ids, names = words_of(b.column("text").to_pylist(), b.column("lang").to_pylist())
            if names:
                places = Places(ids, word_hashes(names))
                where = places.first(proposed and proposed.value, max(lengths))
                for n in lengths:
                    keys, f = np.unique(places.keys[n][where[n]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(f.astype(np.int64))], names=["key", "f"])

    return run


def _spelled(proposed, frequent):
    """(lang, text) rows to (lang, len, phrase, f), a row for each phrase of a piece, for what Places.second() says. The words of a piece and language come as len 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", _PIECE):
            ids, names = words_of(b.column("text").to_pylist(), b.column("lang").to_pylist())
            if not names:
                continue
            total: dict[str, int] = {}
            for i, k in zip(*(x.tolist() for x in np.unique(ids[ids >= 0], return_counts=True)), strict=True):
                total[names[i][0]] = total.get(names[i][0], 0) + k
            yield _batch(list(total), 0, [b""] * len(total), list(total.values()))
            places = Places(ids, word_hashes(names))
            where = places.second(proposed.value, frequent.value)
            texts = [w for _, w in names]
            for n in range(1, WORDS + 1):
                rows, f = places.count(n, where[n])
                for lo in range(0, len(rows), _STEP):
                    part = rows[lo : lo + _STEP]
                    columns = [[texts[i] for i in part[:, k].tolist()] for k in range(n)]
                    phrases = columns[0] if n == 1 else list(map(b" ".join, zip(*columns, strict=True)))
                    yield _batch([names[i][0] for i in part[:, 0].tolist()], n, phrases, f[lo : lo + _STEP])

    return run


def _batch(langs, n: int, phrases: list[bytes], f) -> pa.RecordBatch:
    text = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([n] * len(phrases), pa.int32()), text, pa.array(f, pa.int64())], names=["lang", "len", "phrase", "f"])


def _keys(docs: DataFrame, lengths: tuple[int, ...], least: int, proposed=None) -> DataFrame:
    """Hashes of phrases whose phrases together occur at least `least` times, written; counts are summed in each task before they are shuffled."""
    found = docs.mapInArrow(_hashed(lengths, proposed), "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
    return materialise(found.where(F.col("f") >= least).select("key"), "collocations-keys")


def frequent_phrases(docs: DataFrame, least: int = FREQUENT, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(lang, len, phrase, f): all phrases of 1 to WORDS words that occur at least `least` times in their language, counted exactly; and for each language a row of len 0, whose f is the number of its words.

    One document in `sample` proposes a set S of phrases. A pass over all documents counts every word, and each phrase whose first and last len - 1 words are in S: S and, as far as it occurs,
    its negative border. It counts by 64-bit hashes, which narrow the rows: what isn't frequent by the sum of its hash isn't frequent. The second pass counts again what is left, by the phrases themselves;
    and where a phrase of the border has turned out frequent, so that longer ones were never counted, it expands: it counts phrases not counted yet whose first and last len - 1 words are frequent,
    or have not been counted either and are of such parts in turn. No frequent phrase is outside of that, so the expansion closes the set.

    Whether a phrase is in S, or frequent, is asked of sieves of bounded size, which may say yes too often, never no too often; then more is counted, and exactly as well.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", *[F.col(c).alias("_id") for c in ("doc_id",) if c in docs.columns])
    chosen = seeded_bits(seed, *[F.col(c) for c in docs.columns if c == "_id"], F.xxhash64("text")) % sample == 0
    part = materialise(docs.where(chosen).select("lang", "text"), "collocations-sample")
    docs, send = docs.select("lang", "text"), docs.sparkSession.sparkContext.broadcast
    enough = max(1, round(least / (2 * sample)))
    tried = _keys(part, (1,), enough)
    for n in range(2, WORDS):  # level by level: what can't be frequent in the sample isn't counted there
        tried = tried.unionByName(_keys(part, (n,), enough, send(Sieve.of(tried, "key"))))
    proposed = send(Sieve.of(tried, "key"))
    frequent = send(Sieve.of(_keys(docs, tuple(range(1, WORDS + 1)), least, proposed), "key"))
    found = docs.mapInArrow(_spelled(proposed, frequent), "lang string, len int, phrase string, f long").groupBy("lang", "len", "phrase").agg(F.sum("f").alias("f"))
    return materialise(found.where((F.col("f") >= least) | (F.col("len") == 0)), "collocations-found")


def _part(start: str, length: str) -> str:
    return f"array_join(slice(words, {start}, {length}), ' ')"


def collocations(docs: DataFrame, least: int = FREQUENT, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """The first `top` phrases of each language by score: (lang, rank, phrase, a, l, r, n, score).

    A candidate has 2 to WORDS words and occurs a >= least times in its language (null: und). Each cut into a first part, found l times, and a rest, found r times, scores
    floor(SCALE * a / (l + r)); the lowest counts, of the shortest first part among equals. Candidates inside a longer one with at least HIDES percent of their occurrences are left out.
    Null and empty texts have no words; texts are read whole, however long; repeated rows count each. Other columns are ignored. An empty table has no rows.

    Counts are exact in decimals of 38 digits. Parts of candidates meet their counts by a join: the hottest parts, fewer than common.HOT_PARTS, by broadcast. Lists are cut in spans of each language first, so
    no task sorts all candidates of a language.
    """
    counts = frequent_phrases(docs, least, sample)
    known = counts.where("len > 0").select("lang", F.col("phrase").alias("part"), "f")
    found = counts.where("len > 1").select("lang", "phrase", "len", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = found.select("lang", "phrase", "a", "words", "len", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.expr(_part("1", "k")).alias("part")), F.struct(F.lit("r").alias("side"), F.expr(_part("k + 1", "len - k")).alias("part")))
    parts = materialise(cuts.select("lang", "phrase", "a", "k", F.inline(sides)), "collocations-parts")
    hot = materialise(hot_split(parts.groupBy("lang", "part").agg(F.count("*").alias("n")), parts.count())[0].select("lang", "part"), "collocations-hot")
    few = known.join(F.broadcast(hot), ["lang", "part"], "left_semi")
    met = parts.join(F.broadcast(few), ["lang", "part"]).unionByName(parts.join(F.broadcast(hot), ["lang", "part"], "left_anti").join(known, ["lang", "part"]))
    of = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("f"))).alias(f"{side}{k}")
    wide = met.groupBy("lang", "phrase", "a").agg(*[of(side, k) for side in "lr" for k in range(1, WORDS)])
    score = lambda k: F.expr(f"cast(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0))) as bigint)")
    each = F.array_compact(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, WORDS)]))
    scored = wide.select("lang", "phrase", "a", F.array_min(each).alias("best"))
    inner = F.expr("flatten(transform(sequence(2, len - 1), m -> transform(sequence(1, len - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    within = found.where("len > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = scored.join(within, ["lang", "phrase"], "left").where(f"_longer is null or cast(_longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {HIDES}")
    left = materialise(left.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "collocations-scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spans = max(1, int((left.count() / top) ** 0.5))
    first = left.withColumn("_span", F.pmod(F.xxhash64("phrase"), F.lit(spans)))
    first = first.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_span").orderBy(*order))).where(F.col("_place") <= top).drop("_place", "_span")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("len = 0").select("lang", F.col("f").alias("n"))
    return best.join(broadcast_if_small(sizes, sizes.count(), 64), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


SQL = {
    "op13_collocations": rf"""
with pieces as (select doc_id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece
  from (select doc_id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents)),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
places as (select lang, words, unnest(range(1, len(words) + 1)) as i from worded),
grams as (select lang, m as len, array_to_string(words[i:i + m - 1], ' ') as phrase from places, (values (1), (2), (3), (4)) t(m) where i + m - 1 <= len(words)),
counts as (select lang, len, phrase, count(*) as f from grams group by all having count(*) >= {FREQUENT}),
sizes as (select lang, count(*) as n from grams where len = 1 group by lang),
found as (select lang, len, phrase, f as a, string_split(phrase, ' ') as words from counts where len > 1),
cuts as (select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, ({SCALE}::hugeint * c.a) // (x.f + y.f) as score
  from (select *, unnest(range(1, len)) as k from found) c
  join counts x on x.lang = c.lang and x.phrase = array_to_string(words[1:k], ' ') join counts y on y.lang = c.lang and y.phrase = array_to_string(words[k + 1:], ' ')),
scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
starts as (select lang, len, words, a, m, unnest(range(1, len - m + 2)) as i from found, (values (2), (3)) t(m) where m < len),
within as (select lang, array_to_string(words[i:i + m - 1], ' ') as phrase, max(a) as longer from starts group by all),
kept as (select s.* from scored s left join within w using (lang, phrase) where w.longer is null or 100::hugeint * w.longer < {HIDES}::hugeint * s.a)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from kept k join sizes using (lang) qualify rank <= {TOP}
"""
}
