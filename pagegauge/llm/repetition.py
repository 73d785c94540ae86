"""Repetition inside one document: the share of repeated words, and a Kneser-Ney language model.

``repeated_share`` follows the plain rule of the problem: the share of the words of the main body
that stand in a run of five words or more, or in a sentence, that came before in the same field.

``corpus_perplexities`` counts all n-grams with Spark, fits a modified Kneser-Ney model for each
language and prices the texts with it.  Texts are read once, in chunks: a chunk keeps for each token
the place of its trigram among the chunk's different trigrams, which go, a few bytes each, to the
bucket of their middle word.  There the trigrams of all chunks meet as sorted arrays of hashes, with
all that share their context or their bigram, are priced by binary search, and only their prices go
back to the chunks.  Common words have ``SPLIT`` buckets each, by the word before.  Bigrams and words,
of which there are far fewer, are priced by equi-joins.

An n-gram seen once was seen in the text itself only: below ``MIN_COUNT``, which is the same for
every size of the table, the back-off prices it, and the probability it leaves is given back there,
so that each context's probabilities sum to 1.  ``fit_kneser_ney`` holds the model of few documents
in memory, in sorted arrays, for other texts.  ``perplexity_bands`` rejects the documents outside
their language's band: broken generation and copies of a phrase have a very low perplexity per word,
junk a very high one.

Defined results: NULL and empty fields have no share and are no cases; equal rows give one result (the
counts of n-grams are of all rows, copies too); n-grams do not cross documents.
"""

from __future__ import annotations

import itertools
import marshal
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.markup import clean_blocks
from pagegauge.llm.quality import LineModel, is_not_prose
from pagegauge.session import cut_lineage

PHRASE = 5
CASE_SHARE = 0.4

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE_END = re.compile(r"(?<=[.!?…。！？])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def repeated_words(paragraphs: list[str], phrase: int = PHRASE) -> tuple[int, int]:
    """(words that repeat an earlier phrase or sentence, all words)."""
    words: list[str] = []
    sentences: list[tuple[int, int]] = []
    for p in paragraphs:
        for sentence in _SENTENCE_END.split(p):
            found = words_of(sentence)
            if found:
                sentences.append((len(words), len(words) + len(found)))
                words.extend(found)
    n = len(words)
    marked = bytearray(n)
    seen: set[tuple[str, ...]] = set()
    if n >= phrase:
        ones = b"\x01" * phrase
        for at, gram in enumerate(zip(*(words[k:] for k in range(phrase)))):
            if gram in seen:
                marked[at : at + phrase] = ones
            else:
                seen.add(gram)
    short: set[tuple[str, ...]] = set()
    for a, b in sentences:
        if b - a < phrase:
            key = tuple(words[a:b])
            if key in short:
                marked[a:b] = b"\x01" * (b - a)
            else:
                short.add(key)
    return sum(marked), n


def field_paragraphs(text: str, html: bool) -> list[str]:
    return [value for kind, value in clean_blocks(text, html) if kind != "formula"]


def repetition_shares(docs: DataFrame, model: LineModel) -> DataFrame:
    """(fixture_id, field_name, n_words, n_repeated, share, is_case) of both fields; markdown that is not prose is left out."""

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for fixture_id, html, markdown in zip(part["fixture_id"], part["html"], part["markdown"]):
                for name, text in (("html", html), ("markdown", markdown)):
                    if not text or (name == "markdown" and is_not_prose(text, model)):
                        continue
                    repeated, n = repeated_words(field_paragraphs(text, name == "html"))
                    if n:
                        rows.append((fixture_id, name, n, repeated, round(repeated / n, 6), repeated >= CASE_SHARE * n))
            yield pd.DataFrame(rows, columns=["fixture_id", "field_name", "n_words", "n_repeated", "share", "is_case"])

    return (
        docs.select("fixture_id", "html", "markdown")
        .where(F.col("fixture_id").isNotNull())
        .mapInPandas(measure, "fixture_id bigint, field_name string, n_words bigint, n_repeated bigint, share double, is_case boolean")
        .distinct()
    )


# Kneser-Ney --------------------------------------------------------------------------------------

ORDER = 3
_START, _END = "\u0002", "\u0003"
#: n-grams seen less often are left to the back-off, whatever the size of the corpus
MIN_COUNT = 2
BAND = 3.0


class SortedModel:
    """Sorted arrays of n-gram hashes with their log probabilities and back-off weights."""

    def __init__(self, keys: np.ndarray, log_p: np.ndarray, back_off: np.ndarray, unknown: dict[str, float]) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.log_p, self.back_off, self.unknown = keys[order], log_p[order], back_off[order], unknown

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability or NaN, back-off weight or 0) of each hash."""
        if not len(self.keys):
            return np.full(len(keys), np.nan), np.zeros(len(keys))
        order = np.argsort(keys)  # probes in order stay in the cache
        at = np.empty(len(keys), dtype=np.int64)
        at[order] = np.searchsorted(self.keys, keys[order])
        np.minimum(at, len(self.keys) - 1, out=at)
        hit = self.keys[at] == keys
        return np.where(hit, self.log_p[at], np.nan), np.where(hit, self.back_off[at], 0.0)

    def log_probabilities(self, unknown: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray, before_one: np.ndarray, before_two: np.ndarray) -> np.ndarray:
        """Of each word, from the hashes of the 1-, 2- and 3-gram that end in it and of the two before it."""
        out = self.find(three)[0]
        rest = np.flatnonzero(np.isnan(out))  # lower orders only where the trigram is not held
        if len(rest):
            mid = self.find(two[rest])[0]
            open_ = np.flatnonzero(np.isnan(mid))
            if len(open_):
                at = rest[open_]
                low = self.find(one[at])[0]
                mid[open_] = self.find(before_one[at])[1] + np.where(np.isnan(low), unknown[at], low)
            out[rest] = self.find(before_two[rest])[1] + mid
        return out


class _Memo(dict):
    """Word to 64-bit hash in one language; forgets all when it has grown large."""

    def __init__(self, lang: str) -> None:
        self.lang = lang

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(f"{self.lang} {word}")
        return h


class WordHashes:
    """64-bit hashes of words and n-grams, each language apart; vectorised, with a bounded memo."""

    def __init__(self) -> None:
        self.memos: dict[str, _Memo] = {}

    def words(self, lang: str, words: list[str]) -> np.ndarray:
        """Hashes of two start marks, the words and an end mark."""
        memo = self.memos.get(lang)
        if memo is None:
            memo = self.memos[lang] = _Memo(lang)
        return np.array(list(map(memo.__getitem__, (_START, _START, *words, _END))), dtype=np.uint64)

    @staticmethod
    def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Hash of a gram from the hashes of its parts (order matters)."""
        with np.errstate(over="ignore"):
            x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(32))

    def grams(self, ones: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words and end marks of the documents ``ones``: the document's number, and the hashes of
        the word, of the bigram and trigram that end in it, and of the word and the bigram before it."""
        one = np.concatenate(ones)
        number = np.repeat(np.arange(len(ones)), [len(x) for x in ones])
        inside = number[:-2] == number[2:]
        two = self.join(one[:-1], one[1:])
        three = self.join(two[:-1], one[2:])
        return number[2:][inside], one[2:][inside], two[1:][inside], three[inside], one[1:-1][inside], two[:-1][inside]


_BARE = re.compile(r"<(?:(script|style)\b.*?</\1>|[^>]*>)|\]\([^)]*\)", re.S)
_PLAIN_WORD = re.compile(r"[^\W_]+")


def document_words(text: str, common: dict[str, frozenset[str]]) -> tuple[str, list[str]]:
    """(language by its common words, words) of a field without tags and addresses."""
    words = _PLAIN_WORD.findall(_BARE.sub(" ", text).lower())
    if not common:
        return "und", words
    known = set(words)
    return max(sorted(common), key=lambda lang: len(known & common[lang])), words


def common_by_language(common_words: DataFrame) -> dict[str, frozenset[str]]:
    """The fixed table of common words."""
    known: dict[str, set[str]] = {}
    for r in common_words.where(F.col("lang").isNotNull() & F.col("word").isNotNull()).collect():
        known.setdefault(r["lang"], set()).add(r["word"].lower())
    return {lang: frozenset(words) for lang, words in known.items()}


#: fields and characters that a worker holds as arrays at once; a longer text is a chunk of its own
CHUNK, CHUNK_CHARS = 4000, 16_000_000
#: buckets of a common middle word, by the word before it
SPLIT = 16


def _fields(part: pd.DataFrame) -> Iterator[tuple[int | None, bool, str]]:
    known = part["known"] if "known" in part else itertools.repeat(True)
    for fixture_id, named, html, markdown in zip(part["fixture_id"], known, part["html"], part["markdown"]):
        fixture_id = fixture_id if named else None
        if html:
            yield fixture_id, True, html
        if markdown:
            yield fixture_id, False, markdown


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int | None, bool, str]]]:
    held, chars = [], 0
    for part in parts:
        for field in _fields(part):
            held.append(field)
            chars += len(field[2])
            if len(held) >= CHUNK or chars >= CHUNK_CHARS:
                yield held
                held, chars = [], 0
    if held:
        yield held


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(marshal.dumps([(a.dtype.str, a.tobytes()) for a in arrays]), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for kind, x in marshal.loads(zlib.decompress(data))]


def _pack_grams(w: np.ndarray, lang: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows of three word hashes as places in a list of the different words."""
    words, ids = np.unique(w, return_inverse=True)
    ids = ids.reshape(w.shape).astype(np.uint16 if len(words) < 1 << 16 else np.uint32)
    return _pack(words, ids[1], ids[0], ids[2], lang.astype(np.uint8), np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255])


def _unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, two, one, three, lang, counts, large = _unpack(data)
    counts = counts.astype(np.int64)
    counts[counts == 255] = large
    return np.stack((words[one], words[two], words[three])), lang, counts


class _Bucket:
    """The different trigrams of a bucket, with the counts of all chunks, in the order of their hashes."""

    def __init__(self, blobs: list[bytes]) -> None:
        parts = [_unpack_grams(x) for x in blobs]
        self.sizes = [len(x[1]) for x in parts]
        w = np.concatenate([x[0] for x in parts], axis=1)
        context = WordHashes.join(w[0], w[1])
        self.keys, first, self.of_entry = np.unique(WordHashes.join(context, w[2]), return_index=True, return_inverse=True)
        self.counts = np.bincount(self.of_entry, np.concatenate([x[2] for x in parts])).astype(np.int64)
        self.lang = np.concatenate([x[1] for x in parts])[first]
        self.context, self.w2, self.w3 = context[first], w[1][first], w[2][first]
        self.below = WordHashes.join(self.w2, self.w3)

    def priced(self, low_keys: np.ndarray, low_p: np.ndarray, discounts: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of each trigram, different contexts, their back-off weights); ``low_keys`` are the bigrams, sorted, with ``low_p``."""
        low = low_p[np.searchsorted(low_keys, self.below)]
        kept = self.counts >= min_count
        d = discounts[self.lang, np.minimum(self.counts, 3) - 1]
        own = self.counts - d
        contexts, of = np.unique(self.context, return_inverse=True)
        total, cut = np.bincount(of, self.counts), np.bincount(of, d)
        left, held = np.bincount(of, np.where(kept, 0.0, own)), np.bincount(of, np.where(kept, low, 0.0))
        share = cut / total
        # what the rare n-grams of a context leave goes to the words that it does not hold
        gamma = share + left / total / np.maximum(1.0 - held, 1e-9)
        return np.where(kept, own / total[of] + share[of] * low, gamma[of] * low), contexts, gamma


def read_chunks(docs: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """(chunk, bucket, data): of each chunk its texts (bucket -1) and its different trigrams, by bucket."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    langs = sorted(common) or ["und"]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        split = np.unique(np.concatenate([hashes.words(lang, sorted(words)) for lang, words in common.items()])) if common else np.zeros(0, np.uint64)
        for chunk in _chunks(parts):
            meta, ones = [], []
            for fixture_id, html, text in chunk:
                lang, words = document_words(text, common)
                if words:
                    digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    meta.append((fixture_id is not None, fixture_id or 0, html, langs.index(lang), len(words), digest))
                    ones.append(hashes.words(lang, words))
            if not meta:
                continue
            columns = [np.array(c) for c in zip(*meta)]
            whole = np.concatenate(ones)
            number = np.repeat(np.arange(len(ones)), [len(x) for x in ones])
            inside = number[:-2] == number[2:]
            w = np.stack((whole[:-2][inside], whole[1:-1][inside], whole[2:][inside]))
            _, first, of_token, counts = np.unique(hashes.join(hashes.join(w[0], w[1]), w[2]), return_index=True, return_inverse=True, return_counts=True)
            lang, w = columns[3][number[2:][inside][first]], w[:, first]
            by = np.uint64(40)
            sub = np.where(np.isin(w[1], split), (w[0] >> by) % np.uint64(SPLIT), np.uint64(0))
            bucket = ((w[1] >> by) + sub) % np.uint64(buckets)
            order = np.lexsort((w[2], w[0], w[1], bucket))
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            key = uuid.uuid4().int >> 65
            rows = [(key, -1, _pack(*columns, place[of_token]))]
            bucket, w, lang, counts = bucket[order].astype(np.int64), w[:, order], lang[order], counts[order]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for at, end in zip(starts, [*starts[1:], len(bucket)]):
                rows.append((key, int(bucket[at]), _pack_grams(w[:, at:end], lang[at:end], counts[at:end])))
            yield pd.DataFrame(rows, columns=["chunk", "bucket", "data"])

    # texts without an id are counted too; ids stay whole numbers
    rows = docs.select(F.coalesce("fixture_id", F.lit(0)).alias("fixture_id"), F.col("fixture_id").isNotNull().alias("known"), "html", "markdown")
    return rows.mapInPandas(read, "chunk bigint, bucket int, data binary")


def _discounts(rows: list, n_langs: int) -> np.ndarray:
    """The three discounts of each language from its counts of counts."""
    out = np.tile([0.5, 1.0, 1.5], (n_langs, 1))
    for lang, n1, n2, n3, n4 in rows:
        n = [n1, n2, n3, n4]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        out[lang] = [min(i - 1e-3, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
    return out


def _priced_lower(partial: DataFrame, langs: list[str], min_count: int) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(words, bigrams, probability of a word below ``min_count`` by language) with k, raw and p; bigrams with their context's weight gamma."""
    spark = partial.sparkSession
    start = WordHashes()
    marks = spark.createDataFrame([(i, int(start.words(lang, [])[:1].view(np.int64)[0])) for i, lang in enumerate(langs)], "lang int, start bigint")
    two = partial.where("what = 0").groupBy("lang", "k", "context", "below").agg(F.sum("raw").alias("raw"), F.sum("types").alias("types"))
    # bigrams at the start of a text have no word before them: they keep their counts
    at_start = F.col("context") == F.col("start")
    two = cut_lineage(two.join(F.broadcast(marks), "lang").select("lang", "k", "context", "below", "raw", F.when(at_start, F.col("raw")).otherwise(F.col("types")).alias("c")))
    one = cut_lineage(two.groupBy("lang", F.col("below").alias("k")).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("c")))
    kept = F.col("raw") >= min_count

    def discounted(grams: DataFrame) -> DataFrame:
        counts = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        rates = _discounts([tuple(r) for r in grams.groupBy("lang").agg(*counts).collect()], len(langs))  # one row for each language
        table = spark.createDataFrame([(i, *map(float, d)) for i, d in enumerate(rates)], "lang int, d1 double, d2 double, d3 double")
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        return grams.join(F.broadcast(table), "lang").withColumn("d", cut).drop("d1", "d2", "d3")

    p1 = discounted(one)
    s1 = p1.groupBy("lang").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"), F.count(F.lit(1)).alias("types"))
    own = (F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") / (F.col("types") + 1)
    one_p = p1.join(F.broadcast(s1), "lang").select("lang", "k", "raw", "gamma", "types", own.alias("p"))
    # words below min_count share what they have with one unseen word
    rare = one_p.groupBy("lang").agg(
        F.first(F.col("gamma") / (F.col("types") + 1)).alias("floor"), F.sum(F.when(kept, 0.0).otherwise(F.col("p"))).alias("left"), F.count_if(~kept).alias("n"),
    )
    unknown = {r["lang"]: (r["floor"] + r["left"]) / (r["n"] + 1) for r in rare.collect()}  # one row for each language
    table = spark.createDataFrame(list(unknown.items()) or [(0, 0.0)], "lang int, rare double")
    words = one_p.join(F.broadcast(table), "lang").select("k", "raw", F.when(kept, F.col("p")).otherwise(F.col("rare")).alias("p"))

    priced = discounted(two).join(words.select(F.col("k").alias("below"), F.col("p").alias("low")), "below")
    own = F.col("c") - F.col("d")
    sums = priced.groupBy("context").agg(
        F.sum("c").alias("total"), F.sum("d").alias("cut"),
        F.sum(F.when(kept, 0.0).otherwise(own)).alias("left"), F.sum(F.when(kept, F.col("low")).otherwise(0.0)).alias("held"),
    )
    share = F.col("cut") / F.col("total")
    weight = share + F.col("left") / F.col("total") / F.greatest(F.lit(1.0) - F.col("held"), F.lit(1e-9))
    sums = sums.select("context", "total", share.alias("share"), weight.alias("gamma"))
    p = F.when(kept, own / F.col("total") + F.col("share") * F.col("low")).otherwise(F.col("gamma") * F.col("low"))
    bigrams = priced.join(sums, "context").select("k", "raw", "context", "gamma", p.alias("p"))
    return words, cut_lineage(bigrams), {langs[i]: p for i, p in unknown.items()}


class _Fitted:
    """The chunks of a table with all that prices their trigrams."""

    def __init__(self, docs: DataFrame, common: dict[str, frozenset[str]], min_count: int) -> None:
        self.langs = langs = sorted(common) or ["und"]
        self.min_count = min_count
        self.chunks = cut_lineage(read_chunks(docs, common))
        self.grams = self.chunks.where("bucket >= 0")

        def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            b = _Bucket(list(frame["data"]))
            k, first, of = np.unique(b.below, return_index=True, return_inverse=True)
            view = lambda x: x[first].view(np.int64)
            rows = pd.DataFrame({"what": 0, "bucket": key[0], "lang": b.lang[first].astype(np.int32), "k": k.view(np.int64), "context": view(b.w2), "below": view(b.w3),
                                 "raw": np.bincount(of, b.counts).astype(np.int64), "types": np.bincount(of)})
            few = b.counts <= 4
            seen, n = np.unique(b.lang[few].astype(np.int64) * 8 + b.counts[few], return_counts=True)
            sums = pd.DataFrame({"what": 1, "bucket": key[0], "lang": seen // 8, "k": seen % 8, "context": 0, "below": 0, "raw": n, "types": 0})
            return pd.concat([rows, sums], ignore_index=True)

        schema = "what int, bucket int, lang int, k bigint, context bigint, below bigint, raw bigint, types bigint"
        partial = cut_lineage(self.grams.groupBy("bucket").applyInPandas(count, schema))
        counts: dict[int, list[int]] = {i: [0, 0, 0, 0] for i in range(len(langs))}
        for r in partial.where("what = 1").groupBy("lang", "k").agg(F.sum("raw").alias("n")).collect():  # four rows for each language
            counts[r["lang"]][r["k"] - 1] = r["n"]
        self.discounts = _discounts([(i, *n) for i, n in counts.items()], len(langs))
        self.words, self.bigrams, self.unknown = _priced_lower(partial, langs, min_count)
        self.prices = partial.where("what = 0").select("bucket", "k").join(self.bigrams.select("k", "p"), "k")

    def per_bucket(self, make: Callable[[_Bucket, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
        """``make`` of each bucket, its rows, the probabilities of its trigrams, its contexts and their weights."""
        discounts, min_count = self.discounts, self.min_count

        def run(grams: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
            b = _Bucket(list(grams["data"]))
            keys = prices["k"].to_numpy(dtype=np.int64).view(np.uint64)
            order = np.argsort(keys)
            return make(b, grams, *b.priced(keys[order], prices["p"].to_numpy(dtype=float)[order], discounts, min_count))

        return self.grams.groupBy("bucket").cogroup(self.prices.groupBy("bucket")).applyInPandas(run, schema)


def fit_kneser_ney(docs: DataFrame, common: dict[str, frozenset[str]], min_count: int = MIN_COUNT) -> SortedModel:
    """The model of few documents in memory, to score other texts; a large table is scored by ``corpus_perplexities``."""
    fitted = _Fitted(docs, common, min_count)

    def entries(b: _Bucket, grams: pd.DataFrame, p: np.ndarray, contexts: np.ndarray, gamma: np.ndarray) -> pd.DataFrame:
        kept = b.counts >= min_count
        nan = np.full(len(contexts), np.nan)
        return pd.DataFrame({
            "k": np.concatenate((b.keys[kept], contexts)).view(np.int64), "p": np.concatenate((p[kept], nan)), "gamma": np.concatenate((np.full(kept.sum(), np.nan), gamma)),
        })

    none = F.lit(None).cast("double")
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    top = fitted.per_bucket(entries, "k bigint, p double, gamma double").select("k", number("p"), number("gamma"))
    seen = lambda df: df.where(F.col("raw") >= min_count).select("k", "p", none.alias("gamma"))
    left = fitted.bigrams.select(F.col("context").alias("k"), none.alias("p"), "gamma")
    whole = seen(fitted.words).unionByName(seen(fitted.bigrams)).unionByName(left).unionByName(top)
    frame = whole.groupBy("k").agg(F.log(F.max("p")).alias("p"), F.log(F.max("gamma")).alias("gamma")).toPandas()
    return SortedModel(
        frame["k"].to_numpy(dtype="int64"), frame["p"].to_numpy(dtype="float64"), np.nan_to_num(frame["gamma"].to_numpy(dtype="float64")),
        {lang: math.log(p) for lang, p in fitted.unknown.items()},
    )


def corpus_perplexities(docs: DataFrame, common: dict[str, frozenset[str]], min_count: int = MIN_COUNT) -> DataFrame:
    """(fixture_id, field_name, lang, n_words, perplexity) of every field with words, under the model of the same documents."""
    fitted = _Fitted(docs, common, min_count)
    langs = fitted.langs

    def back(b: _Bucket, grams: pd.DataFrame, p: np.ndarray, contexts: np.ndarray, gamma: np.ndarray) -> pd.DataFrame:
        logs = np.split(np.log(p).astype(np.float32)[b.of_entry], np.cumsum(b.sizes)[:-1])
        return pd.DataFrame({"chunk": grams["chunk"], "bucket": grams["bucket"], "data": [_pack(x) for x in logs]})

    def score(texts: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
        known, ids, html, lang, n_words, digest, place = _unpack(texts["data"].iloc[0])
        logs = np.concatenate([_unpack(x)[0] for x in prices.sort_values("bucket")["data"]]).astype(float)[place]
        sizes = n_words + 1
        means = np.add.reduceat(logs, np.concatenate(([0], np.cumsum(sizes)[:-1]))) / sizes
        frame = pd.DataFrame({
            "fixture_id": ids, "field_name": np.where(html, "html", "markdown"), "lang": np.array(langs, dtype=object)[lang], "n_words": n_words, "perplexity": np.round(np.exp(-means), 4),
        })
        return frame[known]

    prices = fitted.per_bucket(back, "chunk bigint, bucket int, data binary")
    texts = fitted.chunks.where("bucket < 0").groupBy("chunk").cogroup(prices.groupBy("chunk"))
    return texts.applyInPandas(score, "fixture_id bigint, field_name string, lang string, n_words bigint, perplexity double")


def perplexities(docs: DataFrame, common: dict[str, frozenset[str]], model: SortedModel) -> DataFrame:
    """(fixture_id, field_name, lang, n_words, perplexity) of every field with words, under a model held in memory."""

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for chunk in _chunks(parts):
            rows, ones = [], []
            for fixture_id, html, text in chunk:
                lang, words = document_words(text, common)
                if words:
                    rows.append((fixture_id, "html" if html else "markdown", lang, len(words)))
                    ones.append(hashes.words(lang, words))
            frame = pd.DataFrame(rows, columns=["fixture_id", "field_name", "lang", "n_words"])
            if not rows:
                yield frame.assign(perplexity=pd.Series(dtype="float64"))
                continue
            sizes = frame["n_words"].to_numpy() + 1
            unknown = np.array([model.unknown.get(lang, -20.0) for lang in frame["lang"]])
            number, one, two, three, before_one, before_two = (x.view(np.int64) for x in hashes.grams(ones))
            logs = model.log_probabilities(unknown[number], one, two, three, before_one, before_two)
            sums = np.add.reduceat(logs, np.concatenate(([0], np.cumsum(sizes)[:-1])))
            yield frame.assign(perplexity=np.round(np.exp(-sums / sizes), 4))

    wanted = docs.where(F.col("fixture_id").isNotNull()).select("fixture_id", "html", "markdown")
    return wanted.mapInPandas(score, "fixture_id bigint, field_name string, lang string, n_words bigint, perplexity double")


def perplexity_bands(scored: DataFrame, band: float = BAND) -> DataFrame:
    """Each document with its language's lower and upper band, and whether it lies outside.

    Quartiles are those of the logarithms in steps of a thousandth: exact, the same however rows lie, and
    found among a number of steps that the data does not raise.
    """
    scored = cut_lineage(scored)
    steps = scored.groupBy("lang", F.round(F.log("perplexity") * 1000).cast("bigint").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("lang")
    placed = steps.select("lang", "step", F.sum("n").over(whole.orderBy("step")).alias("upto"), F.sum("n").over(whole).alias("all"))
    quartile = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("step") / 1000))
    quartiles = placed.groupBy("lang").agg(quartile(0.25).alias("one"), quartile(0.75).alias("three"))
    width = F.col("three") - F.col("one")
    bands = quartiles.select("lang", F.exp(F.col("one") - band * width).alias("low"), F.exp(F.col("three") + band * width).alias("high"))
    return scored.join(F.broadcast(bands), "lang").withColumn("rejected", (F.col("perplexity") < F.col("low")) | (F.col("perplexity") > F.col("high")))
