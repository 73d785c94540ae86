"""Mixing sources to target shares of tokens, with a cap on how often a document may be used.

``soft_rates``: a naive Bayes classifier, fitted on at most ``FIT_DOCUMENTS`` labelled rows, predicts
each document's domain posteriors from three views of the whole text, hashed: how its lines begin,
end and are built, all runs of ``RUN`` signs with words as w, and all its words and word pairs.  Its
temperature is chosen on at most ``HELD_OUT`` other labelled rows.  Nonnegative document rates are
then fitted by distributed projected-gradient least squares in the metric of the rates that are still
free, so that the expected token totals of the domains match the targets.  A rate is at most the
``max_repeats`` of the document's own source, and 0 for sources without a target.  The total is the
largest that the caps allow of the tried ones: where the fit does not come within ``TOLERANCE`` it is
lowered.  A document's rate is a function of its posteriors (in steps of 1 / ``GRID``), its cap and
the steps so far, so the fit runs over the different ones of these, and a step needs one aggregation
of as many sums as there are pairs of domains.

``hard_mix``: the same targets for the labels as given.  Each source gets the rate share * total /
tokens; whole copies come first, the rest is a prefix of the documents in hash order, cut exactly by
a histogram of hash buckets and one sort inside the bucket of the cut.

Sizes are tokens of a public tokenizer.  Defined results: NULL and empty texts have no tokens and
are not used; documents whose source is NULL or not in the targets are not used by ``hard_mix``;
a target source without tokens reaches 0 and the others share its part; repeated targets add up,
the smallest cap holds; shares are divided by their sum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.tokenise import encode, encoder
from pagegauge.session import cut_lineage

#: hash buckets of a view, and the weight of each view: words tell less of a source than shapes do
BUCKETS = 4096
VIEWS = (1.0, 1.0, 0.1)
FEATURES = BUCKETS * len(VIEWS)
RUN = 6
#: bounds of the labelled rows that the classifier is fitted on and its temperature is chosen on
FIT_DOCUMENTS, HELD_OUT = 20_000, 2_000
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)
GRID = 256
#: texts whose features are held as arrays at once
BATCH = 200
#: steps at one total, times that the total is lowered, by how much, and the error that ends the fit (share of the total)
STEPS, LOWERINGS, LOWER, TOLERANCE = 12, 8, 0.97, 1e-4
HASH_BUCKETS = 4096
#: fixed targets: a table of one row for each source, the same at every scale
MAX_SOURCES = 10_000

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"\w|[^\S\n]")
_DIGITS = re.compile(r"\d+")


_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Memo(dict):
    """String to 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, key: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[key] = xxhash.xxh3_64_intdigest(key)
        return h


_HASHES = _Memo()


def _hashed(strings: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, strings), dtype=np.uint64, count=len(strings))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def _line_strings(text: str, lines: list[str], shape: str) -> set[str]:
    """How the lines begin, end and are built."""
    n = len(lines)
    found = {f"n{min(n, 12)}", f"chars{min(12, len(text) // 200)}", f"mean{min(20, len(text) // max(1, n) // 25)}"}
    heads: dict[str, int] = {}
    for line, built, signs in zip(lines, shape.split("\n"), _SIGNS.sub("", shape).split("\n")):
        first = line.split(" ", 2)
        plain = first[0].isalpha() and (len(first) == 1 or first[1].isalpha())
        head = "w" if plain else first[0].lower()
        heads[head] = heads.get(head, 0) + 1
        found.add("s" + built[:12])
        found.add("e" + line[-1])
        found.add("p" + signs)
    found.update(f"h{head}*{min(4, round(4 * c / n))}" for head, c in heads.items())
    return found


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, feature) in order, of all texts at once: hash buckets, view by view, of the lines' beginnings,
    ends and build, of the shape of all the text and of all its words; digits as 0."""
    of: list[list[str]] = []
    shapes: list[str] = []
    words: list[list[str]] = []
    for text in texts:
        text = _DIGITS.sub("0", text)
        lines = [x for line in text.splitlines() if (x := line.strip())]
        shape = _WORD.sub("w", "\n".join(lines))
        of.append(list(_line_strings(text, lines, shape)))
        shapes.append(shape.ljust(RUN))
        words.append(text.lower().split())
    number = lambda parts: np.repeat(np.arange(len(texts)), [len(x) for x in parts])
    signs = np.frombuffer("".join(shapes).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = max(0, len(signs) - RUN + 1)
    at_shape, at_word = number(shapes), number(words)
    word = _hashed([w for x in words for w in x])
    with np.errstate(over="ignore"):
        run = signs[:n].copy()
        for k in range(1, RUN):
            run = run * _ODD + signs[k : k + n]
        inside = at_shape[:n] == at_shape[len(at_shape) - n :]
        pair = _mixed(word[:-1] * _ODD + word[1:])
        joined = at_word[:-1] == at_word[1:]
        views = (
            (number(of), _hashed([x for f in of for x in f])), (at_shape[:n][inside], _mixed(run[inside])),
            (np.concatenate((at_word, at_word[1:][joined])), np.concatenate((word, pair[joined]))),
        )
    keys = np.concatenate([at * FEATURES + i * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64) for i, (at, h) in enumerate(views)])
    keys = np.unique(keys)
    return keys // FEATURES, keys % FEATURES


def features(text: str) -> np.ndarray:
    return text_features([text])[1]


def targets_of(mix_targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, cap), shares summing to 1; a small fixed table."""
    rows = (
        mix_targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0))
        .groupBy("source")
        .agg(F.sum("target_share").alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
        .orderBy("source")
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many target sources")
    total = sum(r["w"] for r in rows) or 1.0
    return [(r["source"], r["w"] / total, max(0, int(r["cap"]))) for r in rows]


def sized_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, cache = encoder(path)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "n_tokens": [len(encode(t, pairs, cache)) for t in part["text"]]})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")


class DomainClassifier:
    """Naive Bayes over the presence of features, each view tempered so that long texts stay soft."""

    def __init__(self, domains: list[str], counts: np.ndarray, documents: np.ndarray) -> None:
        self.domains = domains
        self.temperature = 1.0
        rate = (counts + 0.1) / (documents[:, None] + 0.2)
        self.weight = np.log(rate) - np.log1p(-np.minimum(rate, 1 - 1e-9))
        self.base = np.log1p(-np.minimum(rate, 1 - 1e-9)).reshape(len(domains), len(VIEWS), BUCKETS).sum(axis=2)
        self.prior = np.log((documents + 1) / (documents.sum() + len(domains)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row of scores for each text."""
        out = np.empty((len(texts), len(self.domains)))
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            number, feature = text_features(part)
            # sums of each text's view: differences of the running sum at the views' ends
            ends = np.searchsorted(number * len(VIEWS) + feature // BUCKETS, np.arange(len(part) * len(VIEWS) + 1))
            running = np.vstack((np.zeros(len(self.domains)), np.cumsum(self.weight.T[feature], axis=0)))
            sums = (running[ends[1:]] - running[ends[:-1]]).reshape(len(part), len(VIEWS), -1)
            scale = np.array(VIEWS) / np.sqrt(1 + np.diff(ends).reshape(len(part), len(VIEWS)))
            out[at : at + len(part)] = ((sums + (self.base + self.prior[:, None]).T) * scale[:, :, None]).sum(axis=1)
        return out

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        z = scores * self.temperature
        q = np.exp(z - z.max(axis=-1, keepdims=True))
        return q / q.sum(axis=-1, keepdims=True)

    def calibrate(self, scores: np.ndarray, truth: np.ndarray) -> None:
        """The temperature under which held-out labels are most likely."""
        if len(scores):

            def fit(t: float) -> float:
                self.temperature = t
                return float(np.log(np.maximum(self.posteriors(scores)[np.arange(len(truth)), truth], 1e-9)).sum())

            self.temperature = max(TEMPERATURES, key=fit)


def fit_classifier(docs: DataFrame, domains: list[str]) -> DomainClassifier:
    """Fitted on a bounded sample of labelled rows; at most len(domains) * (FEATURES + 1) sums and HELD_OUT rows of scores reach the driver."""
    at = {d: i for i, d in enumerate(domains)}
    labelled = docs.select("doc_id", "source", "text").where(F.col("source").isin(domains) & (F.length("text") > 0))
    total = labelled.count()
    # of each document, by its id, a place in [0, 1)
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    held = min(HELD_OUT / max(1, total), 0.25)
    used = min(FIT_DOCUMENTS / max(1, total), 1.0 - held)
    scored_rows = labelled.where(place < held)
    fit_rows = labelled.where((place >= held) & (place < held + used))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(domains), FEATURES), dtype=np.int64)
        documents = np.zeros(len(domains), dtype=np.int64)
        for part in parts:
            place = np.array([at[x] for x in part["source"]], dtype=np.int64)
            documents += np.bincount(place, minlength=len(domains))
            texts = part["text"].tolist()
            for first in range(0, len(texts), BATCH):
                number, feature = text_features(texts[first : first + BATCH])
                sums += np.bincount(place[first + number] * FEATURES + feature, minlength=sums.size).reshape(sums.shape)
        s, f = np.nonzero(sums)
        own = np.flatnonzero(documents)
        yield pd.DataFrame({"s": np.concatenate((s, own)), "f": np.concatenate((f, np.full(len(own), -1))), "n": np.concatenate((sums[s, f], documents[own]))})

    counts, documents = np.zeros((len(domains), FEATURES)), np.zeros(len(domains))
    for r in fit_rows.mapInPandas(count, "s int, f int, n bigint").groupBy("s", "f").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["f"] < 0:
            documents[r["s"]] = r["n"]
        else:
            counts[r["s"], r["f"]] = r["n"]
    classifier = DomainClassifier(domains, counts, documents)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"s": [at[x] for x in part["source"]], "z": list(classifier.scores(part["text"].tolist()))})

    rows = scored_rows.mapInPandas(score, "s int, z array<double>").collect()  # about HELD_OUT
    if rows:
        classifier.calibrate(np.array([r["z"] for r in rows]), np.array([r["s"] for r in rows]))
    return classifier


def rates(posteriors: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Document rates after the given steps from 0, each projected to 0 .. cap."""
    r = np.zeros(len(posteriors))
    for e in steps:
        r = np.clip(r - posteriors @ e, 0.0, caps)
    return r


def soft_documents(docs: DataFrame, targets: list[tuple[str, float, int]], path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, cap, domain, posterior, q) of every document with tokens; q in steps of 1 / GRID."""
    domains = [t[0] for t in targets]
    caps = {t[0]: float(t[2]) for t in targets}
    classifier = fit_classifier(docs, domains)

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, cache = encoder(path)
        for part in parts:
            part = part.assign(n_tokens=[len(encode(t, pairs, cache)) for t in part["text"]])
            part = part[part["n_tokens"] > 0]
            if len(part):
                q = classifier.posteriors(classifier.scores(part["text"].tolist()))
                steps = np.floor(q * GRID)
                best = q.argmax(axis=1)
                steps[np.arange(len(q)), best] += GRID - steps.sum(axis=1)  # the steps of a document sum to GRID
                yield part[["doc_id", "source", "n_tokens"]].assign(
                    cap=[caps.get(s, 0.0) for s in part["source"]], domain=[domains[i] for i in best], posterior=np.round(q.max(axis=1), 6), q=list(steps.astype(np.int32))
                )

    schema = "doc_id bigint, source string, n_tokens bigint, cap double, domain string, posterior double, q array<int>"
    return cut_lineage(docs.select("doc_id", "source", "text").mapInPandas(predict, schema))


def fit_rates(soft: DataFrame, targets: list[tuple[str, float, int]]) -> tuple[list[np.ndarray], float]:
    """(steps, error as a share of the total) of the rates of ``soft``."""
    n = len(targets)
    share = np.array([t[1] for t in targets])
    kinds = cut_lineage(soft.where("cap > 0").groupBy("q", "cap").agg(F.sum("n_tokens").alias("t")))

    def measured(known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the products of the posteriors whose rates are free."""

        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals, free = np.zeros(n), np.zeros((n, n))
            for part in parts:
                if len(part):
                    q, cap, t = np.stack(part["q"].to_numpy()) / GRID, part["cap"].to_numpy(), part["t"].to_numpy()
                    r = rates(q, cap, known)
                    totals += (r * t) @ q
                    open_ = (r > 0) & (r < cap)
                    free += (q[open_] * t[open_, None]).T @ q[open_]
            yield pd.DataFrame({"i": np.arange(n * n + n), "v": np.concatenate((totals, free.ravel()))})

        out = np.zeros(n * n + n)
        for r in kinds.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out[:n], out[n:].reshape(n, n)

    most, _ = measured([np.full(n, -1e12)])  # with every document at its cap
    usable = most > 0
    goal = share * usable / max(1e-12, (share * usable).sum())
    total = min([most[i] / goal[i] for i in range(n) if goal[i] > 0], default=0.0)
    if not total:
        return [], 0.0
    have, _ = measured([np.full(n, -1e-3)])  # a thousandth of every document
    best: tuple[list[np.ndarray], float] = ([], math.inf)
    for _ in range(LOWERINGS + 1):
        want = goal * total
        steps = [-np.where(have > 0, 1e-3 * want / np.maximum(have, 1e-12), 0.0)]  # each domain at its own rate
        for _ in range(STEPS):
            reached, free = measured(steps)
            error = float(np.abs(reached - want).max() / total)
            if error < best[1]:
                best = (list(steps), error)
            if error < TOLERANCE:
                return list(steps), error
            ridge = 1e-9 * max(1.0, float(np.trace(free)) / n)
            steps.append(np.linalg.solve(free + ridge * np.eye(n), reached - want))
        total *= LOWER
    return best


def soft_rates(docs: DataFrame, mix_targets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, domain, posterior, rate) of every document with tokens, report of the shares).

    The report (source, target_share, expected_share, actual_share, fit_error) sets the targets beside the
    shares of the expected totals by posterior and of the real totals by source.
    """
    spark = docs.sparkSession
    targets = targets_of(mix_targets)
    schema = "doc_id bigint, source string, n_tokens bigint, domain string, posterior double, rate double"
    if not targets:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "source string, target_share double, expected_share double, actual_share double, fit_error double")
    soft = soft_documents(docs, targets, path)
    steps, error = fit_rates(soft, targets)
    domains = [t[0] for t in targets]

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                q = np.stack(part["q"].to_numpy()) / GRID
                yield part[["doc_id", "source", "n_tokens", "domain", "posterior", "q"]].assign(rate=np.round(rates(q, part["cap"].to_numpy(), steps), 6))

    rated = soft.mapInPandas(apply, schema.replace("rate double", "q array<int>, rate double"))
    weighed = rated.where("rate > 0").select("source", "q", (F.col("rate") * F.col("n_tokens")).alias("t"))
    by_source = {r["source"]: r["t"] for r in weighed.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    by_domain = {r["i"]: r["t"] for r in weighed.select("t", F.posexplode("q").alias("i", "w")).groupBy("i").agg((F.sum(F.col("t") * F.col("w")) / GRID).alias("t")).collect()}
    whole = sum(by_source.values()) or 1.0
    report = [(s, w, round(by_domain.get(i, 0.0) / whole, 6), round(by_source.get(s, 0.0) / whole, 6), error) for i, (s, w, _) in enumerate(targets)]
    columns = "source string, target_share double, expected_share double, actual_share double, fit_error double"
    return rated.drop("q"), spark.createDataFrame(report, columns)


def hard_mix(docs: DataFrame, mix_targets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, copies) of the used documents, (source, target_share, max_repeats, ...) report)."""
    spark = docs.sparkSession
    targets = targets_of(mix_targets)
    domains = [t[0] for t in targets]
    sized = cut_lineage(sized_documents(docs.where(F.col("source").isin(domains)), path).where("n_tokens > 0"))
    bucket = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(HASH_BUCKETS)).cast("int")
    sized = sized.withColumn("bucket", bucket)
    sums = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    have = {r["source"]: r["t"] for r in sums.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    weight = sum(w for s, w, _ in targets if have.get(s)) or 1.0
    total = min([cap * have[s] / (w / weight) for s, w, cap in targets if have.get(s)], default=0.0)
    plan = [(s, w, cap, have.get(s, 0), (w / weight * total / have[s]) if have.get(s) else 0.0) for s, w, cap in targets]
    table = spark.createDataFrame(
        [(s, w, cap, t, int(r + 1e-9), max(0.0, (r - int(r + 1e-9))) * t) for s, w, cap, t, r in plan],
        "source string, target_share double, max_repeats int, available_tokens bigint, base int, extra double",
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most HASH_BUCKETS rows for each source
    before = sums.select("source", "bucket", F.coalesce(F.sum("t").over(running), F.lit(0)).alias("before"), "t")
    cuts = before.join(F.broadcast(table), "source").select(
        "source", "bucket", "base",
        F.when(F.col("before") + F.col("t") <= F.col("extra"), 1).when(F.col("before") < F.col("extra"), 2).otherwise(0).alias("state"),
        (F.col("extra") - F.col("before")).alias("left"),
    )
    placed = sized.join(cuts, ["source", "bucket"])
    inside = placed.where("state = 2")
    order = Window.partitionBy("source").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    split = inside.withColumn("sum", F.sum("n_tokens").over(order)).withColumn("copies", F.col("base") + (F.col("sum") <= F.col("left")).cast("int"))
    rest = placed.where("state <> 2").withColumn("copies", F.col("base") + F.col("state"))
    columns = ["doc_id", "source", "n_tokens", "copies"]
    used = rest.select(*columns).unionByName(split.select(*columns)).where("copies > 0")
    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    report = table.join(reached, "source", "left")
    whole = Window.partitionBy()
    report = report.select(
        "source", "target_share", "max_repeats", "available_tokens",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.round(F.coalesce(F.col("mixed_tokens") / F.sum("mixed_tokens").over(whole), F.lit(0.0)), 6).alias("actual_share"),
    )
    return used, report
