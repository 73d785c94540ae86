"""Per-document text statistics, and a hidden Markov model that labels lines prose, list, table or junk.

Each line is described by six discrete statistics (share of common words, final punctuation,
length, symbols, shape, first letter).  A hidden Markov model with the states of ``STATES`` decodes
the lines of a document; characters by label give the document's label shares.  A document is not
natural prose when the lines labelled prose hold less than ``PROSE_SHARE`` of the characters; a
message (``one_is_enough``) is prose as soon as one of its sentences is.

``fit_line_model`` fits the model over all documents, on the lines that are judged later: Baum-Welch
rounds with the posterior (forward-backward) counts of states, emissions and transitions, from the
starting model ``_START`` that gives the states their meaning, until the likelihood rests.  Texts are
read once, into sequences of line codes; equal sequences are counted together, so a round is a pass
over the different sequences, and its sums have a size that does not depend on the data.
``PRIOR_WEIGHT`` observations of the starting model keep small tables from being overfitted.

Defined results: NULL, empty and blank texts are no cases and have NULL shares; code blocks and
formulas count with the lines around them only where nothing else is left; front matter and
comments are no text; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.session import cut_lineage

STATES = ("prose", "list", "table", "junk")
PROSE_SHARE = 0.5
PRIOR_WEIGHT = 200.0
#: the rounds end when the log-likelihood of a line rises by less than REST, or after ROUNDS
ROUNDS, REST = 12, 1e-3
IMPOSSIBLE = 1e-12
#: values of each statistic: common words, final mark, words, symbols, shape, first letter
SIZES = (5, 2, 4, 4, 3, 2)

#: starting probabilities of each statistic's values, by state; what is 0 stays 0 in the fit: a sentence of eight
#: words or more has some common words, and others
_START = {
    "prose": ((0.02, 0.06, 0.92, 0.0, 0.0), (0.25, 0.75), (0.02, 0.06, 0.22, 0.70), (0.80, 0.17, 0.025, 0.005), (0.90, 0.08, 0.02), (0.15, 0.85)),
    "list": ((0.75, 0.15, 0.045, 0.005, 0.05), (0.97, 0.03), (0.30, 0.50, 0.17, 0.03), (0.40, 0.30, 0.25, 0.05), (0.35, 0.63, 0.02), (0.75, 0.25)),
    "table": ((0.78, 0.08, 0.03, 0.01, 0.10), (0.97, 0.03), (0.35, 0.35, 0.20, 0.10), (0.10, 0.25, 0.35, 0.30), (0.13, 0.02, 0.85), (0.70, 0.30)),
    "junk": ((0.36, 0.15, 0.03, 0.16, 0.30), (0.85, 0.15), (0.25, 0.25, 0.20, 0.30), (0.25, 0.15, 0.25, 0.35), (0.70, 0.05, 0.25), (0.75, 0.25)),
}
_STAY = 0.85

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_EDGES = ".,;:!?…\"'“”„«»‘’()*_`~|-–—"
_MARKER = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)]|\\item)\s+|^\*+(?=\w)")
_BULLET_LINK = re.compile(r"^\[[^\]]*\]\([^)]*\)$")
_CELLS = re.compile(r"[|\t;=,]")
_FENCE = re.compile(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)|<pre\b.*?</pre>|<syntaxhighlight\b.*?</syntaxhighlight>|\\begin\{(lstlisting|verbatim)\}.*?\\end\{\2\}")
_FRONT = re.compile(r"\A\ufeff?---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>")
_BLOCK_END = re.compile(r"</(?:p|h[1-6]|li|tr|div|blockquote|ul|ol|table)\s*>|<br\s*/?>|</td>", re.I)
_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)")
_LATEX = re.compile(r"\\(?:cite|label)\{[^{}]*\}|\\[a-zA-Z]+\*?(?=\{)|\\(?:begin|end)\{[^{}]*\}|[{}]")
_ATX = re.compile(r"(?m)^ {0,3}#{1,6}\s.*$|^=+[^=\n]+=+\s*$|^\\(?:sub)*section\*?\{.*$|^[^\n]*\n(?:={3,}|-{3,})[ \t]*$")
_TABLE_ENV = re.compile(r"(?ms)^\{\|.*?^\|\}|\\begin\{tabular\}.*?\\end\{tabular\}")
_WIKI_ASIDE = re.compile(r"^\{\{[^{}]*\}\}|\[\[(?:Category|File|Image|Kategorie|Datei|Catégorie|Fichier|Categoría|Archivo):[^\]]*\]\]", re.M)
_WIKI_LINK = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n")


class LineModel:
    """Logarithms of the model's probabilities, and the common words."""

    def __init__(self, common: frozenset[str], start: list[float] | None = None, move: list[list[float]] | None = None, emit: list[list[list[float]]] | None = None) -> None:
        n = len(STATES)
        self.common = common
        self.start = start or [0.55, 0.15, 0.15, 0.15]
        self.move = move or [[_STAY if i == j else (1 - _STAY) / (n - 1) for j in range(n)] for i in range(n)]
        self.emit = emit or [[list(f) for f in _START[s]] for s in STATES]
        log = lambda p: math.log(max(p, IMPOSSIBLE))
        self._start = [log(p) for p in self.start]
        self._move = [[log(p) for p in row] for row in self.move]
        self._emit = [[[log(p) for p in f] for f in s] for s in self.emit]
        self._seen: dict[tuple[int, ...], list[float]] = {}

    def emission(self, seen: tuple[int, ...]) -> list[float]:
        found = self._seen.get(seen)
        if found is None:
            found = self._seen[seen] = [sum(f[v] for f, v in zip(s, seen)) for s in self._emit]
        return found

    def decode(self, lines: list[tuple[int, ...]]) -> list[int]:
        """The most likely states (Viterbi)."""
        if not lines:
            return []
        n = range(len(STATES))
        score = [a + b for a, b in zip(self._start, self.emission(lines[0]))]
        back: list[list[int]] = []
        for seen in lines[1:]:
            e = self.emission(seen)
            step, new = [], []
            for j in n:
                best = max(n, key=lambda i: score[i] + self._move[i][j])
                step.append(best)
                new.append(score[best] + self._move[best][j] + e[j])
            back.append(step)
            score = new
        state = max(n, key=lambda i: score[i])
        path = [state]
        for step in reversed(back):
            state = step[state]
            path.append(state)
        return path[::-1]


class _Words(dict):
    """Token to its word in lower case, empty where it is none; forgets all when it has grown large."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        word = token.strip(_EDGES)
        found = self[token] = word.lower() if word and _WORD.fullmatch(word) else ""
        return found


_WORDS = _Words()


def line_statistics(line: str, common: frozenset[str]) -> tuple[int, ...]:
    marker = _MARKER.match(line)
    body = line[marker.end() :] if marker else line
    words = [w for w in map(_WORDS.__getitem__, body.split()) if w]
    n = len(words)
    shared = len([w for w in words if w in common]) / n if n else 0.0
    stripped = body.rstrip(" \t\"'”»)*_`")
    ends = 1 if stripped[-1:] in ".!?…。！？" else 0
    solid = len(body) - body.count(" ")
    letters = sum(map(len, words))
    symbols = 1 - letters / solid if solid else 1.0
    cells = len(_CELLS.findall(body))
    shape = 2 if "|" in body and cells >= 2 or (cells >= 2 and cells * 3.4 >= n) or ("=" in body and n <= 6) else 1 if marker or _BULLET_LINK.match(body.strip()) else 0
    first = next((c for c in body if c.isalnum()), "")
    return (
        (0 if n < 8 else 4) if shared <= 0.05 else 1 if shared <= 0.10 else 2 if shared <= 0.8 or n < 8 else 3,
        ends,
        0 if n <= 2 else 1 if n <= 4 else 2 if n <= 9 else 3,
        0 if symbols < 0.08 else 1 if symbols < 0.2 else 2 if symbols < 0.4 else 3,
        shape,
        1 if first.isupper() else 0,
    )


def text_lines(text: str) -> list[str]:
    """Lines that can be prose: markup that is no text removed, headings left out unless nothing else is left."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _COMMENT.sub("", _FRONT.sub("", text))
    text = _WIKI_LINK.sub(r"\1", _WIKI_ASIDE.sub("", text))
    bare = _TABLE_ENV.sub("\n", _ATX.sub("\n", _FENCE.sub("\n", text)))
    for source in (bare, text):
        if "<" in source:
            source = _TAGS.sub("", _BLOCK_END.sub("\n", re.sub(r"<h([1-6])\b.*?</h\1\s*>", "\n", source, flags=re.S | re.I) if source is bare else source))
        lines = [x for x in source.split("\n") if x.strip() and not re.fullmatch(r"[\s=\-|:*_~`#.{}\[\]]+", x)]
        if lines:
            return lines
    return [x for x in text.split("\n") if x.strip()]


def judged_lines(text: str, sentences: bool = False) -> list[str]:
    """The lines of a text as the model sees them; with ``sentences`` a line for each."""
    lines = text_lines(text)
    if sentences:
        lines = [p for x in lines for p in _SENTENCE.split(x) if p.strip()]
    cleaned = []
    for x in lines:
        y = _LATEX.sub("", x) if "\\" in x else x
        z = _LINK.sub(r"\1", y) if "](" in y and not _BULLET_LINK.match(_MARKER.sub("", y).strip()) else y
        cleaned.append(z if z.strip() else x)
    return cleaned


def label_characters(text: str, model: LineModel, sentences: bool = False) -> list[int]:
    """Characters by state of ``STATES``."""
    lines = judged_lines(text, sentences)
    totals = [0] * len(STATES)
    for line, state in zip(lines, model.decode([line_statistics(x, model.common) for x in lines])):
        totals[state] += len(line.strip())
    return totals


def is_not_prose(text: str | None, model: LineModel, one_is_enough: bool = False) -> bool:
    if not text or text.isspace():
        return False
    totals = label_characters(text, model, sentences=one_is_enough)
    if one_is_enough:
        return totals[0] == 0
    return totals[0] < PROSE_SHARE * sum(totals)


def load_common_words(words: DataFrame) -> frozenset[str]:
    """The fixed table of common words (a few hundred rows, the same at every scale)."""
    return frozenset(r["word"].lower() for r in words.select("word").where(F.col("word").isNotNull()).distinct().collect())


N_CODES = math.prod(SIZES)
_VALUES = np.stack(np.unravel_index(np.arange(N_CODES), SIZES), axis=1)


def line_codes(lines: list[str], common: frozenset[str]) -> list[int]:
    """Each line's statistics as one number."""
    out = []
    for line in lines:
        code = 0
        for value, size in zip(line_statistics(line, common), SIZES):
            code = code * size + value
        out.append(code)
    return out


def posterior_counts(sequences: list[np.ndarray], weights: np.ndarray, model: LineModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states, transitions and (code, state), and the log-likelihood, by forward-backward over all sequences at once."""
    n = len(STATES)
    start, move = np.array(model.start), np.array(model.move)
    emit = np.ones((N_CODES, n))
    for s in range(n):
        for f in range(len(SIZES)):
            emit[:, s] *= np.maximum(np.array(model.emit[s][f]), IMPOSSIBLE)[_VALUES[:, f]]
    firsts, moves, codes, likelihood = np.zeros(n), np.zeros((n, n)), np.zeros((N_CODES, n)), 0.0
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    at = 0
    while at < len(order):
        # sequences of like lengths side by side; a batch holds a bounded number of lines, or one sequence
        end = at + 1
        while end < len(order) and (end - at + 1) * len(sequences[order[end]]) <= 200_000:
            end += 1
        batch = [sequences[i] for i in order[at:end]]
        w = weights[order[at:end]]
        at = end
        lengths = np.array([len(x) for x in batch])
        steps = int(lengths[-1])
        seen = np.zeros((len(batch), steps), dtype=np.int64)
        for i, x in enumerate(batch):
            seen[i, : len(x)] = x
        e = emit[seen]
        alive = np.arange(steps)[None, :] < lengths[:, None]
        e[~alive] = 1.0
        alpha, scale = np.empty_like(e), np.empty((len(batch), steps))
        for t in range(steps):
            a = start * e[:, t] if t == 0 else (alpha[:, t - 1] @ move) * e[:, t]
            scale[:, t] = a.sum(axis=1)
            alpha[:, t] = a / scale[:, t, None]
        likelihood += float((np.log(scale) * alive * w[:, None]).sum())
        beta = np.ones((len(batch), n))
        for t in range(steps - 1, -1, -1):
            here = alive[:, t]
            gamma = alpha[:, t] * beta
            gamma *= (here * w / gamma.sum(axis=1))[:, None]
            for s in range(n):
                codes[:, s] += np.bincount(seen[:, t], gamma[:, s], N_CODES)
            if t == 0:
                firsts += gamma.sum(axis=0)
            else:
                ahead = e[:, t] * beta / scale[:, t, None]
                moves += (alpha[:, t - 1] * (here * w)[:, None]).T @ ahead * move
                back = ahead @ move.T
                beta = np.where(here[:, None], back, 1.0)
    return firsts, moves, codes, likelihood


def code_sequences(texts: DataFrame, common: frozenset[str]) -> DataFrame:
    """(codes, n) of the different sequences of line codes of the rows (src_table, text)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            counts: dict[tuple, int] = {}
            for src, text in zip(part["src_table"], part["text"]):
                codes = tuple(line_codes(judged_lines(text, src == "issues"), common))
                counts[codes] = counts.get(codes, 0) + 1
            yield pd.DataFrame({"codes": [list(c) for c in counts], "n": list(counts.values())})

    rows = texts.select("src_table", "text").where(F.length(F.trim("text")) > 0)
    return rows.mapInPandas(read, "codes array<smallint>, n bigint").where(F.size("codes") > 0).groupBy("codes").agg(F.sum("n").alias("n"))


def re_estimated(model: LineModel, firsts: np.ndarray, moves: np.ndarray, codes: np.ndarray, prior_weight: float) -> LineModel:
    """The model of these counts and ``prior_weight`` observations of the starting model for each distribution."""
    base = LineModel(model.common)

    def smoothed(counts: np.ndarray, prior: list[float]) -> list[float]:
        counts = counts * (np.array(prior) > 0)
        return ((counts + prior_weight * np.array(prior)) / (counts.sum() + prior_weight)).tolist()

    states, features = range(len(STATES)), range(len(SIZES))
    return LineModel(
        model.common, smoothed(firsts, base.start), [smoothed(moves[s], base.move[s]) for s in states],
        [[smoothed(np.bincount(_VALUES[:, f], codes[:, s], SIZES[f]), base.emit[s][f]) for f in features] for s in states],
    )


def fit_line_model(texts: DataFrame, common: frozenset[str], rounds: int = ROUNDS, prior_weight: float = PRIOR_WEIGHT) -> LineModel:
    """The model fitted over all rows of ``texts`` (columns ``src_table``, ``text``)."""
    sequences = cut_lineage(code_sequences(texts, common))
    model = LineModel(common)
    n = len(STATES)
    size = n + n * n + N_CODES * n + 2
    before = -math.inf
    for _ in range(rounds):
        current = model

        def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(size)
            for part in parts:
                if len(part):
                    found = [np.asarray(x, dtype=np.int64) for x in part["codes"]]
                    weights = part["n"].to_numpy(dtype=float)
                    firsts, moves, codes, likelihood = posterior_counts(found, weights, current)
                    lines = float((weights * [len(x) for x in found]).sum())
                    sums += np.concatenate((firsts, moves.ravel(), codes.ravel(), [likelihood, lines]))
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"i": at, "v": sums[at]})

        got = np.zeros(size)
        for r in sequences.mapInPandas(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # at most size rows
            got[r["i"]] = r["v"]
        if not got[-1]:
            break
        model = re_estimated(model, got[:n], got[n : n + n * n].reshape(n, n), got[n + n * n : -2].reshape(N_CODES, n), prior_weight)
        now = got[-2] / got[-1]
        if now - before < REST:
            break
        before = now
    return model


def label_shares(texts: DataFrame, model: LineModel) -> DataFrame:
    """(src_table, row_id, prose, list, table, junk shares, is_case) of the rows (src_table, row_id, text)."""

    def shares(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for src, row_id, text in zip(part["src_table"], part["row_id"], part["text"]):
                message = src == "issues"
                if text is None or text.isspace() or not text:
                    rows.append((src, row_id, None, None, None, None, False))
                    continue
                totals = label_characters(text, model, sentences=message)
                whole = sum(totals) or 1
                case = totals[0] == 0 if message else totals[0] < PROSE_SHARE * whole
                rows.append((src, row_id, *(round(t / whole, 6) for t in totals), case))
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "prose", "list", "tabular", "junk", "is_case"])

    return texts.select("src_table", "row_id", "text").mapInPandas(
        shares, "src_table string, row_id bigint, prose double, list double, tabular double, junk double, is_case boolean"
    )


def text_statistics(text: Column) -> dict[str, Column]:
    """Native statistics of a text; NULL for NULL, zero for empty."""
    words = F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.length(F.trim(x)) > 0)
    n = F.size(words)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    return {
        "n_chars": F.length(text).cast("bigint"),
        "n_words": F.when(text.isNotNull(), n).cast("bigint"),
        "mean_word_length": F.when(n > 0, F.round(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n, 6)),
        "symbol_ratio": F.when(F.length(text) > 0, F.round((F.length(text) - letters) / F.length(text), 6)),
        "n_lines": F.when(text.isNotNull(), F.size(lines)).cast("bigint"),
        "ends_in_punctuation": F.when(
            F.size(lines) > 0, F.round(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?…。！？][ \t]*$"))) / F.size(lines), 6)
        ),
    }
