"""Quality of texts: plain rules, then gradient-boosted trees over statistics of a text.

``statistics`` reads each text once and leaves some twenty counts of it; all else works on these, so texts are
neither shuffled nor read again. Windows of eight words are told apart by exact codes, doubled three times (words,
pairs, fours, eights), never by a hash.

Trees are grown here on histograms of binned features with logistic loss, level by level. A feature may be
constrained: more of it never raises the score (-1), or never lowers it (1). A split that breaks this is not
taken, and the values below a split are kept on its sides of the middle, so the constraint holds for whole trees
and their sum. A fitted forest is a few numpy arrays of nodes, in which leaves lead to themselves, so a batch is
scored by as many steps as trees are deep, over all rows and trees at once.

The forest is fitted on at most ``sample`` labelled rows, those with the least hashes of their ids, on the driver;
their counts alone are collected. Everything else covers all rows.

Defined results: null and empty texts have no words and fail the rules; texts of any length are read whole (a task
holds some hundred bytes a word of the text at hand); a document with several labels counts as good only if all of them say so; null labels are
left out; with no label, or labels of one kind only, each text scores 1, so the rules alone decide; ids may have any type, equal as
strings in both tables; a null id is kept, and has no label; repeated rows give repeated rows; an empty table gives an
empty table; further columns are left out of the statistics; filtered keeps all columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named, unused
from .arrow_text import binary_array, mapped, pieces, spans_of, tidy

SAMPLE = 20_000
#: Bytes of text whose words a task holds at a time.
PIECE_BYTES = 2 << 20
#: Texts of fewer words fail, as do those with more than so many in a hundred words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Texts that score less are not kept.
KEPT_FROM = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_letters", "n_upper", "n_digits", "n_marks", "n_shouts", "n_wide", "n_distinct", "n_most", "n_stutter"]
SYMBOLS, SHOUTS = b"#*$%&|<>", b"!?"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS + SHOUTS)


def _among(*values: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


IS = {
    "space": _among(32, *range(9, 14)), "n_symbols": _among(*SYMBOLS), "n_shouts": _among(*SHOUTS), "n_marks": _among(*MARKS), "n_digits": _among(*range(48, 58)),
    "n_upper": _among(*range(65, 91)), "n_letters": _among(*range(65, 91), *range(97, 123)), "start": _among(*(b for b in range(256) if b & 0xC0 != 0x80)), "n_wide": _among(*range(0xC0, 256)),
}


def repeated_words(code: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """For each text, its words inside windows of width words (a power of two) that stand in it twice or more."""
    windows, step = code.astype(np.int64), 1
    while step < width:
        if len(windows) <= step:
            return np.zeros(n_docs, np.int64)
        windows = pd.factorize(windows[:-step] * (windows.max() + 1) + windows[step:])[0].astype(np.int64)
        step *= 2
    at = np.flatnonzero(doc[: len(windows)] == doc[width - 1 :])
    if not len(at):
        return np.zeros(n_docs, np.int64)
    own, _ = pd.factorize(doc[at] * (windows.max() + 1) + windows[at])
    at = at[np.bincount(own)[own] > 1]
    edges = np.bincount(at, minlength=len(code) + 1) - np.bincount(at + width, minlength=len(code) + 1)
    return np.bincount(doc[np.cumsum(edges[:-1]) > 0], minlength=n_docs)


def counted(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a run of texts: their UTF-8 bytes end to end, and the offsets."""
    n = len(at) - 1

    def by_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] - total[at[:-1]]

    out = {name: by_text(IS[name][data]) for name in ("n_symbols", "n_shouts", "n_marks", "n_digits", "n_upper", "n_letters", "n_wide")}
    word = ~IS["space"][data]
    out["n_chars"], out["word_chars"] = by_text(IS["start"][data]), by_text(IS["start"][data] & word)
    starts, ends = spans_of(word, at)
    doc = np.searchsorted(at, starts, side="right") - 1
    code = binary_array(data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    out["n_words"] = np.bincount(doc, minlength=n)
    out["n_repeat_words"] = repeated_words(code, doc, n)
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    out["n_stutter"] = np.bincount(doc[again], minlength=n)
    own, kinds = pd.factorize(doc * (code.max(initial=0) + 1) + code)
    kind_of = kinds // (code.max(initial=0) + 1)
    out["n_distinct"], out["n_most"] = np.bincount(kind_of, minlength=n), np.zeros(n, np.int64)
    np.maximum.at(out["n_most"], kind_of, np.bincount(own, minlength=len(kinds)))

    feeds = np.flatnonzero(data == 10)
    first, last = np.sort(np.concatenate([at[:-1], feeds + 1])), np.sort(np.concatenate([at[1:], feeds]))
    held = np.searchsorted(starts, last) > np.searchsorted(starts, first)  # lines with a word
    first, last = first[held], last[held]
    line_doc = np.searchsorted(at, first, side="right") - 1
    out["n_lines"], out["n_dup_lines"] = np.bincount(line_doc, minlength=n), np.zeros(n, np.int64)
    if len(first):
        line = binary_array(data, first, last).dictionary_encode().indices.to_numpy().astype(np.int64)
        kinds = pd.unique(line_doc * (line.max() + 1) + line) // (line.max() + 1)
        out["n_dup_lines"] = out["n_lines"] - np.bincount(kinds, minlength=n)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and COUNTS of every text."""

    def run(batches):
        for rows, data, at in pieces(batches, "text", PIECE_BYTES):
            found = counted(data, at)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["id", *COUNTS])

    ddl = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(tidy(run), ", ".join([f"id {ddl}", *(f"{c} long" for c in COUNTS)])).withColumnRenamed("id", id_col)


def base_failed() -> Column:
    """Whether a row of statistics fails the plain rules."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


#: The features of the trees, and whether more of one may only lower (-1) the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_by_word": -1, "dup_lines": -1, "repeat_words": -1, "upper": 0, "digits": 0, "marks": 0, "shouts_by_word": -1,
    "wide": 0, "words_by_line": 0, "distinct": 0, "most_common": 0, "stutter": -1, "letters": 0,
}


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each text."""
    c = {k: v.astype(float) for k, v in counts.items()}
    by = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), by("word_chars", "n_words"), by("n_symbols", "n_words"), by("n_dup_lines", "n_lines"), by("n_repeat_words", "n_words"), by("n_upper", "n_letters"), by("n_digits", "n_chars"), by("n_marks", "n_words"), by("n_shouts", "n_words"),
        by("n_wide", "n_chars"), by("n_words", "n_lines"), by("n_distinct", "n_words"), by("n_most", "n_words"), by("n_stutter", "n_words"), by("n_letters", "n_chars"),
    ])


@dataclass
class Forest:
    """Nodes of all trees: a row goes left where its feature is at most the threshold. Leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    offset: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.offset + self.value[node].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def constant(margin: float) -> Forest:
    none = np.zeros(0, np.int64)
    return Forest(none, none.astype(float), none, none, none.astype(float), none, 0, margin)


def boosted(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0, bins: int = 64) -> Forest:
    """Trees for labels 0 and 1. signs: for each feature, how the score may go with it. least: of a leaf's hessians, in sum."""
    n, k = x.shape
    edges = [np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column) for e, column in zip(edges, x.T, strict=True)])  # x <= e[i] where the bin is i at most
    real = np.array([np.arange(bins) < len(e) for e in edges])  # cuts that part rows at all
    sign = np.array(signs)[:, None, None]
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    offset = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, offset)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        level, bounds = [len(nodes) - 1], [(-np.inf, np.inf)]
        at = np.zeros(n, np.int64)  # which node of the level a row is in; -1: in a leaf
        leaf = np.full(n, len(nodes) - 1)
        for step in range(depth + 1):
            live = at >= 0
            where = at[live]
            total = np.stack([np.bincount(where, weights=v[live], minlength=len(level)) for v in (g, h)])
            low, high = np.array(bounds).T
            own = np.clip(-total[0] / (total[1] + ridge), low, high)
            for i, node in enumerate(level):
                nodes[node][4] = rate * own[i]
            if step == depth:
                break
            cells = [[np.bincount(where * bins + binned[live, f], weights=v[live], minlength=len(level) * bins).reshape(-1, bins) for v in (g, h)] for f in range(k)]
            a = np.cumsum(np.array(cells), axis=3)  # feature, g or h, node, cut
            ga, ha = a[:, 0], a[:, 1]
            gz, hz = total[0][None, :, None] - ga, total[1][None, :, None] - ha
            wa, wz = (np.clip(-u / (v + ridge), low[None, :, None], high[None, :, None]) for u, v in ((ga, ha), (gz, hz)))
            worth = lambda u, v, w: -(u * w + (v + ridge) * w * w / 2)
            gain = worth(ga, ha, wa) + worth(gz, hz, wz) - worth(*total, own)[None, :, None]
            gain[(sign * (wz - wa) < 0) | (ha < least) | (hz < least) | ~real[:, None, :]] = -np.inf
            flat = gain.transpose(1, 0, 2).reshape(len(level), -1)
            best = flat.argmax(1)
            split = flat[np.arange(len(level)), best] > 1e-6
            next_level, next_bounds = [], []
            to = np.full((len(level), 2), -1)
            for i in np.flatnonzero(split):
                f, cut = divmod(int(best[i]), bins)
                middle = (wa[f, i, cut] + wz[f, i, cut]) / 2
                (lo, hi), s = bounds[i], signs[f]
                new = len(nodes)
                nodes += [[0, np.inf, new, new, 0.0], [0, np.inf, new + 1, new + 1, 0.0]]
                nodes[level[i]][:4] = [f, edges[f][cut], new, new + 1]
                to[i] = len(next_level), len(next_level) + 1
                next_level += [new, new + 1]
                next_bounds += [(middle if s < 0 else lo, middle if s > 0 else hi), (middle if s > 0 else lo, middle if s < 0 else hi)]
            if not next_level:
                break
            rows = np.flatnonzero(live)
            f_of, cut_of = np.divmod(best, bins)
            right = binned[rows, f_of[where]] > cut_of[where]
            at[rows] = to[where, right.astype(int)]
            moved = rows[at[rows] >= 0]
            leaf[moved] = np.array(next_level)[at[moved]]
            level, bounds = next_level, next_bounds
        margin = margin + np.array([node[4] for node in nodes])[leaf]
    feature, threshold, left, right, value = map(np.array, zip(*nodes, strict=True))
    return Forest(feature.astype(np.int64), threshold.astype(float), left, right, value, np.array(roots), depth, offset)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """A forest from statistics and labels of at most sample rows."""
    chosen = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).alias("label")).dropna()
    chosen = chosen.groupBy("id").agg((F.min("label") > 0).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = stats.select(F.col(id_col).cast("string").alias("id"), *COUNTS).join(F.broadcast(chosen), "id")
    # of repeated rows of an id one is enough, which also bounds what is collected
    got = rows.groupBy("id").agg(F.min(F.struct("label", *COUNTS)).alias("r")).select("r.*").toPandas()
    got = got.sort_values(list(got.columns))  # so that sums of floats come out alike
    if got.label.nunique() < 2:
        return constant(np.inf)
    return boosted(features({c: got[c].to_numpy() for c in COUNTS}), got.label.to_numpy().astype(float), list(FEATURES.values()))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """Rows of statistics with base_failed, score (0 to 1) and kept."""
    types = [*stats.schema, T.StructField("score", T.DoubleType())]

    def run(batches):
        for batch in batches:
            x = features({c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(x))], names=[f.name for f in types])

    scored = stats.mapInArrow(run, T.StructType(types)).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= KEPT_FROM))


def filtered(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the rules and the forest, columns as they are."""
    last = len(docs.columns)

    def run(batches):
        for rows, data, at in pieces(batches, last, PIECE_BYTES):
            found = counted(data, at)
            passed = (found["n_words"] >= LEAST_WORDS) & (100 * found["n_repeat_words"] <= MOST_REPEATED * found["n_words"])
            yield rows.select(list(range(last))).filter(pa.array(passed & (forest.scores(features(found)) >= KEPT_FROM)))

    return mapped(docs.select("*", named(text_col).cast("string").alias(*unused(docs.columns, "held"))), run, docs.schema)
