"""Toxicity of texts, scored after noisy-channel restoration.

Words that look disguised (signs or digits among letters, repeated letters, letters set apart by marks) are
restored: each sign stands for some letters at a cost, marks may be dropped, repeats may
collapse, and Viterbi decoding picks the likeliest path under a trigram model of characters
counted over the whole corpus. Three or more letters, signs or marks in a row that stand alone
between blanks are one lattice, in which each blank is dropped or parts two words. Neighbouring parts that make up a word of great weight
are read as one where the model of characters, with a bonus for a known word, finds this likelier. Before all, characters
of format are dropped, forms of other widths folded, and letters that look like Latin ones read as these where no other letters stand by them.
Restored words, and their prefixes, are looked up in weights learnt from labels; what the weights
of a document's words come to, in all and by length, goes through a fitted logistic curve.

A weight is the log ratio of a feature's rates in toxic and other texts, shrunken by its
standard error, so that weak evidence keeps a weak weight. The classifier is fitted on at most
``sample`` labelled rows, those with the least hashes of their ids; the curve is fitted on each half of
them scored with the weights of the other half. The weights, bounded by the sample alone, and the character
counts, at most 28 ** 3 over all documents, are on the driver. Each half has its share of either label; with fewer than
``SUPPORT`` toxic rows in a half, or no other ones, the curve is fitted on all rows with the weights of all.

Defined results: null and empty texts get the score of a text without any weighted
word; texts and words of any length are read whole; without usable labels all scores are 0; a document
with several labels counts as toxic if one of them says so; ids may have any type, equal as strings in
both tables; of equally likely readings the one that comes first among a lattice's options stays;
repeated rows give repeated rows; a null id is kept; an empty table gives an empty table; further columns
are left out of the scores; a column with the name of a result is replaced by it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named, unused
from ..functions.staging import staged
from .arrow_text import binary_array, cached, mapped, pieces, spans_of, text_buffers, tidy

SAMPLE = 20_000
#: Bytes of text whose words and features a task holds at a time.
PIECE_BYTES = 1 << 20
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature needs this many toxic documents; a log ratio this small, or this few standard errors large, has no weight.
SUPPORT, LEAST_WEIGHT, LEAST_ERRORS = 2, 1.0, 2.5
#: Words from which on a labelled text's counts are scaled down, so that long ones do not outweigh the others.
LONG = 300
#: Words that are added to a text's length when its weights are taken by length.
FEW = 30
#: Feature counts are summed as whole numbers of this fraction, which no order of addition changes.
UNIT = 1 << 10

# Letters that signs and digits commonly stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
MARKS = ".-_*~'`^:/\\ "
#: Costs in nats: a sign for a letter, a dropped mark, a collapsed repeat.
SIGN, MARK, REPEAT = 1.5, 0.7, 0.7

#: What a known word is likelier than its characters say, in nats, when parts make it up; letters it has at least.
KNOWN_WORD, LEAST_LETTERS = 4.0, 4

# Letters of other scripts and the Latin ones that they look like.
LOOKS_LIKE = dict(zip("авсдԁеһіјкмոорԛгѕтυսѵѡхуzАВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειορτυχνκ", "abcddehijkmnopqrstuuvwxyzABCEHIJKMOPSTXYABEZHIKMNOPTYXaeioptuxvk", strict=True))

EDGE, ALIEN, SYMBOLS = 26, 27, 28
STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "@$!") + "¡¿«»“”‘’…–—"


#: What folding may change: soft hyphens, and all beyond the Latin letters.
FOREIGN = re.compile("[\xad\u0250-\U0010ffff]")


def folded(word: str) -> str:
    """A word without characters of format, in plain widths, its look-alike letters as Latin ones if all its letters are or look Latin."""
    if word.isascii() or not FOREIGN.search(word):
        return word
    word = unicodedata.normalize("NFKC", "".join(c for c in word if unicodedata.category(c) != "Cf"))
    latin = "".join(LOOKS_LIKE.get(c, c) for c in word)
    return latin if latin != word and all(not c.isalpha() or ord(c) < 0x250 for c in latin) else word


def symbols() -> np.ndarray:
    """The symbol of each code point: 0-25 for letters with or without accents, EDGE for white space, ALIEN for others."""

    def build():
        table = np.full(0x110000, ALIEN, np.uint8)
        for i in range(0x250):
            base = unicodedata.normalize("NFD", chr(i).lower())[:1]
            if "a" <= base <= "z":
                table[i] = ord(base) - 97
        table[[*range(9, 14), 32, 0xA0]] = EDGE
        return table

    return cached("letter symbols", build)


def symbol(c: str) -> int:
    """The symbol of a lower-case letter or of anything else."""
    if "a" <= c <= "z":
        return ord(c) - 97
    if c == " ":
        return EDGE
    base = unicodedata.normalize("NFD", c)[:1]
    return ord(base) - 97 if "a" <= base <= "z" else ALIEN


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each three symbols follow each other, over all documents."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for _, data, _ in pieces(batches, "text"):
            text = data.tobytes().decode("utf-8")
            cp = data if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
            s = np.concatenate([[EDGE], symbols()[cp], [EDGE]]).astype(np.int32)
            total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["i", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for row in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[row.i] = row.n
    return counts


def costs_of(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a symbol after two others, smoothed by shorter contexts."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
    return -np.log(p3)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each stretch of the word, what it may stand for and at what cost."""
    out = []
    for m in re.finditer(r"(.)\1*", word):
        run, c = m[0], m[1]
        if c.isalpha():
            out.append([(run, 0.0)] + ([(c, REPEAT)] if len(run) > 1 else []) + ([(c * 2, REPEAT)] if len(run) > 2 else []))
            continue
        options = [(run, 0.0)]
        for letter in STANDS_FOR.get(c, ""):
            options.append((letter * min(len(run), 2), SIGN))
            if len(run) > 1:
                options.append((letter, SIGN + REPEAT))
        if c in MARKS:
            options.append(("", MARK))
        out.append(options)
    return out


def path_of(link: tuple | None) -> str:
    """What a chain of (link before, text) says."""
    said = []
    while link:
        link, text = link
        said.append(text)
    return "".join(reversed(said))


def step(states: dict, options: list[tuple[str, float]], costs, after: dict, mark=None) -> dict:
    """The states after one of the options, added to those in after; states are by two symbols and a mark."""
    for (a, b, _), (cost, link) in states.items():
        for text, extra in options:
            x, y, total = a, b, cost + extra
            for c in text:
                z = symbol(c)
                total += costs[x][y][z]
                x, y = y, z
            if (x, y, mark) not in after or total < after[x, y, mark][0]:
                after[x, y, mark] = (total, (link, text))
    return after


def likeliest(states: dict, costs) -> str:
    return path_of(min((cost + costs[a][b][EDGE], i, link) for i, ((a, b, _), (cost, link)) in enumerate(states.items()))[2])


def decode_word(word: str, costs) -> str:
    """The likeliest reading of a lower-case word of any length: time and memory are linear in it."""
    states: dict = {(EDGE, EDGE, None): (0.0, None)}
    for options in lattice(word):
        states = step(states, options, costs, {})
    return likeliest(states, costs)


def decode_apart(units: Sequence[str], costs) -> list[str]:
    """The likeliest words of letters, signs and marks that stood apart, lower-case: before each a word may end."""
    states: dict = {(EDGE, EDGE, None): (0.0, None)}
    before = ""
    for c in units:
        own = [(c, 0.0), *((letter, SIGN) for letter in STANDS_FOR.get(c, ""))]
        options = own + [(f" {text}", extra) for text, extra in own if before]
        if c in MARKS:
            options.append(("", MARK))
        after = step(states, options, costs, {})
        if c == before:  # a repeat that collapses, paid once however long
            after = step({k: v for k, v in states.items() if not k[2]}, [("", REPEAT)], costs, after, True)
            after = step({k: v for k, v in states.items() if k[2]}, [("", 0.0)], costs, after, True)
        states, before = after, c
    return likeliest(states, costs).split(" ")


REPEATED = re.compile(r"(.)\1+")
#: Contexts of repeats that a task remembers at a time.
KNOWN = 50_000


def collapsed(word: str, costs, known: dict[str, str]) -> str:
    """decode_word for a word of letters: two letters after its last repeat all paths meet, so what stands further off has no say."""
    runs = [m.span() for m in REPEATED.finditer(word)]
    a, z = runs[0][0], runs[-1][1] + 2
    lead, core = f"  {word}"[a : a + 2], word[a:z]
    key = lead + core + (" " if z > len(word) else "")
    if key not in known:
        if len(known) >= KNOWN:
            known.clear()
        states: dict = {(symbol(lead[0]), symbol(lead[1]), None): (0.0, None)}
        for options in lattice(core):
            states = step(states, options, costs, {})
        known[key] = likeliest(states, costs)
    return word[:a] + known[key] + word[z:]


def suspicious(word: str) -> bool:
    """Whether a lower-case, stripped word may be disguised."""
    if word.isalpha() and not REPEATED.search(word):
        return False
    letters = sum(c.isalpha() for c in word)
    signs = sum(c in STANDS_FOR or c in MARKS for c in word)
    return letters >= 2 and signs <= 2 * letters and letters + signs >= 0.9 * len(word)


def bare(word: str) -> str:
    """A word in lower case without what stands around it."""
    word = word.strip(STRIP).lower()
    return word if word.isalpha() else re.sub(r"^[@$!]{3,}|[@$!]{3,}$", "", word).rstrip("!")


def reading(word: str, costs, known: dict[str, str] | None = None) -> str:
    """The form of a word by which it is looked up: bare, and restored if it looks disguised."""
    word = bare(word)
    if not suspicious(word):
        return word
    return collapsed(word, costs, {} if known is None else known) if word.isalpha() else decode_word(word, costs)


def unit(token: str, word: str) -> str:
    """The letter, sign or mark that a token, bare as word, is but for what stands around it; else nothing."""
    c = token.lower() if len(token) == 1 else word
    return c if len(c) == 1 and (c.isalpha() or c in STANDS_FOR or c in MARKS) else ""


def set_apart(units: Sequence[str]) -> bool:
    """Whether a run of units may be words with their letters apart."""
    return len(units) >= 3 and sum(c.isalpha() for c in units) >= 2


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)] if len(word) > 2 else []


def plainly_read(words: pa.Array) -> np.ndarray:
    """Which words are letters of ASCII alone, none twice running: their reading is their lower case."""
    data, at = text_buffers(words)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] | 32) == (data[:-1] | 32)
    starts = at[:-1][at[:-1] < at[1:]]
    twice[starts] = False
    odd = np.concatenate([[0], np.cumsum(~letter | twice)])
    return odd[at[1:]] == odd[at[:-1]]


class Words:
    """The words of a run of texts: the distinct ones as read, and which text holds which."""

    def __init__(self, data: np.ndarray, at: np.ndarray, costs, known: dict[str, str] | None = None):
        starts, ends = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))), at)
        coded = binary_array(data, starts, ends).dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(at, starts, side="right") - 1
        self.plain = [folded(w.decode()) for w in coded.dictionary.to_pylist()]
        easy = plainly_read(coded.dictionary).tolist()
        self.read = [w.lower() if e else reading(w, costs, known) for w, e in zip(self.plain, easy, strict=True)]
        units = ["" if e and len(w) > 1 else unit(w, bare(w)) if len(w) == 1 or r[1:] == "" else "" for w, r, e in zip(self.plain, self.read, easy, strict=True)]
        lone = np.array([c != "" for c in units], bool)[self.code]
        a, z = spans_of(lone, np.append(np.searchsorted(starts, at[:-1]), len(starts)))
        self.apart = []
        more: dict[str, int] = {}
        docs, codes = [], []
        for i, j in zip(a.tolist(), z.tolist(), strict=True):
            run = [units[k] for k in self.code[i:j].tolist()] if j - i >= 3 else []
            if not set_apart(run):
                continue
            self.apart.append((i, j))
            for word in decode_apart(run, costs):
                if word not in more:
                    more[word] = len(self.read)
                    self.read.append(word)
                docs.append(self.doc[i])
                codes.append(more[word])
        self.starts, self.ends = starts, ends
        self.doc_all = np.concatenate([self.doc, np.array(docs, np.int64)])
        self.code_all = np.concatenate([self.code, np.array(codes, np.int64)])


@dataclass
class Model:
    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = ()

    def weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    @cached_property
    def parts(self) -> tuple[set[str], set[str], dict[str, int]]:
        """Whole words of at least half the greatest weight, what begins one, and for each part of one, 1 if it begins one, 2 if it stands further
        on in one, 3 if both."""
        least = max(self.weights.values(), default=0.0) / 2
        whole = {w for w, x in self.weights.items() if x >= least and not w.endswith("-") and len(w) >= LEAST_LETTERS}
        starts = {w[:k] for w in whole for k in range(1, len(w))}
        kinds = dict.fromkeys(starts, 1)
        for x in {w[a:z] for w in whole for a in range(1, len(w)) for z in range(a + 1, len(w) + 1)}:
            kinds[x] = kinds.get(x, 0) | 2
        return whole, starts, kinds

    def cost(self, text: str) -> float:
        x, y, total = EDGE, EDGE, 0.0
        for c in f"{text} ":
            z = symbol(c)
            total += self.costs[x][y][z]
            x, y = y, z
        return total

    def joined(self, read: Sequence[str], i: int) -> int:
        """Where the parts from i on that are read as one weighted word end, or i."""
        whole, starts, _ = self.parts
        said, j = read[i], i + 1
        while j < len(read) and said in starts:
            said, j = said + read[j], j + 1
            if said in whole and any(len(x) > 1 for x in read[i:j]):  # lone letters are read together before
                if self.cost(said) + MARK * (j - i - 1) - KNOWN_WORD <= self.cost(" ".join(read[i:j])):
                    return j
        return i

    def rejoined(self, words: Words) -> list[tuple[int, str]]:
        """Texts and the words in them that stand in parts."""
        whole, starts, kinds = self.parts
        if not whole or len(words.code) < 2:
            return []
        read = words.read[: len(words.plain)]
        kind = np.fromiter((kinds.get(r, 0) for r in read), np.uint8, len(read))[words.code]
        at = np.flatnonzero((kind[:-1] & 1 > 0) & (kind[1:] & 2 > 0) & (words.doc[:-1] == words.doc[1:]))
        # each two words are looked at once: few of them begin a known word together
        pairs, place = np.unique(words.code[at] * len(read) + words.code[at + 1], return_inverse=True)
        held = [read[k // len(read)] + read[k % len(read)] for k in pairs.tolist()]
        at = at[np.array([x in starts or x in whole for x in held], bool)[place.ravel()]] if len(at) else at
        # a word of n letters has n parts at most
        ends = np.minimum(np.searchsorted(words.doc, words.doc[at], side="right"), at + max(map(len, whole)))
        out = []
        for i, z in zip(at.tolist(), ends.tolist(), strict=True):
            near = [read[k] for k in words.code[i:z].tolist()]
            if (j := self.joined(near, 0)) > 0:
                out.append((int(words.doc[i]), "".join(near[:j])))
        return out

    def sums(self, words: Words, n_docs: int) -> np.ndarray:
        """For each text what its weighted readings come to by a hundred words, and the logarithm of what they come to in
        all. A reading that stands n times counts log2(1 + n) times."""
        known: dict[str, int] = {}
        number = np.array([known.setdefault(w, len(known)) for w in words.read], np.int64)
        more = [(d, known.setdefault(w, len(known))) for d, w in self.rejoined(words)]
        heads = {f[:3] for f in self.weights}  # all features of a word begin as it does
        weights = np.array([self.weight(w) if w[:3] in heads else 0.0 for w in known], float)
        if not len(weights):
            return np.zeros((n_docs, 2))
        code = np.concatenate([number[words.code_all], np.array([k for _, k in more], np.int64)])
        doc = np.concatenate([words.doc_all, np.array([d for d, _ in more], np.int64)])
        held = weights[code] != 0
        pairs, often = np.unique(doc[held] * len(weights) + code[held], return_counts=True)
        total = np.bincount(pairs // len(weights), weights=weights[pairs % len(weights)] * np.log2(1 + often), minlength=n_docs)
        length = np.bincount(words.doc, minlength=n_docs)
        return np.stack([100 * total / (length + FEW), np.log1p(total)], 1)

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + sums @ np.array(self.curve[1:])))) if self.curve else np.zeros(len(sums))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Offset and slopes of the curve fitted by Newton's method with a small ridge."""
    w, design = np.zeros(x.shape[1] + 1), np.column_stack([np.ones(len(x)), x])
    ridge = np.array([1e-6] + [0.1] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        slope = design.T @ (p - y) + ridge * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def shrunken(yes: Column, no: Column, n_yes: float, n_no: float) -> Column:
    """The log ratio of two rates, less the more its standard error is of it."""
    rare = 1.5  # of other texts, so many occurrences are taken for granted
    ratio = F.log((yes + 0.5) / (n_yes + 1)) - F.log((no + rare) / (n_no + 1))
    errors = ratio / F.sqrt(1 / (yes + 0.5) + 1 / (no + rare))
    return F.when((ratio > LEAST_WEIGHT) & (errors > LEAST_ERRORS), ratio * (1 - (LEAST_ERRORS / errors) ** 2)).otherwise(0.0)


COUNTS = [f"{kind}{half}" for half in (0, 1) for kind in ("no", "yes", "docs")]


def feature_counts(words: Words, half: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Of each feature, by half: how often it stands in texts without and with the label, and in how many with it."""
    length = np.bincount(words.doc, minlength=len(label))
    scale = UNIT * np.minimum(1.0, LONG / np.maximum(length, 1))
    number: dict[str, int] = {}
    own = [[number.setdefault(f, len(number)) for f in features(w)] for w in words.read]
    sizes = np.array([len(x) for x in own], np.int64)
    flat, first = np.array([i for x in own for i in x], np.int64), np.cumsum(sizes) - sizes
    pairs, often = np.unique(words.doc_all * (len(own) + 1) + words.code_all, return_counts=True)
    doc, code = np.divmod(pairs, len(own) + 1)
    each = sizes[code]
    into = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    held = np.repeat(doc, each) * (len(number) + 1) + flat[np.repeat(first[code], each) + into]
    held, place = np.unique(held, return_inverse=True)
    often = np.bincount(place.ravel(), weights=np.repeat(often, each), minlength=len(held))
    doc, feature = np.divmod(held, len(number) + 1)
    total = np.zeros((len(COUNTS), len(number)), np.int64)
    kind = 3 * half[doc] + label[doc]
    np.add.at(total, (kind, feature), np.rint(scale[doc] * np.log2(1 + often)).astype(np.int64))
    np.add.at(total, (3 * half[doc] + 2, feature), label[doc])
    return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), *(pa.array(row) for row in total)], names=["feature", *COUNTS])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows given and the characters of all documents."""
    model = Model(costs_of(trigram_counts(docs, text_col)))
    costs = model.costs.tolist()
    chosen = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).alias("label")).dropna()
    chosen = chosen.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    turn = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("id", F.lit(1)), "id"))  # sample rows at most
    chosen = chosen.select("id", "label", (turn % 2).cast("int").alias("half"))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select("text", "label", "half")
    rows = staged(rows.repartition(max(1, sample // 500)), "labelled")  # a bounded sample, read several times

    def counts(batches):
        known: dict[str, str] = {}
        for batch, data, at in pieces(batches, "text", PIECE_BYTES):
            yield feature_counts(Words(data, at, costs, known), batch.column(2).to_numpy(), batch.column(1).to_numpy())

    def lengths(batches):
        n = np.zeros((2, 2), np.int64)
        for batch, data, at in pieces(batches, "text", PIECE_BYTES):
            starts, _ = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))), at)
            own = np.minimum(np.diff(np.append(np.searchsorted(starts, at[:-1]), len(starts))), LONG)
            np.add.at(n, (batch.column(2).to_numpy(), batch.column(1).to_numpy()), own)
        yield pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1], pa.int32()), pa.array([0, 1, 0, 1], pa.int32()), pa.array(n.ravel())], names=["half", "label", "n"])

    kinds = {(r.half, r.label): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    if {label for _, label in kinds} != {0, 1}:
        return model
    apart = all(kinds.get((half, label), 0) >= (SUPPORT if label else 1) for half in (0, 1) for label in (0, 1))
    n = defaultdict(int) | {(r.half, r.label): r.n for r in rows.mapInArrow(tidy(lengths), "half int, label int, n long").groupBy("half", "label").agg(F.sum("n").alias("n")).collect()}
    table = rows.mapInArrow(tidy(counts), ", ".join(["feature string", *(f"{c} long" for c in COUNTS)])).groupBy("feature").agg(*(F.sum(c).alias(c) for c in COUNTS))
    table = table.filter(F.col("docs0") + F.col("docs1") >= SUPPORT)

    def weight(*halves: int) -> Column:
        yes, no, held = (reduce(Column.__add__, (F.col(f"{c}{h}") for h in halves)) for c in ("yes", "no", "docs"))
        n_yes, n_no = (float(sum(n[h, label] for h in halves)) for label in (1, 0))
        return F.when(held >= SUPPORT, shrunken(yes / UNIT, no / UNIT, n_yes, n_no)).otherwise(0.0)

    # each half is scored with the weights of the other, so the curve is fitted on sums as new texts have them
    table = table.select("feature", weight(0, 1).alias("both"), weight(*(1,) if apart else (0, 1)).alias("half0"), weight(*(0,) if apart else (0, 1)).alias("half1"))
    kept = table.filter("both > 0 OR half0 > 0 OR half1 > 0").collect()
    model.weights, *crossed = ({r.feature: r[c] for r in kept if r[c] > 0} for c in ("both", "half0", "half1"))
    crossed = [Model(model.costs, w) for w in crossed]

    def sums(batches):
        known: dict[str, str] = {}
        for batch, data, at in pieces(batches, "text", PIECE_BYTES):
            words, half = Words(data, at, costs, known), batch.column(2).to_numpy()
            x = np.where(half[:, None] == 0, *(m.sums(words, batch.num_rows) for m in crossed))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], names=["rate", "total", "label"])

    got = rows.mapInArrow(tidy(sums), "rate double, total double, label int").collect()
    got.sort()  # so that sums of floats come out alike
    model.curve = logistic(np.array([(r.rate, r.total) for r in got]), np.array([r.label for r in got], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, 0 to 1."""

    def run(batches):
        costs, known = model.costs.tolist(), {}
        for batch, data, at in pieces(batches, "text", PIECE_BYTES):
            got = model.scores(model.sums(Words(data, at, costs, known), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["id", "score"])

    ddl = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {ddl}, score double").withColumnRenamed("id", id_col)


def filtered(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold."""
    place = docs.columns.index(text_col)

    def run(batches):
        costs, known = model.costs.tolist(), {}
        for batch, data, at in pieces(batches, place, PIECE_BYTES):
            kept = model.scores(model.sums(Words(data, at, costs, known), batch.num_rows)) < threshold
            yield batch.filter(pa.array(kept))

    return mapped(docs, run, docs.schema)


def restored_text(text: str, costs, model: Model | None = None) -> str:
    tokens = list(re.finditer(r"\S+", text))
    plain = [folded(m[0]) for m in tokens]
    units = [unit(w, bare(w)) for w in plain]
    read = [reading(w, costs) for w in plain] if model and model.weights else []
    out, at, i = [], 0, 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and units[j]:
            j += 1
        if set_apart(units[i:j]):
            said = " ".join(decode_apart(units[i:j], costs))
        elif read and (j := model.joined(read, i)) > i:
            said = "".join(read[i:j])
        else:
            j, word = i + 1, plain[i]
            said = reading(word, costs) if suspicious(bare(word)) else word
        out += [text[at : tokens[i].start()], said]
        at, i = tokens[j - 1].end(), j
    return "".join([*out, text[at:]])


def restored(docs: DataFrame, model: Model, text_col: str = "text", restored_col: str = "restored") -> DataFrame:
    """The input with its texts in which each disguised word is replaced by its reading; null stays null."""

    kept = [c for c in docs.columns if c.lower() != restored_col.lower()]
    source = docs.select(*map(named, kept), named(text_col).cast("string").alias(*unused(kept, "read")))

    def run(batches):
        costs = model.costs.tolist()
        for batch in batches:
            out = [None if text is None else restored_text(text, costs, model) for text in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "out"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(restored_col, T.StringType())])
    return mapped(source, run, schema)
