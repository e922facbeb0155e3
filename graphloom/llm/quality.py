"""Quality rules: learned decision lists.

One pass computes per document the base counts and a few ratios. Sequential covering then learns an ordered list of
conjunctions of thresholds for "low quality" from labelled rows: each rule grows by the condition with the most
information gain on two thirds of the rows left, is pruned on the other third, and stays if it is precise there; rows it
covers go. The list becomes one ordered Spark conditional expression, so it runs inside whole-stage code.

Learning takes at most about MAX_ROWS labelled rows, chosen by a hash of doc_id, of which only numbers reach the driver.

Defined cases: null and empty texts have no words, fail the base test and so aren't kept; ratios without a denominator
are 0; without labels of both kinds the list is empty and the base test decides; of repeated labels of an id the highest counts,
of its texts the least; ids of any size stay as they are, further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_slices, trimmed

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPERCASE = bytes(range(65, 91))
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "letter_share", "bangs_per_word", "distinct_share", "words_per_line")

MAX_ROWS = 12_000
#: Rules stop growing at so many conditions and a list at so many rules; a rule must be so precise where it was pruned.
MAX_CONDITIONS, MAX_RULES, LEAST_PRECISION = 3, 12, 0.9
#: Thresholds that each feature offers: quantiles of the rows left.
QUANTILES = 64


def measure(text: str) -> tuple:
    """COUNTS, then RATIOS of a text."""
    b = text.encode()
    words = b.split()
    n = len(words)
    if not n:
        n_symbols = len(b) - len(b.translate(None, SYMBOLS))
        return (0, 0, n_symbols, 0, 0) + (0.0,) * len(RATIOS)
    word_chars = len(text) - (len(b) - len(b.translate(None, SPACES)))
    word_bytes = len(b.translate(None, SPACES))
    n_symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines, dup, n_lines = set(), 0, 0
    for line in b.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in lines:
                dup += 1
            else:
                lines.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first, marks = {}, bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    marks[i : i + 3] = b"\1\1\1"
                    marks[j : j + 3] = b"\1\1\1"
            repeat = sum(marks)
    upper = len(b) - len(b.translate(None, UPPERCASE))
    letters = len(b) - len(b.translate(None, LETTERS))
    return (
        n, word_chars, n_symbols, dup, repeat,
        word_chars / n, n_symbols / n, dup / n_lines, repeat / n, upper / max(1, letters), letters / max(1, word_bytes), b.count(b"!") / n, len(set(words)) / n, n / n_lines,
    )


def measurements(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, further columns to keep, COUNTS and RATIOS of every row, in one pass without a shuffle."""
    keep = ("doc_id", *keep)

    def run(batches):
        for batch in batches:
            for a, texts in text_slices(batch.column("text")):
                columns = list(zip(*map(measure, texts)))
                kept = [batch.column(c).slice(a, len(texts)) for c in keep]
                numbers = [pa.array(x, pa.int64() if i < len(COUNTS) else pa.float64()) for i, x in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*kept, *numbers], names=[*keep, *COUNTS, *RATIOS])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS]
    return docs.select(*keep, "text").mapInArrow(trimmed(run), ", ".join(kinds))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        x = data[self.feature]
        return x >= self.threshold if self.at_least else x <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.at_least else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Sequence[Condition], data, n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(data)
    return out


def _grow(data, y, features) -> Rule:
    rule: list[Condition] = []
    left = np.ones(len(y), dtype=bool)
    for _ in range(MAX_CONDITIONS):
        p, n = y[left].sum(), (~y[left]).sum()
        if not p or not n:
            break
        base, best, gain = np.log2(p / (p + n)), None, 1e-9
        for f in features:
            x, bad = data[f][left], y[left]
            order = np.argsort(x, kind="stable")
            xs, cum = x[order], np.concatenate([[0], np.cumsum(bad[order])])
            cuts = np.unique(np.quantile(xs, np.linspace(0, 1, QUANTILES)))
            for at_least in (True, False):
                k = np.searchsorted(xs, cuts, side="left" if at_least else "right")
                pos, covered = (p - cum[k], len(xs) - k) if at_least else (cum[k], k)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / np.maximum(covered, 1)) - base), 0)
                i = int(g.argmax())
                if g[i] > gain:
                    gain, best = g[i], Condition(f, at_least, float(cuts[i]))
        if best is None:
            break
        rule.append(best)
        left &= best.holds(data)
    return tuple(rule)


def learn(data: dict[str, np.ndarray], low: np.ndarray) -> list[Rule]:
    """An ordered list of rules for the rows where low is true."""
    features, rules = list(data), []
    for round_ in range(MAX_RULES):
        place = (np.arange(len(low)) + round_) % 3
        grow, prune = place != 2, place == 2
        if not low[grow].any() or low.sum() < 3:
            break
        rule = _grow({f: x[grow] for f, x in data.items()}, low[grow], features)
        held = {f: x[prune] for f, x in data.items()}

        def worth(r):
            c = _covers(r, held, int(prune.sum()))
            p, n = low[prune][c].sum(), (~low[prune][c]).sum()
            return ((p - n) / max(1, p + n), len(r) * -1e-6, p, n)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: worth(r)[:2], default=())
        _, _, p, n = worth(rule) if rule else (0, 0, 0, 0)
        if not p or p / (p + n) < LEAST_PRECISION:
            break
        rules.append(rule)
        stay = ~_covers(rule, data, len(low))
        data, low = {f: x[stay] for f, x in data.items()}, low[stay]
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules from labels.quality (0 is low) of a bounded sample of the labelled rows."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = known.count()
    near = F.abs(F.xxhash64("doc_id") % 1_000_000) < int(1_000_000 * min(1.0, max_rows / max(n, 1)))
    known = known.where(near).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    rows = measurements(sample, "quality").select("doc_id", "quality", *RATIOS, "n_words").toPandas().sort_values("doc_id")
    features = [*RATIOS, "n_words"]
    return learn({f: rows[f].to_numpy(dtype=float) for f in features}, rows["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional expression over measurements(): true is to keep."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept of every document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = fit(docs, labels)
    return measurements(docs).select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
