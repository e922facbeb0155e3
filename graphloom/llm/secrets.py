"""Secret scans: fixed patterns, and a battery of randomness tests with a length-aware false-discovery control.

Kinds assign, access and hex are plain patterns. The method adds kind `random`: maximal runs of 20 or more characters of
[A-Za-z0-9+/_=-], or what other spans leave of one, if that still has 20. For each we infer the encoding, the smallest alphabet that holds its
characters, and test the places in that alphabet: chi-squared uniformity, runs above and below the middle, and lag-one
serial correlation. A run that any test rejects at ALPHA (Bonferroni over the three) isn't random. For the others the
p-value of "ordinary text" is exp(-LLR), LLR the log likelihood ratio of uniform letters to a chain of character classes
(lower, upper, digit, other) as in words, names and numbers; in runs of letters alone, also of each letter to the one
before it, by the bigrams of all words of the corpus (runs of 20 left out) mixed with those of a fixed word list: by Markov's inequality no ordinary run has a smaller one
more often than it says, whatever its length. Within each class of length (powers of two), Benjamini and Hochberg's
procedure over all runs of the corpus bounds the share of false discoveries by FDR. It needs only counts of rounded
p-values, a table of at most LENGTHS * BINS rows.

Defined cases: null texts are empty and have no spans; texts of any length are scanned whole; ties in start go by kind as
listed; repeated rows repeat; an empty table gives no row; ids of any size stay as they are; find() reads no further column,
redact() passes all through.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column_names, map_texts, materialize, text_slices, trimmed

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST, SIGNS = 20, "+/_=-"
ALPHA, FDR = 0.01, 1e-3
LENGTHS, BINS, BIN = 24, 400, 0.25  # a bin is a quarter of a power of ten

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by size; the first that holds a run's characters is its encoding.
ALPHABETS = [DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/-_="]
PLACES = [({c: i for i, c in enumerate(a)}, len(a)) for a in ALPHABETS]
#: Chance that ordinary text goes from one class to the next (rows, columns: lower, upper, digit, other), and letters of each class.
MOVES = ((0.90, 0.04, 0.03, 0.03), (0.39, 0.55, 0.03, 0.03), (0.05, 0.05, 0.85, 0.05), (0.5, 0.3, 0.15, 0.05))
LETTERS = (26, 26, 10, 5)
#: Common words that stand for ordinary text where the corpus has little.
COMMON = """the of and to in is that it was for on are as with his they be at one have this from or had by not but some what
there we can out other were all your when up use word how said each she which their time will way about many then them would
write like these her long make thing see him two has look more day could go come did my sound no most number who over know
water than call first people may down side been now find any new work part take get place made live where after back little
only round man year came show every good give our under name very through just form sentence great think say help low line
differ turn cause much mean before move right boy old too same tell does set three want air well also play small end put home
read hand port large spell add even land here must big high such follow act why ask men change went light kind off need house
picture try us again animal point mother world near build self earth father international application organization
der die und in den von zu das mit sich des auf nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um
am sind noch wie einem einen so zum kann nur mehr haben oder aber vor zur bis wenn sein schon durch man sehr jahr zwischen
de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux mais comme nous ou
cette leur bien deux peut tous fait sans entre temps elle encore ainsi toujours premier gouvernement
el los las por con para una su al lo como mas pero sus le ya este porque cuando muy sin sobre ser tiene tambien hasta hay donde
quien desde todo nos durante estados todos uno les ni contra otros ese eso ante ellos mismo nacional"""
#: Shares of the fixed bigrams in the model, and of equal chances in those; so no step counts for more than a factor of about 70.
FIXED, EQUAL = 0.15, 0.1


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def bigrams(texts: list[str]) -> np.ndarray:
    """26 x 26 counts of a letter and the next in the words of the texts, case folded, beside runs of LEAST characters."""
    data = np.frombuffer(RUN.sub(" ", " ".join(texts)).encode("utf-8", "replace"), dtype=np.uint8)
    letter = (data | 0x20).astype(np.int64) - 97
    letter[(letter < 0) | (letter > 25) | (data < 65) | (data > 122)] = 26
    return np.bincount(letter[:-1] * 27 + letter[1:], minlength=729).reshape(27, 27)[:26, :26]


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the chance of a letter after another."""
    c = bigrams([COMMON]) + 0.5
    fixed = (1 - EQUAL) * c / c.sum(axis=1, keepdims=True) + EQUAL / 26
    seen = (counts + 50 * fixed) / (counts.sum(axis=1, keepdims=True) + 50)
    return np.log((1 - FIXED) * seen + FIXED * fixed)


def fit_letters(docs: DataFrame) -> np.ndarray:
    """The model of all words of the corpus; 676 counts reach the driver."""

    def run(batches):
        total = np.zeros((26, 26), dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                total += bigrams(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(676)), pa.array(total.ravel())], names=["pair", "n"])

    counts = np.zeros(676)
    for r in docs.select("text").mapInArrow(trimmed(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    return letter_model(counts.reshape(26, 26))


def battery(run: str, letters: np.ndarray | None = None) -> tuple[float, float]:
    """(p of uniform randomness, Bonferroni over three tests; p of ordinary text) of a run; letters: a letter_model()."""
    run = run.rstrip("=") or run
    places, size = next(p for p in PLACES if all(c in p[0] for c in run))
    x, n = [places[c] for c in run], len(run)
    counts = [0] * size
    for i in x:
        counts[i] += 1
    chi2, df = sum((c - n / size) ** 2 for c in counts) * size / n, size - 1
    z = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_uniform = 0.5 * math.erfc(z / math.sqrt(2))
    above = [2 * i >= size for i in x]
    n1 = sum(above)
    n0 = n - n1
    if n1 and n0:
        runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
        mean = 1 + 2 * n1 * n0 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(x) / n
    spread = sum((i - middle) ** 2 for i in x)
    p_serial = _two_sided(sum((a - middle) * (b - middle) for a, b in zip(x, x[1:])) / spread * math.sqrt(n)) if spread else 0.0
    classes = [_class(c) for c in run]
    text = sum(math.log(MOVES[a][b]) for a, b in zip(classes, classes[1:]))
    if max(classes) < 2:
        model = FIXED_LETTERS if letters is None else letters
        at = [ord(c) - 97 for c in run.lower()]
        text += float(model[at[:-1], at[1:]].sum()) - math.log(26)
    else:
        text -= sum(math.log(LETTERS[k]) for k in classes)
    gain = -n * math.log(size) - text
    return min(1.0, 3 * min(p_uniform, p_runs, p_serial)), math.exp(-max(0.0, gain)) if gain < 700 else 0.0


FIXED_LETTERS = letter_model(np.zeros((26, 26)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _rests(a: int, b: int, spans: list[tuple[int, int, int]], text: str):
    """What the spans, sorted by start, leave of the run a to b, without a sign that joins it to a span, if LEAST characters remain."""
    at = a
    for start, _, end in [*((s, k, e) for s, k, e in spans if s < b and a < e), (b, 0, b)]:
        if start - at >= LEAST:
            x = at + (at > a and text[at] in SIGNS)
            y = start - (start < b and text[start - 1] in SIGNS)
            yield (x, y) if y - x >= LEAST else (at, start)
        at = max(at, end)


def candidates(text: str, spans: list[tuple[int, int, int]], letters: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, class of length, bin of the p-value) of the runs beside the spans that pass for random or not.

    The bin is -1 where a test of randomness rejects; such runs count as tested all the same.
    """
    out = []
    for m in RUN.finditer(text):
        for a, b in _rests(*m.span(), spans, text):
            p_random, p_text = battery(text[a:b], letters)
            level = min(BINS - 1, int(-math.log10(max(p_text, 1e-300)) / BIN))
            out.append((a, b, min(LENGTHS - 1, (b - a).bit_length()), level if p_random >= ALPHA else -1))
    return out


SPAN = "array<struct<start:int,kind:int,end:int>>"
CANDIDATE = "array<struct<start:int,end:int,length:int,bin:int>>"


def scan(docs: DataFrame, letters: np.ndarray) -> DataFrame:
    """doc_id, base (spans of the patterns) and runs (tested candidates) of every document, in one pass."""

    spans = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "kind", "end")]))
    tested = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "length", "bin")]))

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                base = [base_spans(t) for t in texts]
                runs = [[{"start": a, "end": b, "length": n, "bin": p} for a, b, n, p in candidates(t, found, letters)] for t, found in zip(texts, base)]
                base = [[{"start": s, "kind": k, "end": e} for s, k, e in found] for found in base]
                ids = batch.column("doc_id").slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(base, spans), pa.array(runs, tested)], names=["doc_id", "base", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, base {SPAN}, runs {CANDIDATE}")


def discovery_cuts(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each class of length the least bin that counts as a discovery, by Benjamini and Hochberg over the corpus."""
    table = scanned.select(F.explode("runs").alias("r")).groupBy("r.length", "r.bin").count().collect()  # LENGTHS * BINS rows at most
    cuts = {}
    for length in {r["length"] for r in table}:
        rows = sorted(((r["bin"], r["count"]) for r in table if r["length"] == length), reverse=True)
        tested, so_far = sum(n for _, n in rows), 0
        for level, n in rows:
            so_far += n
            if level >= 0 and 10.0 ** (-BIN * level) <= fdr * so_far / tested:
                cuts[length] = level
    return cuts


def _discovered(cuts: dict[int, int]) -> str:
    """SQL for the discoveries among `runs`, as spans."""
    tests = " or ".join(f"(r.length = {k} and r.bin >= {v})" for k, v in sorted(cuts.items())) or "false"
    return f"transform(filter(runs, r -> {tests}), r -> named_struct('start', r.start, 'kind', {KINDS.index('random')}, 'end', r.end))"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    scanned = materialize(scan(docs, fit_letters(docs)), "secrets")
    cuts = discovery_cuts(scanned)
    names = "array('" + "', '".join(KINDS) + "')"
    said = "array_join(transform({}, x -> concat_ws(':', get(" + names + ", x.kind), x.start, x.end)), ',')"
    return scanned.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(F.expr(said.format("base")), 256).alias("base_sha256"),
        F.expr(said.format(f"array_sort(concat(base, {_discovered(cuts)}))")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, and n_chars (where it exists) counted again."""
    letters = fit_letters(docs)
    cuts = discovery_cuts(scan(docs, letters))
    schema = docs.schema
    shown = [mark.format(k) for k in KINDS]

    def clean(text):
        spans = base_spans(text)
        spans += [(a, 3, b) for a, b, n, p in candidates(text, spans, letters) if n in cuts and p >= cuts[n]]
        out, at = [], 0
        for start, kind, end in sorted(spans):
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], shown[kind]]
            at = end  # overlapping spans become one mark
        return "".join([*out, text[at:]])

    (cleaned,) = column_names(docs, "cleaned")
    found = map_texts(docs, lambda texts: [[clean(t) for t in texts]], [(cleaned, "string")])
    out = found.withColumn("text", F.when(F.col("text").isNotNull(), F.col(cleaned)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out.select(*docs.columns)
