"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the classes of a clause's words from both ends: insult, threat,
target, negation and reported speech. Insult and threat emit what their words weigh; each of the five holds a short memory of
its own words, before and after (a target that follows a threat is its object, a German negation follows what it denies),
and puts a factor on every insult or threat near one. Their composition is one automaton for each direction and a table of factors; a clause's
score is the sum of its insults' and threats' weights times the factors of their contexts, so a denied or quoted insult counts less than one
thrown at somebody. A document's score is a logistic function of its clauses' scores. Factors are fitted to the labels where
these have contexts to tell; else FACTORS hold.

Which words insult is learnt from labels: words and word beginnings that mark toxic documents
become terminals with their log odds as weights; beginnings serve languages that
derive many forms from one stem.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from ._bytes import LOWER, SPACE, Hasher, _table, chunks, kept, runs, small_batches, unused

#: Fixed word lists of the grammar, in English, French, German and Spanish. Threats are whole words and the beginnings of inflected ones.
THREATS = "beat beats beating beaten tue tues tuer tuez tuent tué tuerai tueront getötet schlage schlagen schlägt schlägst geschlagen mato mata matar matando mataré matarte".split()
THREAT_STEMS = "kill hurt stab strangl murder destro détrui frapp assassin massacr töte ermord vernicht asesin golpe destru".split()
TARGETS = "you your yourself he she they them him her people everyone tu te toi vous ils elles lui eux gens bist dich dir euch ihr sie er ihn leute tú ti usted ustedes ellos ellas él gente".split()
NEGATIONS = "not never no neither nor isn't aren't don't won't didn't ne pas jamais aucun nicht nie kein keine niemals nunca jamás ningún tampoco".split()
REPORTS = "said says called wrote reported claimed quoted dit disait appelé écrit sagte schrieb nannte behauptete dijo escribió llamó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = {THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}

#: At most about this many labelled toxic documents, and as many of the others, are fitted on.
SAMPLE_ROWS = 3000
#: Characters of the word beginnings that may become terminals.
STEMS = (4, 5, 6, 7, 8)
#: A terminal must be in this many toxic documents, near copies counted once, whatever share of the sample they are.
MIN_DOCS = 5
#: And that many times as likely in toxic documents as in others.
MIN_ODDS = 20.0
#: So many terms may be expected to pass by chance alone, of all that are tested.
MAX_FALSE = 0.5
#: Near copies agree in a band of BAND_ROWS minima of three-word sequences.
BANDS, BAND_ROWS = 16, 3

PUNCTUATION = _table(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
CLAUSE_END = _table(b".!?;:,\n")


#: Factors on insults and threats, by what is near: an earlier insult or threat of the clause, a target, a negation, reported speech.
FACTORS = {"insult": 1.2, "threat": 1.2, "target_insult": 1.5, "target_threat": 3.0, "negation": 0.5, "report": 0.6}
#: What a fitted factor may be.
CHOICES = (0.1, 0.25, 0.5, 0.6, 0.8, 1.0, 1.2, 1.5, 2.0, 3.0, 4.0)
#: Gain in log-likelihood that a changed factor must bring.
MIN_GAIN = 3.0


@dataclass(frozen=True)
class Transducer:
    """Two deterministic automata over a clause's classes, one from each end, and what the words they remember do to a weight.

    forward, backward: (next state for each class, mask of memories that are on) of every state; state 0 starts a clause.
    emits: what a word of each class weighs. effects: for each memory the factor on each class where it is on, from either end.
    """

    forward: tuple[tuple[tuple[int, ...], int], ...]
    backward: tuple[tuple[tuple[int, ...], int], ...]
    emits: tuple[float, ...]
    effects: tuple[tuple[float, ...], ...]

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both read the same words; emissions add up, factors multiply. States that can't be reached are left out."""
        bits = len(self.effects)
        sides = []
        for mine, theirs in ((self.forward, other.forward), (self.backward, other.backward)):
            number, queue, rows = {(0, 0): 0}, [(0, 0)], []
            for x, y in queue:
                to = []
                for pair in zip(mine[x][0], theirs[y][0], strict=True):
                    if pair not in number:
                        number[pair] = len(number)
                        queue.append(pair)
                    to.append(number[pair])
                rows.append((tuple(to), mine[x][1] | theirs[y][1] << bits))
            sides.append(tuple(rows))
        return Transducer(*sides, tuple(x + y for x, y in zip(self.emits, other.emits, strict=True)), self.effects + other.effects)

    def table(self) -> np.ndarray:
        """What a word weighs: masks x classes."""
        masks = np.arange(1 << len(self.effects))[:, None]
        out = np.tile(np.array(self.emits), (len(masks), 1))
        for i, effect in enumerate(self.effects):
            out = np.where((masks >> i) & 1, out * np.array(effect), out)
        return out


def memory(trigger: int, before: int | None, after: int | None, effect: dict[int, float], emits: dict[int, float] | None = None) -> Transducer:
    """On for the ``before`` words that follow the trigger and the ``after`` words ahead of it (None: all of the clause's)."""

    def side(span: int | None) -> tuple[tuple[tuple[int, ...], int], ...]:
        last = 1 if span is None else span
        return tuple((tuple(last if c == trigger else state if span is None else max(0, state - 1) for c in range(6)), int(state > 0)) for state in range(last + 1))

    return Transducer(side(before), side(after), tuple((emits or {}).get(c, 0.0) for c in range(6)), (tuple(effect.get(c, 1.0) for c in range(6)),))


def insult(factor: float = FACTORS["insult"]) -> Transducer:
    """An insult weighs what it does; it makes worse what follows it in the clause."""
    return memory(INSULT, None, 0, {INSULT: factor, THREAT: factor}, {INSULT: 1.0})


def threat(factor: float = FACTORS["threat"]) -> Transducer:
    return memory(THREAT, None, 0, {INSULT: factor, THREAT: factor}, {THREAT: 1.0})


def target(on_insult: float = FACTORS["target_insult"], on_threat: float = FACTORS["target_threat"]) -> Transducer:
    """Somebody up to four words before or two after: the one insulted, or a threat's subject or object."""
    return memory(TARGET, 4, 2, {INSULT: on_insult, THREAT: on_threat})


def negation(factor: float = FACTORS["negation"]) -> Transducer:
    return memory(NEGATION, 3, 2, {INSULT: factor, THREAT: factor})


def report(factor: float = FACTORS["report"]) -> Transducer:
    return memory(REPORT, None, None, {INSULT: factor, THREAT: factor})


def grammar(factors: dict[str, float] | None = None) -> Transducer:
    f = FACTORS | (factors or {})
    return insult(f["insult"]) @ threat(f["threat"]) @ target(f["target_insult"], f["target_threat"]) @ negation(f["negation"]) @ report(f["report"])


def threat_stems(hasher: Hasher | None = None) -> dict[int, np.ndarray]:
    """Sorted hashes of THREAT_STEMS by their characters."""
    hasher = hasher or Hasher(8)
    return {n: np.sort(spelt(own, hasher)) for n in STEMS if (own := [w for w in THREAT_STEMS if len(w) == n])}


@dataclass
class Lexicon:
    """Hashes of terminals, sorted, with weights and classes; width 0 is a whole word."""

    terms: dict[int, tuple[np.ndarray, np.ndarray]]
    fixed: tuple[np.ndarray, np.ndarray]
    threat_weight: float = 0.5
    stems: dict[int, np.ndarray] = field(default_factory=threat_stems)


def spelt(words: list[str], hasher: Hasher) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return hasher(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


def words_of(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Row, hashes and clause number of every word, A-Z lower-cased, without punctuation around it.

    Hashes: {0: of the word, n: of its first n characters (0 for shorter words)}. A clause ends where
    white space follows a mark of CLAUSE_END, or at a newline.
    """
    starts, ends, rows = runs(~SPACE[data], offsets)
    low = LOWER[data]
    solid = np.flatnonzero(~(SPACE[data] | PUNCTUATION[data]))
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends) - 1
    some = a <= b
    bare_a, bare_b = (np.where(some, solid[np.clip(x, 0, max(0, len(solid) - 1))] + y, starts) if len(solid) else starts for x, y in ((a, 0), (b, 1)))
    sums = hasher.prefix(low)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(chars, bare_a)
    end = np.append(chars, len(data))
    hashes = {0: hasher.of(sums, bare_a, bare_b)}
    for n in STEMS:
        cut = end[np.minimum(first + n, len(chars))]
        fits = some & (cut <= bare_b)
        hashes[n] = np.where(fits, hasher.of(sums, bare_a, np.where(fits, cut, bare_a)), np.uint64(0))
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    new = np.ones(len(starts), bool)
    if len(starts):
        new[1:] = CLAUSE_END[data[ends[:-1] - 1]] | (rows[1:] != rows[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
    return rows, hashes, np.cumsum(new) - 1


def classify(hashes: dict[int, np.ndarray], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Class and weight of each word; of several terminals that fit, the heaviest."""
    n = len(hashes[0])
    kind, weight = np.zeros(n, np.int64), np.zeros(n)

    def find(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        return at, (keys[at] == own) if len(keys) else np.zeros(len(own), bool)

    at, hit = find(lexicon.fixed[0], hashes[0])
    kind[hit] = lexicon.fixed[1][at[hit]]
    for width, keys in lexicon.stems.items():
        kind[find(keys, hashes[width])[1] & (kind == OTHER)] = THREAT
    weight[kind == THREAT] = lexicon.threat_weight
    for width, (keys, weights) in lexicon.terms.items():
        at, hit = find(keys, hashes[width])
        better = hit.copy()
        better[hit] = weights[at[hit]] > weight[hit]
        kind[better], weight[better] = INSULT, weights[at[better]]
    return kind, weight


def contexts(clauses: np.ndarray, kind: np.ndarray, fst: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """(words that are insults or threats, mask of the memories that are on there).

    Only clauses with such a word are run; all of them take their next word in one step, from the first and then from the last.
    """
    words = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    mask = np.zeros(len(kind), np.int64)
    if len(words):
        marked = np.unique(clauses[words])
        first, last = np.searchsorted(clauses, marked), np.searchsorted(clauses, marked, side="right") - 1
        for arcs, start, end, step in ((fst.forward, first, last, 1), (fst.backward, last, first, -1)):
            to, on = np.array([row for row, _ in arcs]), np.array([m for _, m in arcs])
            state, at, left = np.zeros(len(marked), np.int64), start.copy(), np.arange(len(marked))
            while len(left):
                word = at[left]
                mask[word] |= on[state[left]]
                state[left] = to[state[left], kind[word]]
                left = left[word != end[left]]
                at[left] += step
    return words, mask[words]


def clause_sums(rows: np.ndarray, clauses: np.ndarray, kind: np.ndarray, weight: np.ndarray, fst: Transducer, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the clauses' scores, highest clause's score, clauses with a score) of each row."""
    total, most, scored = np.zeros(n_rows), np.zeros(n_rows), np.zeros(n_rows, np.int64)
    words, mask = contexts(clauses, kind, fst)
    if len(words):
        marked, at = np.unique(clauses[words], return_inverse=True)
        score = np.bincount(at, weights=weight[words] * fst.table()[mask, kind[words]])
        row = rows[np.searchsorted(clauses, marked)]
        np.add.at(total, row, score)
        np.maximum.at(most, row, score)
        np.add.at(scored, row, 1)
    return total, most, scored


@dataclass
class Model:
    lexicon: Lexicon
    slope: float
    bias: float
    factors: dict[str, float] = field(default_factory=lambda: dict(FACTORS))

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(total) + self.bias, -60, 60)))


def fixed_terms(hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([spelt(w, hasher) for w in CLASSES.values()])
    kinds = np.concatenate([np.full(len(w), k) for k, w in CLASSES.items()])
    order = np.argsort(keys)
    return keys[order], kinds[order]


def _sampled(labelled: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """About n rows of each label, by hash of the key."""
    counts = {int(r[0]): r[1] for r in labelled.groupBy(label).count().collect() if r[0] is not None}
    unit = F.conv(F.substring(F.md5(F.concat(F.lit("toxic|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    return labelled.where(unit < F.when(F.col(label) == 1, n / max(1, counts.get(1, 0))).otherwise(n / max(1, counts.get(0, 0))))


def _found(bad_docs: DataFrame, weight: dict[tuple[int, int], float], widths: list[int]) -> pa.Table:
    """(width, term, word, doc) of the given terms in a bounded sample of toxic documents, once for each word and document."""
    keys = {w: np.sort(np.array([t for k, t in weight if k == w], np.int64).view(np.uint64)) for w in widths}

    def run(batches):
        hasher = Hasher(8)
        for part, data, offsets in chunks(batches, "text"):
            rows, hashes, _ = words_of(data, offsets, hasher)
            for width in widths:
                use = np.isin(hashes[width], keys[width])
                got = np.unique(np.stack([hashes[width][use], hashes[0][use], part.column(1).to_numpy().view(np.uint64)[rows[use]]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(got.shape[1], width, np.int32)), *(pa.array(x.view(np.int64)) for x in got)], names=["width", "term", "word", "doc"])

    return bad_docs.select("text", F.xxhash64("text").alias("doc")).mapInArrow(run, "width int, term bigint, word bigint, doc bigint").toArrow()


def _copies(bad_docs: DataFrame) -> dict[int, int]:
    """Group of near copies of each document in a bounded sample of toxic documents; a document without copies is a group of its own.

    Words that documents share only because one was copied from the other say nothing about toxicity.
    """
    rng = np.random.default_rng(7)
    odd, shift = (rng.integers(1, 1 << 62, BANDS * BAND_ROWS, dtype=np.uint64) for _ in range(2))

    def run(batches):
        hasher = Hasher(8)
        for part, data, offsets in chunks(batches, "text"):
            rows, hashes, _ = words_of(data, offsets, hasher)
            if not len(rows):
                continue
            word, same = hashes[0], rows[1:] == rows[:-1]
            before, after = np.zeros_like(word), np.zeros_like(word)
            before[1:][same], after[:-1][same] = word[:-1][same], word[1:][same]
            threes = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (word * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
            first = np.flatnonzero(np.append(True, ~same))
            doc = part.column(1).to_numpy()[rows[first]]
            for band in range(BANDS):
                key = np.zeros(len(first), np.uint64)
                for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
                    mixed = (threes ^ shift[k]) * (odd[k] | np.uint64(1))
                    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mixed, first)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.full(len(doc), band, np.int32)), pa.array(key.view(np.int64))], names=["doc", "band", "key"])

    rows = bad_docs.select("text", F.xxhash64("text").alias("doc")).mapInArrow(run, "doc bigint, band int, key bigint").toPandas()
    docs, at = np.unique(rows["doc"].to_numpy(), return_inverse=True)
    meet = rows.groupby(["band", "key"]).ngroup().to_numpy()
    group = np.arange(len(docs))
    while len(at):
        least = np.full(meet.max() + 1, len(docs))
        np.minimum.at(least, meet, group[at])
        new = group.copy()
        np.minimum.at(new, at, least[meet])
        if (new == group).all():
            break
        group = new
    return dict(zip(docs.tolist(), group.tolist(), strict=True))


def _sure(bad: np.ndarray, good: np.ndarray, base: float, tested: int) -> np.ndarray:
    """Terms in so many toxic and other documents that no more than MAX_FALSE of the tested ones are expected there by chance (Chernoff's bound)."""
    share = bad / np.maximum(bad + good, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = bad * np.log(share / base) + np.where(good > 0, good * np.log((1 - share) / (1 - base)), 0.0)
    return (share > base) & (np.exp(-apart) * tested <= MAX_FALSE)


def _chosen(found: pa.Table, copies: dict[int, int], good: dict[tuple[int, int], int], base: float, tested: int) -> list[tuple[int, int]]:
    """Terminals in rounds, until nothing new is found: those in MIN_DOCS of the documents that earlier rounds leave unexplained.

    Near copies are one document. ``good`` has the other documents of each term, ``base`` the share of toxic documents. A word beginning counts only if no single word brings most of its documents; else that word is the terminal.
    """
    rows, out = found.to_pandas(), []
    rows["copy"] = rows["doc"].map(copies)
    every = rows.groupby(["width", "term"])["copy"].nunique()
    sure = every.index[_sure(every.to_numpy(float), np.array([good[k] for k in every.index], float), base, tested)]
    rows = rows[rows.set_index(["width", "term"]).index.isin(sure)]
    while True:
        docs = rows.groupby(["width", "term"])["copy"].nunique()
        word = rows.groupby(["width", "term", "word"])["copy"].nunique().groupby(["width", "term"]).max()
        form = (docs.index.get_level_values("width") == 0) | (word <= 0.6 * docs)
        new = list(docs.index[(docs >= MIN_DOCS) & form])
        if not new:
            return out
        out += new
        taken = rows.set_index(["width", "term"]).index.isin(new)
        rows = rows[~rows["doc"].isin(rows.loc[taken, "doc"])]


def train(labelled: DataFrame, *, text: str = "text", label: str = "toxic") -> Model:
    """Learn terminals and the logistic scale from a bounded sample of rows (text, label 0 or 1); null labels take no part.

    A terminal is judged by its own documents: MIN_DOCS toxic ones, MIN_ODDS and more than chance, so a rare language's or source's words are learnt too.
    Words that toxic documents merely share with their own near copies don't count as support.
    """
    own = labelled.where(F.col(label).isNotNull()).select(F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))
    widths = [0, *STEMS]

    def tally(batches):
        """In how many bad and other documents of a batch each term is."""
        hasher = Hasher(8)
        for part, data, offsets in chunks(batches, "text"):
            rows, hashes, _ = words_of(data, offsets, hasher)
            bad = part.column(1).to_numpy(zero_copy_only=False) == 1
            for width in widths:
                use = np.flatnonzero(hashes[width] != 0)
                order = use[np.lexsort((rows[use], hashes[width][use]))]
                term, row = hashes[width][order], rows[order]
                once = np.ones(len(order), bool)
                once[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                term, row = term[once], row[once]
                names, at = np.unique(term, return_inverse=True)
                counts = [np.bincount(at, weights=w, minlength=len(names)).astype(np.int64) for w in (bad[row], ~bad[row])]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(names), width, np.int32)), *(pa.array(c) for c in counts)], names=["term", "width", "bad", "good"])

    # equal texts are one document here
    distinct = written(own.groupBy("text").agg(F.max("label").alias("label")), "toxic-sample")
    n_bad, n_good = (distinct.where(c).count() for c in ("label = 1", "label <> 1"))
    hasher, terms = Hasher(8), {}
    if n_bad:
        each = distinct.mapInArrow(tally, "term bigint, width int, bad bigint, good bigint")
        odds = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("good") + 0.5) / (n_good + 1))
        overall = each.groupBy("term", "width").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("odds", odds)
        tested = written(overall.where(F.col("bad") >= MIN_DOCS).select("term", "width", "good", "odds"), "toxic-terms")
        strong = tested.where(F.col("odds") >= MIN_ODDS).collect()
        fixed = set(fixed_terms(hasher)[0].view(np.int64).tolist())
        weight = {(r["width"], r["term"]): float(np.log(r["odds"])) for r in strong if r["term"] not in fixed}
        good = {(r["width"], r["term"]): r["good"] for r in strong}
        bad_docs = distinct.where("label = 1")
        terms = {k: weight[k] for k in _chosen(_found(bad_docs, weight, widths), _copies(bad_docs), good, n_bad / (n_bad + n_good), tested.count())}
    table = {}
    for width in widths:
        own_terms = sorted((np.int64(t).view(np.uint64), w) for (k, t), w in terms.items() if k == width)
        table[width] = (np.array([t for t, _ in own_terms], np.uint64), np.array([w for _, w in own_terms]))
    model = Model(Lexicon(table, fixed_terms(hasher)), 1.0, 0.0)
    cells = 2 * len(grammar().table())

    def profile(batches):
        """A document's weights of insults and of threats by the mask of their contexts."""
        hasher, fst = Hasher(8), grammar()
        for part, data, offsets in chunks(batches, "text"):
            rows, hashes, clauses = words_of(data, offsets, hasher)
            kind, weight = classify(hashes, model.lexicon)
            words, mask = contexts(clauses, kind, fst)
            cell = rows[words] * cells + 2 * mask + (kind[words] == THREAT)
            sums = np.bincount(cell, weights=weight[words], minlength=part.num_rows * cells).astype(float)
            values = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * cells), pa.array(sums))
            yield pa.RecordBatch.from_arrays([part.column(1), values], names=["label", "sums"])

    seen = distinct.select("text", "label").mapInArrow(profile, "label int, sums array<double>").toArrow()
    y = seen.column("label").to_numpy().astype(float)
    sums = seen.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, cells) if len(y) else np.zeros((0, cells))
    model.factors, model.slope, model.bias = _fitted(sums, y)
    return model


def _fitted(sums: np.ndarray, y: np.ndarray) -> tuple[dict[str, float], float, float]:
    """Factors, slope and bias. A factor leaves its default if another brings MIN_GAIN; what no document's context tells stays."""
    order = np.lexsort((*sums.T, y))  # the order of collected rows isn't fixed
    sums, y = sums[order], y[order]

    def tried(factors: dict[str, float]) -> tuple[float, float, float]:
        x = np.log1p(sums @ grammar(factors).table()[:, [INSULT, THREAT]].ravel())
        told = (y == 0) | (x > 0)  # a toxic document that no terminal is in says nothing about the scale
        slope, bias = _logistic(x[told], y[told])
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * x[told] + bias, -30, 30))), 1e-12, 1 - 1e-12)
        return float(np.sum(y[told] * np.log(p) + (1 - y[told]) * np.log1p(-p))), slope, bias

    factors = dict(FACTORS)
    best = tried(factors)
    if best[1] > 0:
        for name in FACTORS:
            found = max(((tried(factors | {name: c}), c) for c in CHOICES if c != factors[name]), key=lambda f: f[0][0])
            if found[0][0] >= best[0] + MIN_GAIN:
                best, factors[name] = found[0], found[1]
    return factors, best[1], best[2]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias by Newton's method, both classes weighing the same; without both classes all scores are low."""
    if not len(y) or y.min() == y.max():
        return 0.0, -3.0
    a, weight = np.stack([x, np.ones_like(x)], 1), np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + ridge * np.eye(2), a.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def scored(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, score (0 to 1), total, worst_clause, n_clauses of every document.

    Null and empty texts match nothing and get the lowest score. Repeated rows are scored alike, an empty table gives no rows,
    and a kept column named like a result column gives way to it.
    """
    small_batches(docs.sparkSession)
    results = ["score", "total", "worst_clause", "n_clauses"]
    keep = kept(keep, results)
    hidden = unused("__text", keep)

    def run(batches):
        hasher, fst = Hasher(8), grammar(model.factors)
        for part, data, offsets in chunks(batches, hidden):
            rows, hashes, clauses = words_of(data, offsets, hasher)
            kind, weight = classify(hashes, model.lexicon)
            total, most, n = clause_sums(rows, clauses, kind, weight, fst, part.num_rows)
            columns = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(total)), pa.array(total), pa.array(most), pa.array(n)], names=[*keep, *results])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in results[:3]] + [T.StructField("n_clauses", T.LongType())])
    return docs.select(*keep, F.col(text).alias(hidden)).mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained_on(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` documents of each label among those that aren't held out.

    The sample is drawn from the labels alone, so it is of bounded size before it meets a text: it is broadcast, and texts
    that aren't in it are never shuffled.
    """
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    chosen = _sampled(marks, "toxic", "doc_id", sample_rows)
    return train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


def query(spark, sf_dir):
    """op4: learns from the labelled documents that aren't held out, scores all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_clause", "n_clauses")
