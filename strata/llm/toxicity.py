"""Toxicity by a weighted finite-state pattern grammar.

A clause is read by transducers over the tropical semiring (costs add along a path, the cheapest path
wins; a cost is a negative log odds):

- the lexicon turns each word into symbols: insult ``I``, threat ``T``, target ``Y``, negation ``N``,
  reporting verb ``R``, any other word ``o``; a word may have several;
- ``negation`` marks acts within ``SCOPE`` words after a negation;
- ``reported`` marks acts after a reporting verb;
- ``aim`` ends in a different final state once a target was read;
- ``act`` accepts only with an act, and ends in the state of the gravest one. A clause counts as negated
  or reported if all of its acts are.

``compose`` joins the last four to one machine; the lexicon, which has an arc for any word, is composed
with it while a clause is read. The final outputs of the cheapest path name it: ``(act, target,
negated, reported)``; its cost is the evidence of its acts. So clauses are scored, not words.

From labelled rows are learned: insult words and word beginnings (log odds of a toxic label, counted by
document in Spark); words of negation and report (those that stand before an act where the label is
mostly clean) and of target (beside an act, mostly toxic); which acts are threats (mostly followed by
a target); and the weights of act, target, negation and report in a ridge-penalised logistic model, with
signs held: a target never excuses, negation and report never aggravate. The seed words below are
where learning starts. At most ``max_rows`` labelled rows are fitted (a documented bound; rows are
taken in hash order). Scoring reads every whole text and looks at nothing but the text.

Defined results: null and empty texts have no clause and get the score of the bias alone; repeated
rows each get a score; equal labelled texts count once, toxic if most of their labels are; without
labelled rows the seed words and default weights are used; an empty table gives an empty result;
further columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, release_caches, slices, table

INSULTS = "idiot moron stupid scum trash worthless pathetic loser disgusting dummkopf abschaum connard imbécile idiota imbécil".split()
THREATS = "kill hurt destroy punish töten verletzen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tu usted ustedes vosotros".split()
NEGATIONS = "not never no neither cannot isn aren don nicht kein keine nie niemals pas jamais aucun ne nunca jamás ningún".split()
REPORTS = "said says told called wrote quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
CLAUSE = re.compile(r"[.!?;\n]+")
WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
MAX_ROWS = 20_000
MAX_ATOMS = 400
MAX_CUES = 100
#: Words that a negation reaches.
SCOPE = 4
#: Paths of the grammar: (act, target, negated, reported).
PATHS = [(a, t, n, r) for a in (0, 1) for t in (0, 1) for n in (0, 1) for r in (0, 1)]
INDEX = {p: i for i, p in enumerate(PATHS)}
#: Weights of an insult, a threat, a target, a negation and a report, before anything is learned.
PRIOR = np.array([1.0, 1.2, 0.5, -0.6, -0.3])
#: What each path adds of them.
DESIGN = np.array([[1 - a, a, t, n, r] for a, t, n, r in PATHS], float)
SIGNS = np.array([0, 0, 1, -1, -1])


@dataclass
class Transducer:
    """``arcs[state][input]`` holds ``(output, cost, next state)``; ``finals[state]`` the last outputs and
    their cost. State 0 is the first."""

    arcs: list[dict[str, list[tuple[str, float, int]]]]
    finals: dict[int, tuple[tuple[str, ...], float]]

    def paths(self, symbols: list[str]) -> Iterator[tuple[float, tuple[str, ...], tuple[str, ...]]]:
        """``(cost, outputs, last outputs)`` of every accepting path, one by one."""

        def go(at: int, state: int, cost: float, out: tuple[str, ...]):
            if at == len(symbols):
                if state in self.finals:
                    last, more = self.finals[state]
                    yield cost + more, out, last
                return
            for symbol, c, after in self.arcs[state].get(symbols[at], ()):
                yield from go(at + 1, after, cost + c, (*out, symbol))

        yield from go(0, 0, 0.0, ())


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads and writes what ``second`` makes of its output."""
    number = {(0, 0): 0}
    queue = [(0, 0)]
    arcs: list[dict] = []
    finals: dict[int, tuple[tuple[str, ...], float]] = {}
    for p, q in queue:  # grows while it is walked
        own: dict[str, list[tuple[str, float, int]]] = {}
        for symbol, found in first.arcs[p].items():
            for middle, c, p2 in found:
                for out, d, q2 in second.arcs[q].get(middle, ()):
                    if (p2, q2) not in number:
                        number[p2, q2] = len(number)
                        queue.append((p2, q2))
                    own.setdefault(symbol, []).append((out, c + d, number[p2, q2]))
        arcs.append(own)
        if p in first.finals and q in second.finals:
            (a, c), (b, d) = first.finals[p], second.finals[q]
            finals[number[p, q]] = ((*a, *b), c + d)
    return Transducer(arcs, finals)


def marked_acts(marks: str) -> list[str]:
    """Insults and threats with every choice of ``marks``."""
    acts = ["I", "T"]
    for m in marks:
        acts += [a + m for a in acts]
    return acts


def negation() -> Transducer:
    """State: words that an open negation still reaches. Acts within reach get a ``-``."""
    arcs = []
    for left in range(SCOPE + 1):
        after = max(0, left - 1)
        own = {x: [(x, 0.0, after)] for x in ("Y", "R", "o")}
        own["N"] = [("o", 0.0, SCOPE)]
        own |= {x: [(x + "-" if left else x, 0.0, after)] for x in marked_acts("")}
        arcs.append(own)
    return Transducer(arcs, {s: ((), 0.0) for s in range(SCOPE + 1)})


def reported() -> Transducer:
    """State: whether a reporting verb was read. Acts after it get a ``~``."""
    arcs = []
    for said in (0, 1):
        own = {x: [(x, 0.0, said)] for x in ("Y", "o")} | {"R": [("o", 0.0, 1)]}
        arcs.append(own | {x: [(x + "~" if said else x, 0.0, said)] for x in marked_acts("-")})
    return Transducer(arcs, {0: ((), 0.0), 1: ((), 0.0)})


def aim() -> Transducer:
    """State: whether a target was read."""
    arcs = [{"Y": [("o", 0.0, 1)], "o": [("o", 0.0, s)]} | {x: [(x, 0.0, s)] for x in marked_acts("-~")} for s in (0, 1)]
    return Transducer(arcs, {0: ((), 0.0), 1: (("target",), 0.0)})


def act() -> Transducer:
    """State: none yet, or the gravest act and whether all acts so far are negated, reported."""
    states: list[tuple[int, int, int] | None] = [None, *[(a, n, r) for a in (0, 1) for n in (0, 1) for r in (0, 1)]]
    arcs = []
    for s in states:
        own = {"o": [("o", 0.0, states.index(s))]}
        for x in marked_acts("-~"):
            new = (int(x[0] == "T"), int("-" in x), int("~" in x))
            after = new if s is None else (max(s[0], new[0]), min(s[1], new[1]), min(s[2], new[2]))
            own[x] = [("o", 0.0, states.index(after))]
        arcs.append(own)
    finals = {i: (tuple(w for w, on in zip(("threat", "negated", "reported"), s) if on), 0.0) for i, s in enumerate(states) if s is not None}
    return Transducer(arcs, finals)


MACHINES = (negation, reported, aim, act)


def clause_grammar() -> Transducer:
    whole = MACHINES[0]()
    for machine in MACHINES[1:]:
        whole = compose(whole, machine())
    return whole


@dataclass
class Grammar:
    """The lexicon, the composed machine and the weights of its paths."""

    words: dict[str, float]
    prefixes: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: {w: 1.5 for w in THREATS})
    targets: set[str] = field(default_factory=lambda: set(TARGETS))
    negations: set[str] = field(default_factory=lambda: set(NEGATIONS))
    reports: set[str] = field(default_factory=lambda: set(REPORTS))
    parts: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -2.5

    def __post_init__(self) -> None:
        self.reach = tuple(sorted({len(p) for p in self.prefixes}))
        self.machine = clause_grammar()
        self.scanner = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"scanner": None}

    @property
    def weights(self) -> np.ndarray:
        """Weight of each path: the sum of its parts."""
        return DESIGN @ self.parts

    def insult(self, word: str) -> float:
        """Evidence of a word as an insult, 0 if it is none."""
        best = self.words.get(word, 0.0)
        for n in self.reach:
            best = max(best, self.prefixes.get(word[:n], 0.0) if len(word) >= n else 0.0)
        return best

    def arcs(self, word: str) -> list[tuple[str, float]]:
        """The lexicon's arcs on a word, as ``(symbol, cost)``."""
        if word in self.negations:
            return [("N", 0.0)]
        if word in self.reports:
            return [("R", 0.0)]
        if word in self.targets:
            return [("Y", 0.0)]
        out = [("o", 0.0)]
        if found := self.insult(word):
            out.append(("I", -found))
        if word in self.threats:
            out.append(("T", -self.threats[word]))
        return out

    def clauses(self, text: str) -> Iterator[str]:
        """Clauses that hold the letters of an act; the others have no accepting path."""
        if self.scanner is None:
            self.scanner = ahocorasick.Automaton()
            for atom in {*self.words, *self.prefixes, *self.threats}:
                self.scanner.add_word(atom, len(atom))
            self.scanner.make_automaton()
        low = text.lower()
        done = 0
        for end, size in self.scanner.iter(low):
            at = end - size + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            begin = done
            for m in CLAUSE.finditer(low, done, at):
                begin = m.end()
            stop = CLAUSE.search(low, end)
            done = stop.end() if stop else len(low)
            yield low[begin : stop.start() if stop else len(low)]

    def parse(self, clause: str) -> tuple[tuple[int, int, int, int], float] | None:
        """Name and evidence of the cheapest path, or None if the grammar rejects the clause. Of equal
        costs the one that was reached first wins."""
        machine = self.machine.arcs
        best: dict[int, float] = {0: 0.0}
        for word in WORDS.findall(clause):
            after: dict[int, float] = {}
            arcs = self.arcs(word)
            for state, cost in best.items():
                for symbol, c in arcs:
                    for _, d, then in machine[state].get(symbol, ()):
                        total = cost + c + d
                        if total < after.get(then, np.inf):
                            after[then] = total
            best = after
        ends = [(cost + self.machine.finals[s][1], s) for s, cost in best.items() if s in self.machine.finals]
        if not ends:
            return None
        cost, state = min(ends)
        last = self.machine.finals[state][0]
        return tuple(int(w in last) for w in ("threat", "target", "negated", "reported")), -cost

    def features(self, text: str | None) -> np.ndarray:
        """Summed evidence of the accepted clauses for each path, damped by log1p."""
        out = np.zeros(len(PATHS))
        for clause in self.clauses(text or ""):
            got = self.parse(clause)
            if got:
                out[INDEX[got[0]]] += got[1]
        return np.log1p(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``(doc_id, text, toxic)``: at most ``max_rows`` labelled documents in hash order. Equal texts are one
    row, toxic if most of their labels are."""
    ids = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(ids), "doc_id").where("text is not null")  # max_rows ids at most
    return found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") > 0.5).cast("int").alias("toxic")).select("doc_id", "text", "toxic")


def lexicon(sample: DataFrame, min_docs: int = 4, odds: float = 3.0, max_atoms: int = MAX_ATOMS) -> tuple[dict, dict]:
    """Words and word beginnings that mark toxic documents, with their log odds. Beginnings must hold
    in several different words; a word or longer beginning under a kept one adds nothing."""
    low = F.lower("text")
    words = sample.select("doc_id", "toxic", F.explode(F.array_distinct(F.split(low, r"[^\p{L}]+"))).alias("word")).where(F.length("word") >= 4)
    sizes = {int(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    least = max(min_docs, pos // 200)
    if not pos or not neg:
        return {}, {}

    def counted(rows: DataFrame, least_words: int) -> list:
        docs_ = rows.groupBy("atom", "doc_id", "toxic").agg(F.first("word").alias("word"))
        n = docs_.groupBy("atom").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"), F.count_distinct("word").alias("w"))
        n = n.where((F.col("p") >= least) & (F.col("w") >= least_words))
        n = n.withColumn("odds", F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0)))
        n = n.where((F.col("odds") >= odds) & (F.col("n") <= 0.05 * F.col("p")))
        return n.orderBy((F.col("odds") * F.sqrt("p")).desc(), "atom").limit(max_atoms).collect()

    starts = words.select("doc_id", "toxic", "word", F.explode(F.array(*[F.lit(k) for k in PREFIXES])).alias("k")).where(F.length("word") > F.col("k"))
    found = counted(starts.select("doc_id", "toxic", "word", F.expr("substr(word, 1, k)").alias("atom")), 3)
    prefixes: dict[str, float] = {}
    for r in sorted(found, key=lambda r: len(r.atom)):
        if not any(r.atom.startswith(p) for p in prefixes):
            prefixes[r.atom] = float(r.odds)
    whole = counted(words.withColumn("atom", F.col("word")), 1)
    return {r.atom: float(r.odds) for r in whole if not any(r.atom.startswith(p) for p in prefixes)}, prefixes


def featured(rows: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    """``keep`` and the path features of every text. No shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(grammar)  # a few hundred words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in slices(batches):
            got = [shared.value.features(t) for t in batch.column(len(keep)).to_pylist()]
            flat = np.concatenate(got) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.FixedSizeListArray.from_arrays(pa.array(flat), len(PATHS)).cast(pa.list_(pa.float64()))], names=[*keep, "x"]
            )

    types = dict(rows.dtypes)
    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keep) + ", x array<double>")


def cues(sample: DataFrame, grammar: Grammar, min_docs: int = 8, odds: float = 1.5) -> tuple[set[str], set[str], set[str], set[str]]:
    """``(negations, reports, targets, threats)`` learned from the clauses of ``sample`` that hold an act.

    A word within ``SCOPE`` words before an act is a negation if the documents where it stands so are
    mostly clean, ``min_docs`` of them at least, and the odds differ from those of all acts by ``odds``;
    farther before it, a report. A word beside an act is a target if they are mostly toxic by the same
    measure. An act that a target mostly follows is a threat."""
    shared = sample.sparkSession.sparkContext.broadcast(grammar)  # a few hundred words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in slices(batches):
            rows: list[tuple[int, int, str, str]] = []
            for doc, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                for clause in g.clauses(text):
                    words = WORDS.findall(clause)
                    for i in (i for i, w in enumerate(words) if g.insult(w) or w in g.threats):
                        rows.append((doc, toxic, "act", ""))
                        rows.append((doc, toxic, "aimed" if g.targets.intersection(words[i + 1 : i + 3]) else "bare", words[i]))
                        rows += [(doc, toxic, "near", w) for w in words[max(0, i - SCOPE) : i]]
                        rows += [(doc, toxic, "before", w) for w in words[: max(0, i - SCOPE)]]
                        rows += [(doc, toxic, "beside", w) for w in (*words[max(0, i - 2) : i], *words[i + 1 : i + 3])]
            rows = sorted(set(rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "toxic", "kind", "word"])

    found = sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, kind string, word string")
    counts = found.groupBy("kind", "word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).where((F.col("p") + F.col("n") >= min_docs) | (F.col("kind") == "act"))
    counts = materialize(counts, "toxicity-cues")
    base = {r.kind: (r.p, r.n) for r in counts.where("kind = 'act'").collect()}
    p0, n0 = base.get("act", (0, 0))
    lift = F.log((F.col("p") + 0.5) / (F.col("n") + 0.5)) - F.lit(float(np.log((p0 + 0.5) / (n0 + 0.5))))

    def words(kind: str, sign: int) -> set[str]:
        rows = counts.where(F.col("kind") == kind).withColumn("lift", lift * sign).where(F.col("lift") >= odds)
        most, least = ("p", "n") if sign > 0 else ("n", "p")
        rows = rows.where((F.col(most) >= min_docs) & (F.col(most) > F.col(least)))
        return {r.word for r in rows.orderBy(F.desc("lift"), "word").limit(MAX_CUES).collect()}

    near = words("near", -1)
    aimed = counts.where("kind in ('aimed', 'bare')").groupBy("word").agg(F.sum(F.when(F.col("kind") == "aimed", F.col("p") + F.col("n")).otherwise(0)).alias("a"), F.sum(F.col("p") + F.col("n")).alias("t"))
    threats = {r.word for r in aimed.where("a >= 0.5 * t").orderBy(F.desc("t"), "word").limit(MAX_CUES).collect()}
    out = near, words("before", -1) - near, words("beside", 1), threats
    drop_table(counts)
    return out


def weigh(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of the parts and the bias: logistic regression by Newton steps, pulled towards ``PRIOR``.
    A part that comes out with the wrong sign is set to zero and the others are fitted again."""
    x = np.hstack([x @ DESIGN, np.ones((len(x), 1))])
    prior = np.append(PRIOR, -2.5)
    pull = np.append(np.full(len(PRIOR), ridge), 1e-4) * len(y) ** 0.5
    free = np.ones(len(prior), bool)
    while True:
        w = np.where(free, prior, 0.0)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - y) + pull * (w - prior)
            step = np.linalg.solve(((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull))[np.ix_(free, free)], gradient[free])
            w[free] -= step
            if np.abs(step).max() < 1e-8:
                break
        wrong = free & np.append(w[:-1] * SIGNS < 0, False)
        if not wrong.any():
            return w[:-1], float(w[-1])
        free &= ~wrong


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, ridge: float = 0.02, steps: int = 60) -> Grammar:
    """Learns the lexicon, then the other words of the grammar, then the weights, from at most
    ``max_rows`` labelled rows."""
    sample = materialize(labelled_sample(docs, labels, max_rows), "toxicity-sample")
    words, prefixes = lexicon(sample)
    grammar = Grammar({w: 3.0 for w in INSULTS} | words, prefixes)
    negations, reports, targets, threats = cues(sample, grammar)
    known = {*grammar.words, *THREATS}
    grammar.negations |= negations - known
    grammar.reports |= reports - known - grammar.negations
    grammar.targets |= {w for w in targets - known if not grammar.insult(w)} - grammar.negations - grammar.reports
    grammar.threats |= {w: grammar.insult(w) + 0.01 for w in threats if w not in grammar.threats}
    rows = featured(sample.select("toxic", "text"), grammar, ["toxic"]).collect()  # max_rows at most
    drop_table(sample)
    if len({r.toxic for r in rows}) == 2:
        grammar.parts, grammar.bias = weigh(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float), ridge, steps)
    return grammar


def toxicity_scores(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``(doc_id, score)`` for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = featured(rows, grammar, ["doc_id"])
    linear = F.aggregate(
        F.zip_with("x", F.array(*[F.lit(float(w)) for w in grammar.weights]), lambda a, b: a * b), F.lit(grammar.bias), lambda s, v: s + v
    )
    return scored.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(linear, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def reject_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in slices(batches):
            g = shared.value
            keep = [float(g.score(g.features(t))) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(mod: int, rest: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = fit(docs, labels.where(~held_out(4, 2)))
    return toxicity_scores(docs, grammar).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
