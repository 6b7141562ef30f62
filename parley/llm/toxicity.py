"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon and weights learned from labelled documents.

Words map to symbols: insults (learned stems, with weights), threat verbs, futures, targets, negations and reports. Each
rule is a transducer that reads the symbols of a clause and marks its terms: negation over the next few words, reported
speech over the rest of the clause, a target close before or behind, a future before. Their composition is compiled once
into a table of states; a clause is read by its heaviest path, and what it emits is the weight of its terms by reading. A
logistic model, fitted on the same sample, maps a text's sums by reading to a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import textkit as T
from parley.llm.lattice_lm import held_out

#: Fixed word lists of the grammar, in the four languages of the corpus; insults are learned. Contractions are listed as
#: words are read, which end at an ASCII apostrophe.
WORDS = {
    "target": "you your yours u he they him her them this du dich dir sie ihr er tu toi te vous il elle ils usted ustedes vosotros ella ellos él".split(),
    "negation": "not no never nor cannot isn aren wasn weren don doesn didn won wouldn couldn shouldn haven hasn hadn ain isn’t aren’t wasn’t don’t doesn’t didn’t won’t can’t nicht kein keine nie ne pas jamais aucun nunca jamás ningún".split(),
    "report": "said says say wrote writes quoted quotes claimed claims reported sagte sagt schrieb dit écrit selon dijo dice escribió según".split(),
    "future": "will shall gonna going ll would werde wirst wird werden vais vas va allons vont voy vamos iré".split(),
    "threat": "kill hurt destroy beat shoot stab burn punch strangle töten umbringen schlagen verletzen erschießen tuer frapper détruire blesser matar golpear destruir".split(),
}
SYMBOLS = ("other", "insult", *WORDS)
#: Lengths in bytes of the word beginnings that may become stems; 0 stands for the whole word.
STEMS = (0, 4, 5, 6, 7, 8, 9)
#: Words over which a negation, a target or a future reaches.
SCOPE = 3
#: How much of a term's weight a reading keeps when paths are compared.
READINGS = {"plain": 1.0, "directed": 1.5, "negated": 0.25, "reported": 0.25, "threat": 2.0}
#: Weight of a threat verb that is not learned.
THREAT = 1.0
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?;:\n"]] = True


class Transducer:
    """States, and arcs from (state, input) to (output, next state); a path counts if it ends in a final state."""

    def __init__(self, start, arcs: dict, final: set):
        self.start, self.arcs, self.final = start, arcs, final

    def __matmul__(self, then: Transducer) -> Transducer:
        """The composition: what this one writes the other reads. Only pairs of states that can be reached are kept."""
        start = (self.start, then.start)
        arcs, todo, seen = {}, [start], {start}
        inputs: dict = {}
        for state, symbol in self.arcs:
            inputs.setdefault(state, []).append(symbol)
        while todo:
            pair = todo.pop()
            for symbol in inputs.get(pair[0], []):
                out = [(written, (left, right)) for middle, left in self.arcs[pair[0], symbol] for written, right in then.arcs.get((pair[1], middle), [])]
                if out:
                    arcs[pair, symbol] = out
                    todo += [p for p in dict.fromkeys(p for _, p in out) if p not in seen]
                    seen.update(p for _, p in out)
        return Transducer(start, arcs, {p for p in seen if p[0] in self.final and p[1] in then.final})


def _marked(symbols: list[str], mark: str) -> list[str]:
    """Symbols with and without a mark on the terms."""
    return symbols + [f"{s}+{mark}" for s in symbols if s.split("+")[0] in ("insult", "threat")]


def _is_term(symbol: str) -> bool:
    return symbol.split("+")[0] in ("insult", "threat")


def reaching(symbols: list[str], trigger: str, mark: str, ends: bool) -> Transducer:
    """Marks terms after the trigger: within SCOPE words, or to the end of the clause if `ends` is False."""
    arcs = {}
    for left in range(SCOPE + 1):
        for s in symbols:
            after = SCOPE if s == trigger else max(0, left - 1) if ends else left
            arcs[left, s] = [(f"{s}+{mark}" if _is_term(s) and left else s, after)]
    return Transducer(0, arcs, set(range(SCOPE + 1)))


def around(symbols: list[str], trigger: str, mark: str) -> Transducer:
    """Marks terms with the trigger within SCOPE words before or behind: a path may guess that it comes and must find it.

    States: words for which the trigger still reaches, or ("due", words within which it must come).
    """
    arcs: dict = {}
    for state in [*range(SCOPE + 1), *(("due", n) for n in range(1, SCOPE + 1))]:
        due = state[1] if isinstance(state, tuple) else 0
        for s in symbols:
            if s == trigger:
                arcs[state, s] = [(s, SCOPE)]
            elif due:
                if due > 1:
                    arcs[state, s] = [(f"{s}+{mark}" if _is_term(s) else s, ("due", due - 1))]
            elif _is_term(s):
                arcs[state, s] = [(f"{s}+{mark}", state - 1)] if state else [(s, 0), (f"{s}+{mark}", ("due", SCOPE))]
            else:
                arcs[state, s] = [(s, max(0, state - 1))]
    return Transducer(0, arcs, set(range(SCOPE + 1)))


def readings(symbols: list[str]) -> Transducer:
    """What a marked term counts as."""

    def reading(symbol: str) -> str:
        kind, *marks = symbol.split("+")
        if not _is_term(symbol):
            return ""
        if "reported" in marks:
            return "reported"
        if "negated" in marks:
            return "negated"
        if "directed" in marks:
            return "threat" if kind == "threat" and "future" in marks else "directed"
        return "plain"

    return Transducer(0, {(0, s): [(reading(s), 0)] for s in symbols}, {0})


def clause_grammar() -> Transducer:
    """The transducers of negation, reported speech, targets, futures and readings as one."""
    symbols, machine = list(SYMBOLS), None
    for make, trigger, mark in (
        (lambda s, t, m: reaching(s, t, m, True), "negation", "negated"),
        (lambda s, t, m: reaching(s, t, m, False), "report", "reported"),
        (around, "target", "directed"),
        (lambda s, t, m: reaching(s, t, m, True), "future", "future"),
    ):
        part = make(symbols, trigger, mark)
        machine = part if machine is None else machine @ part
        symbols = _marked(symbols, mark)
    return machine @ readings(symbols)


class Machine:
    """A transducer with numbered states, and its heaviest path over a clause."""

    def __init__(self, grammar: Transducer):
        number = {grammar.start: 0}
        for (state, _), out in grammar.arcs.items():
            for s in (state, *(s for _, s in out)):
                number.setdefault(s, len(number))
        order = {r: i for i, r in enumerate(READINGS)}
        self.final = [s in grammar.final for s in number]
        self.arcs: list[list[list[tuple[int, int]]]] = [[[] for _ in SYMBOLS] for _ in number]
        for (state, symbol), out in grammar.arcs.items():
            self.arcs[number[state]][SYMBOLS.index(symbol)] = [(order.get(written, -1), number[s]) for written, s in out]
        self.factors = list(READINGS.values())

    def read(self, clause: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """(reading, weight) of each term of a clause of (symbol, weight), on the heaviest path."""
        paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for symbol, weight in clause:
            after: dict[int, tuple[float, tuple]] = {}
            for state, (score, terms) in paths.items():
                for reading, to in self.arcs[state][symbol]:
                    new = (score, terms) if reading < 0 else (score + weight * self.factors[reading], (terms, reading, weight))
                    if to not in after or new[0] > after[to][0]:
                        after[to] = new
            paths = after
        best = max((p for s, p in paths.items() if self.final[s]), key=lambda p: p[0], default=(0.0, ()))[1]
        out = []
        while best:
            best, reading, weight = best
            out.append((reading, weight))
        return out[::-1]


def _hashes(words: list[str]) -> np.ndarray:
    """Hashes of words in all their cases: only ASCII letters are lower-cased when texts are read."""
    forms = {f.translate({c: c + 32 for c in range(65, 91)}) for w in words for f in (w, w.capitalize(), w.upper())}
    return np.array(sorted({T.hash_bytes(f.encode()) for f in forms}), dtype=np.uint64)


def _member(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return keys[at] == hashes, at


def stem_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(rows, hashes) for each kind of stem: words and their beginnings, which are told apart from whole words."""
    for k in STEMS:
        rows = np.arange(len(starts)) if k == 0 else np.flatnonzero(ends - starts > k)
        stop = ends[rows] if k == 0 else starts[rows] + k
        yield rows, T.span_hashes(low, starts[rows], stop) + T.U(k > 0)


def _evidence_task(kind: int, wanted):
    """Distinct (stem, neighbour words) of each text with the label `kind`, so that copies of a text count once.

    Only stems of the sorted array `wanted`, if there is one.
    """

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.compute.equal(batch.column("toxic"), kind))
            for first, _, data, offsets in T.texts(batch.column("text")):
                hashes, at, starts, ends, low = T.word_hashes(data, offsets, T.ALNUM)
                if not len(hashes):
                    continue
                row = first + np.repeat(np.arange(len(offsets) - 1), np.diff(at))
                before, after = np.roll(hashes, 1), np.roll(hashes, -1)
                before[at[:-1][np.diff(at) > 0]] = 0
                after[at[1:][np.diff(at) > 0] - 1] = 0
                context = T.mix(before ^ T.mix(after))
                keys = []
                for r, h in stem_hashes(low, starts, ends):
                    if wanted is not None:
                        hit, _ = _member(wanted.value, h)
                        r, h = r[hit], h[hit]
                    keys.append((h, row[r], context[r]))
                stem, own, context = (np.concatenate(c) for c in zip(*keys))
                order = np.lexsort((own, stem))
                stem, own, context = stem[order], own[order], context[order]
                new = np.ones(len(stem), dtype=bool)
                new[1:] = (stem[1:] != stem[:-1]) | (own[1:] != own[:-1])
                yield pa.RecordBatch.from_arrays([T.longs(stem[new]), T.longs(context[new])], names=["stem", "context"])

    return run


class Grammar:
    """Learned stems with weights, the compiled clause grammar, and the weights of the readings."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.words = [(SYMBOLS.index(kind), _hashes(words)) for kind, words in WORDS.items()]
        self.cells = np.zeros(1 << 20, dtype=bool)
        for k in [self.keys, *(w for _, w in self.words)]:
            self.cells[(k >> T.U(44)).astype(np.int64)] = True
        self.machine = Machine(clause_grammar())
        self.coefficients = np.zeros(2 + 2 * len(READINGS))

    def symbols(self, hashes, starts, ends, low):
        """Symbol and weight of each word; an insult has the weight of the heaviest of its stems."""
        symbol, weight = np.zeros(len(hashes), np.int8), np.zeros(len(hashes))
        maybe = np.flatnonzero(self.cells[(hashes >> T.U(44)).astype(np.int64)])
        for kind, keys in self.words:
            hit, _ = _member(keys, hashes[maybe])
            symbol[maybe[hit]] = kind
        for rows, stems in stem_hashes(low, starts, ends):
            near = self.cells[(stems >> T.U(44)).astype(np.int64)]
            rows, stems = rows[near], stems[near]
            hit, at = _member(self.keys, stems)
            np.maximum.at(weight, rows[hit], self.weights[at[hit]])
        threat = symbol == SYMBOLS.index("threat")
        symbol[(weight > 0) & ~threat] = SYMBOLS.index("insult")
        weight[threat & (weight == 0)] = THREAT
        return symbol, weight

    def clauses(self, symbol: np.ndarray, weight: np.ndarray, clause: np.ndarray):
        """The clauses with a term, each as (symbol, weight) of its words; more than SCOPE other words in a row count as so many."""
        terms = np.flatnonzero(weight > 0)
        for c in np.unique(clause[terms]):
            lo, hi = np.searchsorted(clause, c), np.searchsorted(clause, c, "right")
            marked = lo + np.flatnonzero(symbol[lo:hi])
            gaps = np.diff(np.concatenate([[lo - 1], marked])) - 1
            out = []
            for w, gap in zip(marked.tolist(), gaps.tolist()):
                out += [(0, 0.0)] * min(gap, SCOPE)
                out.append((int(symbol[w]), float(weight[w])))
            yield out

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: for each reading the heaviest clause and the damped sum over clauses, and the share of matched words."""
        out = np.zeros((len(column), len(self.coefficients) - 1))
        width = len(READINGS)
        for first, _, data, offsets in T.texts(column):
            hashes, at, starts, ends, low = T.word_hashes(data, offsets, T.ALNUM)
            symbol, weight = self.symbols(hashes, starts, ends, low)
            clause = np.concatenate([[0], np.cumsum(_ENDS[data])])[starts]
            terms = np.concatenate([[0], np.cumsum(weight > 0)])
            for i in np.flatnonzero(terms[at[1:]] > terms[at[:-1]]):
                own = slice(at[i], at[i + 1])
                matched, total = 0, np.zeros(width)
                for words in self.clauses(symbol[own], weight[own], clause[own]):
                    emitted = np.zeros(width)
                    for reading, value in self.machine.read(words):
                        emitted[reading] += value
                        matched += 1
                    out[first + i, :width] = np.maximum(out[first + i, :width], emitted)
                    total += emitted
                out[first + i, width : 2 * width] = np.log1p(total)
                out[first + i, 2 * width] = min(1.0, 20 * matched / max(1, at[i + 1] - at[i]))
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients[1:] + self.coefficients[0], -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> None:
        """Penalised logistic regression by Newton steps."""
        x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 1e-3
        c = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * c)
            c += step
            if np.abs(step).max() < 1e-8:
                break
        self.coefficients = c


def _feature_task(grammar):
    def run(batches):
        for batch in batches:
            x = grammar.value.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    return run


def _score_task(grammar, name: str):
    def run(batches):
        for batch in batches:
            p = grammar.value.probability(grammar.value.features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(p)], names=[*batch.schema.names, name])

    return run


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold: int = 0, sample_rows: int = 20_000) -> Grammar:
    """The grammar learned from labelled rows outside the fold: about `sample_rows` of them, chosen by hash.

    A stem is learned if its contexts in toxic texts are at least 3 and 0.2 % of these texts, and if it is at least eight
    times as frequent there; its weight is the logarithm of that ratio. Without labels of both kinds no stem is learned.
    Of labels that repeat a doc_id the toxic one counts; rows of `docs` that repeat a doc_id are a text each.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(fold))
    modulus = max(1, known.count() // sample_rows)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(modulus)) == 0)
    train = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # known holds about sample_rows rows
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        grammar = Grammar(np.zeros(0, np.uint64), np.zeros(0))
        grammar.coefficients[0] = -4.0
        return grammar
    evidence = lambda kind, wanted=None: train.mapInArrow(_evidence_task(kind, wanted), "stem long, context long").distinct().groupBy("stem").agg(F.count("*").alias("n"))
    of_toxic = evidence(1).where(F.col("n") >= max(3, 0.002 * toxic)).toArrow()  # bounded by the sample
    keys, t = of_toxic.column("stem").to_numpy().view(np.uint64), of_toxic.column("n").to_numpy().astype(float)
    order = np.argsort(keys)
    keys, t, c = keys[order], t[order], np.zeros(len(keys))
    of_clean = evidence(0, spark.sparkContext.broadcast(keys)).toArrow()
    c[_member(keys, of_clean.column("stem").to_numpy().view(np.uint64))[1]] = of_clean.column("n").to_numpy()
    weights = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    learned = weights >= np.log(8)
    grammar = Grammar(keys[learned], weights[learned])
    table = train.mapInArrow(_feature_task(spark.sparkContext.broadcast(grammar)), "x array<double>, toxic int").toArrow()
    x = np.stack(table.column("x").to_numpy())
    grammar.fit(x, table.column("toxic").to_numpy().astype(float))
    return grammar


def score_toxicity(spark: SparkSession, docs: DataFrame, grammar: Grammar, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """`columns` of `docs` (doc_id by default) and the score in [0, 1], named `name`; nothing but the text enters it.

    Null and empty texts score as texts without a match. Repeated rows and null doc_ids give a row each; an input column
    of the name of the score is replaced; nothing is shuffled.
    """
    columns = [c for c in columns or ["doc_id"] if c != name]
    rows = docs.select(*columns, *([] if "text" in columns else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_score_task(spark.sparkContext.broadcast(grammar), name), f"{schema}, `{name}` double").select(*columns, name)
